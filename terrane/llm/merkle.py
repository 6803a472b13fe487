"""A Merkle manifest of a table: a tree for each group of rows, and one over the groups' roots.

1. Every row becomes a leaf, the SHA-256 of its fields with their byte counts, by built-in functions where it lies.
2. Leaves get their place in their group's order from a range-partitioned sort and the counts of its partitions; no group
   has to fit in a task.
3. A task takes an aligned block of ``fanout ** levels`` leaves. Their digests are one contiguous matrix of 64-byte rows;
   reshaped by the fanout, each row is what a node of the next level is the digest of. A block of a group of several
   blocks always has ``levels`` levels (its last node may be hashed alone), so blocks' roots are the nodes of that level.
4. Roots of blocks are treated the same way until each group has one node; the groups' roots, in the order of the groups,
   are the leaves of the last tree.
5. Blocks meet the siblings of their own root, and every leaf's path is read from the block's matrices: a node's run is its
   index divided by the fanout, its siblings are the rest of that run. Folding a leaf up its path gives a root again.

Digests pass between steps as rows of some hundred bytes a leaf, whatever the size of the rows they stand for.

Defined cases: nulls are written ``-``; an empty group is none; rows of equal id are ordered by their leaves, null ids
come first, the null group comes first; a group or a table of one row has that row's leaf as its root, an empty table no
rows; only the columns named are read, so others may have any names. An id is tampered with, or not, by its own number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import materialize, release

HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256(blob: bytes) -> bytes:
    return hashlib.sha256(blob).hexdigest().encode()


def levels_above(matrix: np.ndarray, fanout: int, levels: int | None = None) -> list[np.ndarray]:
    """The digest matrices (nodes, 64) of a tree from its leaves up: ``levels`` of them, or until one node is left."""
    out = [np.ascontiguousarray(matrix)]
    while len(out) - 1 < levels if levels is not None else len(out[-1]) > 1:
        row = fanout * HEX
        flat = memoryview(out[-1].tobytes())
        nodes = b"".join([sha256(flat[at : at + row]) for at in range(0, len(flat), row)])
        out.append(np.frombuffer(nodes, np.uint8).reshape(-1, HEX))
    return out


def paths(tree: list[np.ndarray], fanout: int) -> list[bytes]:
    """Each leaf's siblings, level by level from the bottom, left to right."""
    index = np.arange(len(tree[0]))
    gathered, there = [], []
    for nodes in tree[:-1]:
        if fanout > 1:
            first = index // fanout * fanout
            others = first[:, None] + np.arange(fanout - 1)
            others += others >= index[:, None]  # the run without the node itself
            fits = others < len(nodes)
            gathered.append(nodes[np.where(fits, others, 0)])
            there.append(fits)
        index = index // fanout
    if not gathered:
        return [b""] * len(tree[0])
    rows, fits = np.concatenate(gathered, axis=1), np.concatenate(there, axis=1)
    whole = fits.all(axis=1).tolist()
    return [rows[i].tobytes() if w else rows[i][fits[i]].tobytes() for i, w in enumerate(whole)]


def fold(leaf: bytes, index: int, size: int, siblings: bytes, fanout: int, levels: int | None = None) -> tuple[bytes, bytes]:
    """The node ``levels`` above a leaf (or the root) of a tree of ``size`` leaves by its siblings, and the siblings left."""
    done = 0
    while done < levels if levels is not None else size > 1:
        place, first = index % fanout, index // fanout * fanout
        there = min(fanout, size - first) - 1
        run, siblings = siblings[: there * HEX], siblings[there * HEX :]
        leaf = sha256(run[: place * HEX] + leaf + run[place * HEX :])
        index, size, done = index // fanout, -(-size // fanout), done + 1
    return leaf, siblings


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def ranked(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 in their key's order, and ``size``, the rows of the key.

    The sort is by range, so a key may hold any share of the rows; only counts by key and partition are summed up.
    """
    held = materialize(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned("at", 33)
    counts = held.withColumn("part", part).groupBy(key, "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(key, "part", "start", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(key)).alias("size"))
    placed = held.withColumn("part", part).join(starts, [key, "part"])
    return placed.withColumn("idx", F.col("at") - F.col("start") + F.col("before")).drop("at", "part", "start", "before")


def block_roots(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(key, idx, size, digest) of the aligned blocks of ``nodes`` (key, idx, size, digest), one level of blocks up.

    A key of one block gets its root, one of several the nodes ``levels`` above.
    """
    width = fanout**levels

    def run(block: pd.DataFrame) -> pd.DataFrame:
        size = int(block["size"].iloc[0])
        tree = levels_above(_matrix(block.sort_values("idx")["digest"]), fanout, None if size <= width else levels)
        return pd.DataFrame({"key": [block["key"].iloc[0]], "idx": [int(block["block"].iloc[0])], "size": [-(-size // width)], "digest": [tree[-1][0].tobytes().decode()]})

    return _blocked(nodes, width).groupBy("key", "block").applyInPandas(run, "key string, idx long, size long, digest string")


def block_paths(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with ``path``, their siblings up to their block's root."""
    width = fanout**levels

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        tree = levels_above(_matrix(block["digest"]), fanout, None if int(block["size"].iloc[0]) <= width else levels)
        return block[["key", "idx", "size", "digest"]].assign(path=paths(tree, fanout))

    return _blocked(nodes, width).groupBy("key", "block").applyInPandas(run, "key string, idx long, size long, digest string, path binary")


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, HEX)


def _blocked(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.select("key", "idx", "size", "digest", F.floor(F.col("idx") / width).alias("block"))


def climbed(nodes: DataFrame, fanout: int, levels: int, label: str) -> DataFrame:
    """``nodes`` (key, idx, size, digest) with ``path`` (siblings up to the key's root) and ``root``."""
    held = [nodes]
    while True:  # a round divides the nodes by the width of a block
        held.append(materialize(block_roots(held[-1], fanout, levels), label))
        if held[-1].where("size > 1").isEmpty():
            break
    above = held[-1].select("key", "idx", F.lit(b"").alias("upper"), F.col("digest").alias("root"))
    for level in reversed(held[:-1]):
        own = block_paths(level, fanout, levels).withColumn("block", F.floor(F.col("idx") / fanout**levels))
        met = own.join(above.withColumnRenamed("idx", "block"), ["key", "block"])
        above = met.select("key", "idx", "size", "digest", F.concat("path", "upper").alias("path"), "root")
        if level is not held[0]:
            above = above.select("key", "idx", F.col("path").alias("upper"), "root")
    return above


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2, levels: int = 13) -> DataFrame:
    """One row per row of ``docs``: doc_id, grp, idx, leaf, subroot, root, proof (siblings to the root, as text), and
    folded_root, the root that the row's leaf gives by its proof.

    ``changed`` holds other expressions for fields: the folded leaf is then that of the changed row (a null expression's
    field is folded as null), so the folded root shows whether the manifest notices.
    """
    leaf = leaf_digest([F.col(f"`{f}`") for f in fields])
    again = leaf_digest([(changed or {}).get(f, F.col(f"`{f}`")) for f in fields]) if changed else leaf
    # a key that sorts as the groups do, the null group first, and is never null
    key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group_col}`").cast("string")), F.lit("0"))
    rows = docs.select(key.alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf.alias("digest"), again.alias("again"))
    leaves = materialize(rows, "leaves")
    placed = materialize(ranked(leaves, "key", ["doc_id", "digest"], "leaves-sorted"), "leaves-placed")
    nodes = placed.select("key", "idx", "size", "digest")
    width = fanout**levels
    # the blocks of each group, what lies above them, and the groups' roots
    blocks = materialize(block_roots(nodes, fanout, levels), "blocks")
    upper = materialize(climbed(blocks, fanout, levels, "blocks-above"), "blocks-climbed")
    roots = upper.where("idx = 0").select(F.lit("").alias("key"), F.col("key").alias("grp"), F.col("root").alias("digest"))
    groups = materialize(ranked(roots, "key", ["grp"], "groups-sorted"), "groups")
    tops = climbed(groups.select("key", "idx", "size", "digest"), fanout, levels, "groups-above")
    tops = tops.select(F.col("idx").alias("g_idx"), F.col("size").alias("g_size"), F.col("path").alias("g_path"), F.col("root").alias("top"))
    tops = materialize(groups.select(F.col("grp").alias("key"), F.col("idx").alias("g_idx")).join(tops, "g_idx"), "tops")
    above = upper.select("key", F.col("idx").alias("block"), "path", F.col("root").alias("subroot")).join(tops, "key")

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        top = block.iloc[0]
        size, g_idx, g_size, upper_path, g_path = int(top["size"]), int(top["g_idx"]), int(top["g_size"]), bytes(top["path"]), bytes(top["g_path"])
        inside = None if size <= width else levels
        own = paths(levels_above(_matrix(block["digest"]), fanout, inside), fanout)
        rest = upper_path + g_path
        known: dict[bytes, bytes] = {}
        folded = []
        for index, digest, path in zip(block["idx"].tolist(), block["again"], own, strict=True):
            node, _ = fold(digest.encode(), index, size, path, fanout, inside)
            if node not in known:
                # what is above the block is the same for all that reach the same node
                subroot = node if inside is None else fold(node, index // width, -(-size // width), upper_path, fanout)[0]
                known[node] = fold(subroot, g_idx, g_size, g_path, fanout)[0]
            folded.append(known[node].decode())
        out = {"doc_id": block["doc_id"], "key": block["key"], "idx": block["idx"], "leaf": block["digest"], "subroot": block["subroot"], "root": block["top"]}
        return pd.DataFrame(out | {"proof": [(p + rest).decode() for p in own], "folded_root": folded})

    met = placed.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("block", F.floor(F.col("idx") / width)).join(above, ["key", "block"])
    schema = "doc_id string, key string, idx long, leaf string, subroot string, root string, proof string, folded_root string"
    found = met.groupBy("key", "block").applyInPandas(run, schema)
    group = F.when(F.col("key") != "0", F.substring("key", 2, 2**30))
    release(leaves)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("grp"), "idx", "leaf", "subroot", "root", "proof", "folded_root")


def one_more(doc_id: str = "doc_id", n_chars: str = "n_chars") -> dict[str, Column]:
    """The change that adds 1 to a row's number of characters where 7 divides the CRC-32 of its id in decimals."""
    hit = F.crc32(F.col(doc_id).cast("long").cast("string")) % 7 == 0
    return {n_chars: F.when(hit, F.col(n_chars).cast("long") + 1).otherwise(F.col(n_chars))}


def digest(found: DataFrame) -> DataFrame:
    """The rows of ``manifest`` with their proofs as digests, and whether the folded root is the root."""
    proof = F.sha2("proof", 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def proofs_hold(rows: Iterator[tuple[str, int, int, str, str]], fanout: int = 2) -> bool:
    """For readers without Spark: every (leaf, idx, size, siblings, root) of a single tree folds to its root."""
    return all(fold(leaf.encode(), idx, size, siblings.encode(), fanout) == (root.encode(), b"") for leaf, idx, size, siblings, root in rows)
