"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

1. Where a document lies, its set of word shingles becomes sorted 64-bit hashes, a digest of the set and a signature of
   ``symbols`` MinHash values of 8 bits. Documents with equal sets are one class; only classes go on.
2. A signature is split into chunks. Two signatures that differ in at most ``chunks * (errors + 1) - 1`` symbols have, by
   the pigeonhole principle, a chunk with at most ``errors`` = 1 differing symbols; so each chunk is looked up with each
   of its symbols left out in turn, and every pair under the threshold shares a key. With 13 chunks of 5 symbols that
   is 25 of 65 symbols, where pairs of similarity 0.8 differ in 13 on average.
3. A bucket (the classes with one key) may hold any share of the rows, so its pairs are never all made. Classes are
   ranked by how crowded their buckets are, which puts the middle of a group of near copies first; in a bucket of up to
   ``reach`` + 1 classes every pair is a candidate, in a larger one each class meets the first ranked only. The first is
   the same one in most of a group's buckets, so distinct candidates grow with the classes.
4. Candidates whose signatures differ in more than the threshold are dropped; the others are confirmed on the full sets,
   first the two closest of each class, then those that these links don't connect. Components follow by hooking and
   contraction; every step writes its tables to the shared folder.
5. Classes of a larger bucket that still holds several components go through an exact positional prefix join: of two
   sets of the needed similarity one of the rarest fifth of their shingles is common, at places that leave room for the
   overlap that is needed. A template's common shingles come last in that order and so make no candidates; a frequent
   key is compared in blocks, its largest component never with itself. So each pair with a common key is compared,
   connected or known to be less similar, whatever the size of its bucket.

Defined cases: null, empty or blank texts have an empty set and are linked with nothing; a single word is one shingle;
rows that repeat are copies of each other; a null id takes part and never names a component unless it is alone; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.llm.memory import kept
from terrane.session import fresh_names, materialize, release

_BLANK = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SETS = "uid long, doc_id long, text_hash long, n_shingles long, set_key binary, signature binary, members binary"
CHUNKS, CHUNK = 13, 5
SYMBOLS = CHUNKS * CHUNK


class WordHashes(dict):
    """Word to 64-bit hash, emptied at 100,000 words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, hashes: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    hashes = WordHashes() if hashes is None else hashes
    words = text.encode("utf-8").translate(_BLANK).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if n > 1 else out


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240607)
    return (r.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1))[:, None], r.integers(0, 2**32, SYMBOLS, dtype=np.uint32)[:, None]


def signature(members: np.ndarray, ab: tuple[np.ndarray, np.ndarray]) -> bytes:
    """One byte for each MinHash value."""
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    x = (members >> np.uint64(32)).astype(np.uint32) ^ (members >> np.uint64(24)).astype(np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(low, (x[k : k + 2048] * ab[0] ^ ab[1]).min(axis=1), out=low)
    return (low * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8).tobytes()


def to_bytes(members: np.ndarray) -> bytes:
    return members.astype("<u8").tobytes()


def from_bytes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def shingle_sets(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``; ``uid`` numbers the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        from pyspark import TaskContext

        ab, uid = multipliers(), TaskContext.get().partitionId() << 33
        hashes = kept("word hashes", WordHashes)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part, rows = batch.iloc[at : at + 1000], []
                for text in part["text"].tolist():
                    members = shingle_set(text if isinstance(text, str) else None, size, hashes)
                    blob = to_bytes(members)
                    rows.append((len(members), xxhash.xxh3_128_digest(blob), signature(members, ab) if len(members) else None, blob))
                out = pd.DataFrame(rows, columns=["n_shingles", "set_key", "signature", "members"])
                out.insert(0, "text_hash", part["text_hash"].values)
                out.insert(0, "doc_id", part["doc_id"].values)
                out.insert(0, "uid", np.arange(uid, uid + len(out)))
                uid += len(out)
                yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInPandas(run, _SETS)


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(key, node) for each chunk of the signature with one symbol left out."""
    keys = []
    for c in range(CHUNKS):
        chunk = [F.substring("signature", c * CHUNK + j + 1, 1) for j in range(CHUNK)]
        keys += [F.xxhash64(F.lit(c * CHUNK + out), *[s for j, s in enumerate(chunk) if j != out]) for out in range(CHUNK)]
    return classes.select(F.explode(F.array(*keys)).alias("key"), "node")


def shared_buckets(keys: DataFrame) -> DataFrame:
    """(key, node, n) of the rows whose key occurs more than once (and a few at the partitions' ends, which may or may
    not); n is about the bucket's size, as far as it was seen at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first, known = None, True, False
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            key = batch["key"].to_numpy()
            if not len(key):
                continue
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            starts = np.flatnonzero(~same)
            times = np.diff(np.append(starts, len(key)))
            keep = same.copy()
            keep[:-1] |= same[1:]
            # the row held back may have shared its key with rows that are given already
            keep[0] |= known
            if first:
                keep[key == key[0]] = True
                first = False
            # of the last key only one row is held back: the others are known to be shared
            keep[starts[-1] : -1] = True
            yield batch.assign(n=np.repeat(times, times))[:-1][keep[:-1]]
            held, known = batch[-1:], bool(keep[-1])
        if held is not None:
            yield held.assign(n=1)

    return keys.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInPandas(run, "key long, node long, n long")


def candidates(buckets: DataFrame, reach: int) -> DataFrame:
    """Distinct pairs (a, b) of classes: all of buckets of up to ``reach`` + 1, else each with the first ranked, b."""
    weight = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "node"))
    first = buckets.join(weight, "node").withColumn("turn", turn).where(F.col("turn") <= reach + 2)
    first = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("turn", "node"))).alias("first"))
    heads = F.transform("first", lambda x: x["node"])
    heads = F.when(F.size("first") > reach + 1, F.slice(heads, 1, 1)).otherwise(heads)
    first = materialize(first.select("key", heads.alias("heads")), "heads")
    # of the ranked ones each meets those before it
    place = F.array_position("heads", F.col("node")).cast("int")
    before = F.when(place > 0, F.expr("slice(heads, 1, int(array_position(heads, node)) - 1)")).otherwise(F.col("heads"))
    return buckets.select("key", "node").join(first, "key").select(F.col("node").alias("a"), F.explode(before).alias("b")).distinct()


def close_pairs(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """The pairs whose signatures differ in at most ``most`` symbols."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c].map(bytes)), np.uint8).reshape(-1, SYMBOLS) for c in ("sa", "sb"))
                apart = (x != y).sum(axis=1)
                yield batch[["a", "b"]].assign(apart=apart)[apart <= most]

    signed = classes.select("node", "signature")
    both = pairs.join(signed.toDF("a", "sa"), "a").join(signed.toDF("b", "sb"), "b")
    return both.mapInPandas(run, "a long, b long, apart long")


_BITS = 24


def _bit(node):
    return F.pmod(F.xxhash64(node, F.lit(7)), F.lit(1 << _BITS))


def needed_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, members) of at least the classes in ``pairs``: others pass only by a chance hit in a bitmap of fixed size."""
    bit = pairs.select(_bit(F.col("a")).alias("bit")).unionByName(pairs.select(_bit(F.col("b")).alias("bit")))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(pmod(bit, 64)))) AS bits")).toArrow()
    bitmap = np.zeros(1 << (_BITS - 6), np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for batch in batches:
            bit = batch["bit"].to_numpy(np.int64)
            yield batch.loc[(held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1, ["node", "members"]]

    return sets.select(F.col("uid").alias("node"), "members", _bit(F.col("uid")).alias("bit")).mapInPandas(run, "node long, members binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """The pairs with 100 * shared members >= percent * members of either, as a table of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["ma"], batch["mb"], strict=True):
                n, m = len(x) // 8, len(y) // 8
                if 100 * min(n, m) < percent * max(n, m):
                    ok.append(False)
                    continue
                both = np.concatenate([from_bytes(x), from_bytes(y)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (n + m - shared))
            yield batch.loc[np.array(ok, bool), ["a", "b"]]

    held = _written(needed_sets(pairs, sets), "needed-sets")
    both = pairs.select("a", "b").join(held.toDF("a", "ma"), "a").join(held.toDF("b", "mb"), "b")
    found = _written(both.mapInPandas(run, "a long, b long"), label)
    release(held)
    return found


def open_classes(buckets: DataFrame, roots: DataFrame, reach: int) -> DataFrame:
    """(node, comp) of the classes in larger buckets of several components."""
    held = buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    large = held.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    large = materialize(large.where((F.col("n") > reach + 1) & (F.col("low") != F.col("high"))).select("key"), "open-keys")
    return held.join(large, "key", "left_semi").select("node", "comp").distinct()


_SLOTS = 1 << 20
_BLOCK = 512


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each slot; any counts give right results, good ones few candidates.

    The driver gets a number for each slot at most, as an Arrow table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            if len(batch):
                slot = from_bytes(b"".join(batch["members"].map(bytes))) & np.uint64(_SLOTS - 1)
                total += np.bincount(slot.astype(np.int64), minlength=_SLOTS)
        slot = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slot, "n": total[slot]})

    with _small_batches(sets.sparkSession):
        found = sets.select("members").mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


def rarest(members: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The members of which sets at least ``percent`` similar have one in common: the first in the order of ``counts``."""
    n = len(members)
    keep = n + (-percent * n // 100) + 1
    return members[np.lexsort((members, counts[(members & np.uint64(_SLOTS - 1)).astype(np.int64)]))[:keep]]


def rare_keys(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(key, node, comp, n, place) for each of the rarest members of ``sets`` (node, comp, members), in their order."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                held = [from_bytes(bytes(x)) for x in batch["members"]]
                keys = [rarest(x, shared.value, percent) for x in held]
                times = [len(x) for x in keys]
                fields = {"node": batch["node"], "comp": batch["comp"], "n": [len(x) for x in held]}
                out = {"key": np.concatenate(keys).view(np.int64)} | {c: np.repeat(np.asarray(v, np.int64), times) for c, v in fields.items()}
                yield pd.DataFrame(out | {"place": np.concatenate([np.arange(t) for t in times])})

    return sets.select("node", "comp", "members").mapInPandas(run, "key long, node long, comp long, n long, place long")


def cells(keys: DataFrame) -> DataFrame:
    """``keys`` dealt out so that any two rows of a key with different ``comp`` meet in a cell of at most some blocks.

    A key's largest component is never compared with itself: its blocks (side 0) meet the others' (side 1) in cells of
    kind 0, and the others' blocks meet each other in cells of kind 1. A key of one block is one cell of kind 2.
    """
    by_comp = keys.groupBy("key", "comp").agg(F.count("*").alias("k"))
    stats = by_comp.groupBy("key").agg(F.sum("k").alias("rows"), F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"))
    stats = materialize(stats.where("comps > 1").select("key", "rows", F.col("top.k").alias("k"), F.col("top.comp").alias("top")), "rare-stats")
    blocks = lambda n: F.ceil(n / _BLOCK).cast("long")
    wide = keys.join(stats, "key").withColumns({"side": (F.col("comp") != F.col("top")).cast("long"), "g0": blocks(F.col("k")), "g1": blocks(F.col("rows") - F.col("k"))})
    wide = wide.withColumn("own", F.pmod(F.xxhash64(F.lit(11), "node"), F.when(F.col("side") == 0, F.col("g0")).otherwise(F.col("g1"))))
    own, upto = F.col("own"), lambda g: F.sequence(F.lit(0).cast("long"), F.col(g) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"))
    mixed = F.when(F.col("side") == 0, F.transform(upto("g1"), lambda j: cell(0, own, j))).otherwise(
        F.concat(F.transform(upto("g0"), lambda i: cell(0, i, own)), F.transform(upto("g1"), lambda j: cell(1, F.least(own, j), F.greatest(own, j))))
    )
    zero = F.lit(0)
    at = F.explode(F.when(F.col("rows") <= _BLOCK, F.array(cell(2, zero, zero))).otherwise(mixed)).alias("at")
    return wide.select("key", "node", "comp", "n", "place", "side", "own", at).select("key", "at.kind", "at.i", "at.j", "node", "comp", "n", "place", "side", "own")


def rare_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different components that share a key and may be similar by their sizes and the key's places."""

    def compared(group: pd.DataFrame) -> np.ndarray:
        node, comp, n, place, side, own = (group[c].to_numpy() for c in ("node", "comp", "n", "place", "side", "own"))
        kind, i, j = (int(group[c].iloc[0]) for c in ("kind", "i", "j"))
        # at the first common key no more than what follows it in both sets can be common
        left = n - place
        fits = np.minimum(left[:, None], left[None, :]) * (100 + percent) >= percent * (n[:, None] + n[None, :])
        fits &= comp[:, None] != comp[None, :]
        if kind == 0:
            fits &= side[:, None] != side[None, :]
        elif kind == 1 and i != j:
            fits &= own[:, None] != own[None, :]
        x, y = np.nonzero(np.triu(fits, 1))
        fit = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        a, b = node[x[fit]], node[y[fit]]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(rows: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
            out = [compared(rows.iloc[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True) if e - s > 1]
            pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            at = rows[["key", "kind", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))
            yield found(rows, starts)
            held = rows.iloc[starts[-1] :]
        if held is not None:
            yield found(held, np.array([0, len(held)]))

    where = ("key", "kind", "i", "j")
    return cells(keys).repartition(*where).sortWithinPartitions(*where).mapInPandas(run, "a long, b long").distinct()


def rest_links(buckets: DataFrame, roots: DataFrame, sets: DataFrame, reach: int, percent: int) -> DataFrame | None:
    """The confirmed links of the pairs in large buckets that are not connected yet; None where there are none."""
    todo = materialize(open_classes(buckets, roots, reach), "open")
    if todo.isEmpty():
        return None
    held = _written(needed_sets(todo.select(F.col("node").alias("a"), F.col("node").alias("b")), sets), "open-sets")
    keys = _written(rare_keys(held.join(todo, "node"), shingle_counts(held), percent), "rare-keys")
    release(held)
    pairs = materialize(rare_pairs(keys, percent), "rare-pairs")
    release(keys)
    return confirmed(pairs, sets, percent, "links-rest")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b): root is the same for connected nodes and is one of them.

    Each round hooks every node to its least neighbour (or itself) and contracts the links; hooks of a round are joined
    to those before. The number of rounds grows with the logarithm of the nodes.
    """
    links = materialize(links.where("a <> b").distinct(), "links")
    roots = materialize(links.where("false").toDF("node", "root"), "roots")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "hooks")
        # hooks point to smaller nodes; following them twice shortens the chains
        twice = hooks.join(hooks.toDF("p", "q"), "p").select("a", F.col("q").alias("p"))
        jumps = materialize(twice.join(hooks.toDF("p", "q"), "p").select("a", F.col("q").alias("p")), "jumps")
        moved = roots.join(jumps.toDF("root", "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        known = jumps.toDF("node", "root").join(roots.select("node"), "node", "left_anti")
        then = links.join(jumps.toDF("a", "pa"), "a").join(jumps.toDF("b", "pb"), "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        before = links, roots, hooks, jumps
        roots, links = materialize(moved.unionByName(known), "roots"), materialize(then.where("a <> b").distinct(), "links")
        release(*before)
    return roots


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of few rows, for rows with whole sets or texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _written(df: DataFrame, label: str) -> DataFrame:
    with _small_batches(df.sparkSession):
        return materialize(df, label)


def _joined(links: DataFrame, roots: DataFrame, more: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The links and their components with more links added."""
    if more is None or more.isEmpty():
        return links, roots
    links = links.unionByName(more)
    return links, components(links)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, reach: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: uid, doc_id, text_hash, n_shingles, component_id (least id of its group) and kept.

    ``kept`` holds for one row of each group: the first with the least id.
    """
    most = CHUNKS * 2 - 1
    sets = _written(shingle_sets(docs, shingle, id_col, text_col), "shingle-sets")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "uid"))
    classes = sets.where("n_shingles > 0").groupBy("set_key")
    classes = classes.agg(F.min("uid").alias("node"), F.min(named).alias("first"), F.first("signature").alias("signature"))
    classes = materialize(classes, "classes")
    buckets = materialize(shared_buckets(chunk_keys(classes)), "buckets")
    met = materialize(candidates(buckets, reach), "candidates")
    pairs = materialize(close_pairs(met, classes, most), "pairs")
    release(met)
    # most classes hang together by their closest pairs; the others are confirmed only where those don't connect
    rank = Window.partitionBy("a").orderBy("apart", "b")
    best = materialize(pairs.withColumn("rank", F.row_number().over(rank)).where("rank <= 2").select("a", "b"), "pairs-best")
    links = confirmed(best, sets, percent, "links-best")
    roots = components(links)
    rest = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    rest = rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    more = confirmed(materialize(rest, "pairs-rest"), sets, percent, "links-more")
    links, roots = _joined(links, roots, more)
    links, roots = _joined(links, roots, rest_links(buckets, roots, sets, reach, percent))
    release(pairs, best, buckets)
    unnamed = F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("node").alias("uid"))
    row = F.struct(F.col("first").isNull().alias("last"), F.coalesce("first", unnamed).alias("row"))
    held = materialize(classes.join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"), row.alias("row")), "rooted")
    names = materialize(held.groupBy("root").agg(F.min("row").alias("row")).select("root", "row.row"), "names")
    held = held.select("set_key", "root").join(names, "root").select("set_key", F.col("row.doc_id").alias("name"), F.col("row.uid").alias("first_uid"))
    rows = sets.where("n_shingles > 0").select("uid", "doc_id", "text_hash", "n_shingles", "set_key").join(held, "set_key")
    out = rows.select("uid", "doc_id", "text_hash", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"), (F.col("uid") == F.col("first_uid")).alias("kept"))
    alone = sets.where("n_shingles = 0").select("uid", "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, one of each group, with the columns of ``docs``.

    Of rows that are equal in id and text one stays, whichever; rows without words all stay. Columns of any name pass.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    found = materialize(found.select("doc_id", "text_hash", "kept", (F.col("n_shingles") > 0).alias("worded")), "found")
    id_, hashed, alone, turn = fresh_names(docs, 4)
    empty = F.col(text_col).isNull() | F.col(text_col).rlike(r"\A[\x20\x09-\x0D]*\z")
    here = docs.withColumns({id_: F.col(id_col).cast("long"), hashed: F.xxhash64(text_col), alone: F.when(empty, F.monotonically_increasing_id())})
    stay = found.where("kept").select("doc_id", "text_hash").distinct().toDF(*fresh_names(here, 2))
    held = here.join(stay, here[id_].eqNullSafe(stay[stay.columns[0]]) & (here[hashed] == stay[stay.columns[1]]), "left_semi")
    if not found.where("worded").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("n > 1 AND kept").isEmpty():
        first = F.row_number().over(Window.partitionBy(id_, hashed, alone).orderBy(alone))
        held = held.withColumn(turn, first).where(F.col(turn) == 1)
    return held.select(*[F.col(f"`{c}`") for c in docs.columns])
