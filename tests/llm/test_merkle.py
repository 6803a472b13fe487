"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from terrane.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, key int, idx string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(r, more=0):
    n = r[4] if r[4] is None else r[4] + more
    return h(*map(field, (r[0], r[3], r[2], n, r[1])))


def tree(nodes, fanout):
    """The root and each leaf's runs: (runs before, runs after) level by level."""
    paths = [[] for _ in nodes]
    held = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for k, leaves in enumerate(held):
            for leaf in leaves:
                run, at = runs[k // fanout], k % fanout
                paths[leaf].append((run[:at], run[at + 1 :]))
        held = [sum(held[k : k + fanout], []) for k in range(0, len(held), fanout)]
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree([leaf_of(r) for r in groups[g]], fanout)
    root, above = tree([trees[g][0] for g in langs], fanout)
    out = []
    for k, g in enumerate(langs):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            whole = path + above[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of(r, int(hit))
            for before, after in whole:
                node = h(*before, node, *after)
            out.append((r[0], leaf_of(r), trees[g][0], root, h(*[x for b, a in whole for x in (*b, *a)]), node, node == root))
    return out


def check(spark, rows, fanout=2, levels=2, parts=3):
    docs = spark.createDataFrame([(*r, "root", 1, "idx") for r in rows], SCHEMA).repartition(parts)
    found = merkle.manifest(docs, merkle.one_more(), fanout=fanout, levels=levels)
    got = [tuple(r) for r in merkle.digest(found).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(brute(rows, fanout), key=str)


def some_rows(n):
    langs = ["en", "de", None, "", "é", "Z"]
    return [(k * 13 - 40, None if k % 17 == 3 else f"text {k} é\n", langs[min(k % 11, 5)], None if k % 5 == 1 else "s", None if k % 7 == 2 else k) for k in range(n)]


@pytest.mark.parametrize("n, fanout, levels", [(1, 2, 13), (2, 2, 1), (37, 2, 2), (150, 2, 13), (150, 3, 1), (83, 4, 2)])
def test_against_a_plain_tree(spark, n, fanout, levels):
    check(spark, some_rows(n), fanout, levels)


def test_ties_nulls_and_long_texts(spark):
    rows = some_rows(20) + [(None, "x", "en", "s", 1), (None, "y", None, None, None)] + [(7, "same", "en", "s", 4)] * 5 + [(8, "é" * 2_000_000, "en", "s", 9), (9, "", "en", "", 0)]
    check(spark, rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.digest(merkle.manifest(docs)).count() == 0


def test_untampered_rows_verify_and_tampered_ones_do_not(spark):
    docs = spark.createDataFrame([(*r, "root", 1, "idx") for r in some_rows(60)], SCHEMA)
    assert merkle.digest(merkle.manifest(docs, levels=3)).where("NOT verified").count() == 0
    found = merkle.digest(merkle.manifest(docs, merkle.one_more(), levels=3)).join(docs.select("doc_id", "n_chars"), "doc_id")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    assert found.where(hit == F.col("verified")).count() == 0 and found.where(hit).count() > 2


def test_proofs_hold():
    leaves = [h(str(k)) for k in range(11)]
    root, _ = tree(leaves, 2)
    paths = merkle.paths(merkle.levels_above(merkle._matrix(leaves), 2), 2)
    rows = [(x, k, 11, p.decode(), root) for k, (x, p) in enumerate(zip(leaves, paths, strict=True))]
    assert merkle.proofs_hold(iter(rows))
    assert not merkle.proofs_hold(iter([(h("other"), *rows[3][1:])]))
