"""Repeated word windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import substrings

DOCS = "doc_id long, text string, spans string, kept_text long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    """(doc_id, words, kept words) of rows in the order of their ids."""
    seen, out = set(), []
    for doc_id, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((doc_id, len(w), [x for x, g in zip(w, gone, strict=True) if not g], gone))
    return out


def table(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS).repartition(parts)


def check(spark, rows, window, parts=3, **options):
    found = substrings.without_repeats(table(spark, rows, parts), window=window, **options).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    for doc_id, n, left, gone in brute(sorted(rows, key=lambda r: (r[0] is None, r[0])), window):
        r = got[doc_id]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (n, n - len(left), " ".join(left)), doc_id
        inside = [False] * n
        for s in r["spans"]:
            inside[s["start"] : s["end"]] = [True] * (s["end"] - s["start"])
        assert inside == gone
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


@pytest.mark.parametrize("chunk_words, group_windows", [(1_000_000, 2_000_000), (60, 40)])
def test_against_brute_force(spark, chunk_words, group_windows):
    r = random.Random(11)
    passages = [" ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(r.randrange(3, 30))) for _ in range(12)]
    rows = [(k * 7 - 300, r.choice([" ", "\n", "\t \r\n"]).join(r.choice(passages) for _ in range(r.randrange(6)))) for k in range(90)]
    rows += [(-10**15, "a " * 300), (10**15, "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb"), (5000, None), (5001, ""), (5002, " \n"), (None, rows[3][1] + " end")]
    check(spark, rows, 5, chunk_words=chunk_words, group_windows=group_windows)


def test_very_long_texts_and_ties(spark):
    r = random.Random(12)
    long = " ".join(str(r.randrange(50_000)) for _ in range(300_000))
    rows = [(3, long + " tail"), (1, "x " + long[1000:900_000]), (2, "é" * 3_000_000)]
    check(spark, rows, 20, parts=2)
    same = " ".join(str(k) for k in range(40))
    found = substrings.without_repeats(table(spark, [(1, same)] * 5, 5), window=20).collect()
    assert sorted(x["n_removed"] for x in found) == [0, 40, 40, 40, 40]


def test_empty_table(spark):
    assert substrings.without_repeats(table(spark, [(1, "a")]).where("false")).count() == 0
    assert substrings.without_repeats(table(spark, [(1, None), (2, "b c")])).agg(F.sum("n_words")).first()[0] == 2


def test_window_hashes_are_of_the_window_alone():
    hashed = substrings.word_hashes([str(k % 30).encode() for k in range(500)], 500)
    found = substrings.window_hashes(hashed, 20)
    for k in (0, 1, 17, 29):
        assert (found[:, k] == found[:, k + 30 * np.arange(15)].T).all()
    assert len(np.unique(found[0])) == len(np.unique(found[1])) == 30


def test_digest(spark):
    found = substrings.digest(substrings.without_repeats(table(spark, [(1, "a  b\nc")]))).first()
    assert found["kept_sha256"] == hashlib.sha256(b"a b c").hexdigest()


def test_packed_numbers():
    r = random.Random(13)
    for most in (0, 1, 255, 256, 511, 70_000, 2**31):
        for n in (1, 7, 8, 1000):
            values = np.array([most] + [r.randrange(most + 1) for _ in range(n - 1)], np.int64)
            assert (substrings.unpacked(substrings.packed(values, most), n) == values).all()
