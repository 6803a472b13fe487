"""License labels and scores against the same method written plainly."""

import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrane.llm import licenses, secrets

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, license_low string, license_scan int, terrane_0 string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(text, idf, rare=8):
    """Labels (the families' too) and score of one text, every template looked up in every text."""
    ws = words(text)
    rank = {w: k for k, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
    labels = {label for phrase, label in licenses.FAMILIES.items() if any(" ".join(ws[i : i + len(phrase.split())]) == phrase for i in range(len(ws)))}
    score = 0.5 if labels else 0.0
    for label, notice, phrase in licenses.TEMPLATES:
        parts = notice.split()
        chosen = [w for w in sorted(set(parts), key=rank.get) if w in set(ws)][:rare]
        votes = Counter(i - q for i, w in enumerate(ws) if w in chosen for q, v in enumerate(parts) if v == w)
        for offset, n in votes.items():
            near = f" {' '.join(ws[max(offset, 0) : max(offset, 0) + len(parts)])} "
            if n >= 2 and 2 * n >= len(chosen) and f" {phrase} " in near:
                labels.add(label)
                score = max(score, min(1.0, n / min(len(set(parts)), rare)))
    return sorted(labels), score


def scanned(spark, texts, idf=None):
    docs = spark.createDataFrame([(k, t, "low", 3, "x") for k, t in enumerate(texts)], DOCS)
    idf = licenses.inverse_frequencies(docs) if idf is None else idf
    found = licenses.scan(docs, idf)
    assert found.columns == docs.columns and found.where("license_low <> 'low' OR terrane_0 <> 'x'").count() == 0
    return {r["doc_id"]: r["license_scan"] for r in found.collect()}, idf


def check(spark, texts, idf=None):
    got, idf = scanned(spark, texts, idf)
    for k, text in enumerate(texts):
        labels, score = brute(text, idf)
        assert (got[k]["labels"], got[k]["score"]) == (labels, pytest.approx(score)), text
    return got


def without(notice, k):
    parts = notice.split()
    return " ".join(parts[:k] + parts[k + 1 :])


def test_every_notice_with_a_word_left_out(spark):
    """A notice that keeps its mandatory phrase is found, whatever other word is missing and however rare that is."""
    texts, expected = [], []
    for label, notice, phrase in licenses.TEMPLATES:
        for k in range(len(notice.split())):
            text = without(notice, k)
            texts.append(f"And so: {text}. The end")
            expected.append(label if phrase in text and text != phrase else None)
    got = check(spark, texts + ["All rights reserved.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", None, "", "x " * 50])
    n = len(texts)
    assert got[n]["labels"] == ["all-rights"] and got[n + 1]["labels"] == ["mit-text"]
    assert all(label in got[k]["labels"] for k, label in enumerate(expected) if label and len(texts[k].split()) > 8)


def test_random_mixtures(spark):
    r = random.Random(9)
    vocabulary, texts = licenses.vocabulary(), []
    for _ in range(150):
        parts = []
        for _ in range(r.randrange(1, 5)):
            notice = r.choice(licenses.TEMPLATES)[1].split()
            a, b = sorted((r.randrange(len(notice)), r.randrange(len(notice) + 1)))
            parts += r.choice([notice, notice[a:], notice[a:b], [w for w in notice if r.random() < 0.8]]) + [r.choice([*vocabulary, "foo", "Bar"]) for _ in range(r.randrange(6))]
        texts.append(r.choice([" ", ", ", "\n"]).join(parts))
    check(spark, texts)


def test_idf_may_come_from_other_documents(spark):
    """What is found depends on the looked-up words, never on a word outside the mandatory phrase being there."""
    for rarest in ("documentation", "copyright", "reserved", "2"):
        check(spark, ["All rights reserved.", "all rights reserved. Copyright", "Permission is hereby granted, free of charge to some", "cc by 4.0"], {w: 9.0 if w == rarest else 1.0 for w in licenses.vocabulary()})


def test_long_texts_and_empty_tables(spark):
    long = "lorem ipsum " * 200_000 + "Released under the MIT License " + "dolor " * 100_000
    got, _ = scanned(spark, [long, "ties mit license mit license"], {w: 1.0 for w in licenses.vocabulary()})
    assert got[0]["labels"] == ["mit", "mit-notice"] and got[0]["first_word"] == 400_003 and got[1]["n_base"] == 2
    empty = spark.createDataFrame([], DOCS)
    assert licenses.scan(empty, licenses.inverse_frequencies(empty)).count() == 0


def test_secret_scan_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "password=abcdefgh12345", "a", "b", "c")], "doc_id long, text string, secret_key string, secret_kinds string, terrane_0 string")
    row = secrets.scan(docs).first()
    assert (row["secret_key"], row["secret_kinds"], row["terrane_0"], len(row["secret_spans"])) == ("a", "b", "c", 1)
    assert secrets.scan(docs.withColumn("secret_spans", F.lit(1))).first()["secret_spans"][0]["kind"] == "assign"
