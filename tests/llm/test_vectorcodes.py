"""Vector codes against plain Lloyd iterations in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from terrane.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, upper string, code int"


def lloyd(vectors, parts, entries, rounds):
    """Codes, errors and codebooks of integer vectors in the order of their ids."""
    width = len(vectors[0]) // parts
    cut = [[tuple(v[p * width : p * width + width]) for v in vectors] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for x in cut[p]:
                held.setdefault(nearest(x, books[p])[1], []).append(x)
            for k, xs in held.items():
                books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    found = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(vectors))]
    text = ",".join(str(c) for p in range(parts) for e in books[p] for c in e)
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, parts, entries, rounds=4):
    table = spark.createDataFrame([(i, v, n, "u", 1) for i, v, n in rows], SCHEMA).repartition(3)
    found = vectorcodes.with_label_errors(vectorcodes.encoded(table, parts=parts, entries=entries, rounds=rounds)).collect()
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0]))
    ints = [[math.floor(1024 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    codes, errors, sha = lloyd(ints, parts, entries, rounds)
    sums = {}
    for (_, _, n), e in zip(kept, errors, strict=True):
        sums[n] = sums.get(n, 0) + e
    expected = [(i, c, e, sums[n], sha) for (i, _, n), c, e in zip(kept, codes, errors, strict=True)]
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("spread, entries", [(1.0, 16), (0.003, 16), (0.003, 256)])
def test_against_lloyd(spark, spread, entries):
    """Small spreads put many parts at equal distances, so ties decide."""
    r = np.random.default_rng(5)
    rows = [(int(k * 3 - 50), [float(x) for x in r.normal(r.integers(0, 3), spread, 8)], [None, 1, 2][k % 3]) for k in range(150)]
    rows += [(1001, None, 1), (1002, [], 1), (1003, [None] + [0.0] * 7, 1), (1004, [math.nan] + [0.0] * 7, 1), (1005, [-math.inf] + [0.0] * 7, None)]
    rows += [(2000 + k, rows[4][1], 7) for k in range(40)] + [(None, rows[5][1], 7)]
    check(spark, rows, 4, entries)


def test_few_vectors_and_none(spark):
    check(spark, [(5, [0.5, -0.5], 1), (3, [0.5, -0.5], None), (9, [7.0, 1.0], None)], 2, 256)
    check(spark, [(5, [0.5, -0.5], 1)], 1, 4)
    table = spark.createDataFrame([(1, None, 1, "u", 1)], SCHEMA)
    for frame in (table, table.where("false")):
        assert vectorcodes.with_label_errors(vectorcodes.encoded(frame)).count() == 0


def test_bad_shapes(spark):
    for vectors in ([[1.0] * 4, [1.0] * 8], [[1.0] * 6], [[1e6] * 4]):
        with pytest.raises(ValueError):
            vectorcodes.encoded(spark.createDataFrame([(k, v, 1, "u", 1) for k, v in enumerate(vectors)], SCHEMA))


def test_pruned_rounds_equal_full_ones_and_save_distances():
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(m, 20, (400, 6)) for m in r.integers(-900, 900, (30, 6))]).astype(np.int64)
    old = vectorcodes.Codebooks(x[None, :: len(x) // 64][:, :64], 2.0 * 1100 * math.sqrt(6) / 32_768)
    entry, upper, lower = vectorcodes.assign_all(x, old.entries[0], old.step)
    worked = 0
    for _ in range(5):
        sums = {(0, k): (int((entry == k).sum()), x[entry == k].sum(axis=0).tolist()) for k in range(64) if (entry == k).any()}
        new = old.replaced(sums)
        moved = new.movement(old)
        upper, lower = upper + moved[0][entry], np.maximum(lower - moved, 0)
        entry, upper, lower, n = vectorcodes.assign_pruned(x, 0, new, entry, upper, lower)
        worked += n
        d = vectorcodes.squared(x, new.entries[0])
        assert (entry == d.argmin(axis=1)).all()
        assert (np.sqrt(d[np.arange(len(x)), entry]) <= upper * new.step).all() and (lower * new.step <= np.sqrt(d)).all()
        old = new
    assert worked < 0.2 * 5 * len(x) * 64
