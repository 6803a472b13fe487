"""Language-model scores by prediction by partial matching (PPM) over bytes, beside a unigram word baseline.

Model. A text (capitals A-Z lowered) is coded byte by byte, then an end symbol. The context of a byte is the up to
``order`` bytes before it, back to the last blank, for which a start mark stands. Each context is a node of a trie with the counts of the bytes that followed it in the
training texts. A byte not seen there escapes to the next shorter context with the probability of method C (kinds seen
against counts), the bytes seen in the longer context being excluded from the shorter one's counts; below the empty
context all bytes that are left are alike. So the probabilities of all continuations of any context add up to 1.

Plan. Since no context reaches over a blank, the code length of a text is the sum over its units (runs up to a blank),
and one unit's length is worked out once. Per task, unit counts are gathered and added up by a shuffle; the trie is a
set of tables by context length, joined upwards; blocks of units get just the trie rows that they need. Texts then look
their units up: frequent units, whose number is bounded by ``head_units``, in a broadcast table, all others by a join.
Everything counts all training texts, and no unit, context or text is left out at any size.

Defined cases: null and empty texts are coded as the end symbol alone (one end token in the baseline); repeated rows
train and are scored each; equal ids fall on the same side of the split; without training texts all counts are 0 and the
model is uniform; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import materialize

_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WHITE = re.compile("[\t-\r ]+")
#: Bytes that UTF-8 never uses: the end symbol, the start mark, and what begins a unit that is spelled out with its end.
END, START, SPELLED = "\xff", "\xfe", "\xfd"
SYMBOLS = 256
_PARTIAL = 300_000


def units_of(text: str | None) -> list[str]:
    """The units; each byte is one character. A unit ends with a blank that isn't written, or is spelled out."""
    parts = (text.encode("utf-8").translate(_LOW).decode("latin-1") if text else "").split(" ")
    parts[-1] = SPELLED + parts[-1] + END
    return parts


def symbols_of(unit: str) -> str:
    """What is coded for a unit."""
    return unit[1:] if unit[:1] == SPELLED else unit + " "


def tokens_of(unit: str) -> list[str]:
    """The words of the baseline in a unit."""
    bare = unit[1:] if unit[:1] == SPELLED else unit
    return [w for w in _WHITE.split(bare.removesuffix(END)) if w]


def grams_of(unit: str, order: int) -> Iterator[str]:
    """For each symbol its longest context and itself."""
    s = START + symbols_of(unit)
    return (s[max(0, k - order) : k + 1] for k in range(1, len(s)))


def in_training(id_col: str = "doc_id") -> Column:
    return ~is_held_out(id_col)


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def _count_units(rows: DataFrame) -> DataFrame:
    """(unit, whole words, training count) over all texts; units of texts that don't train count 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, trained = set(), Counter()

        def give() -> pd.DataFrame:
            return pd.DataFrame({"unit": list(trained) + [u for u in seen if u not in trained], "c": [*trained.values(), *repeat(0, len(seen - trained.keys()))]})

        for batch in batches:
            for text, trains in zip(batch["text"].tolist(), batch["trains"].tolist(), strict=True):
                units = units_of(text if isinstance(text, str) else None)
                if trains:
                    trained.update(units)
                else:
                    seen.update(units)
            if len(trained) + len(seen) > _PARTIAL * 3:
                yield give()
                seen, trained = set(), Counter()
        yield give()

    return rows.select("text", "trains").mapInPandas(run, "unit string, c long").groupBy("unit").agg(F.sum("c").alias("c"))


def _baseline(units: DataFrame, train_docs: int) -> tuple[DataFrame, float, float, int]:
    """(unit, n_tokens, n_known, base) of all units, log10 of the end's probability, and the training tokens."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(u, w, c) for u, c in zip(batch["unit"].tolist(), batch["c"].tolist(), strict=True) for w in tokens_of(u)]
            yield pd.DataFrame(pairs, columns=["unit", "word", "c"])

    words = materialize(units.mapInPandas(split, "unit string, word string, c long"), "lm-words")
    counts = words.groupBy("word").agg(F.sum("c").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n, v = total["n"] + train_docs, total["v"] + (train_docs > 0)
    below = n + 0.5 * (v + 1)
    by_unit = words.select("unit", "word").join(counts, "word").groupBy("unit").agg(
        F.count("*").alias("n_tokens"), F.count_if(F.col("n") > 0).alias("n_known"), F.sum(F.log10((F.col("n") + 0.5) / F.lit(below))).alias("base")
    )
    return by_unit, math.log10((train_docs + 0.5) / below), below, n


def _trie(grams: DataFrame, order: int) -> DataFrame:
    """(gram, lp): log10 of the probability of a gram's last symbol behind the rest of it.

    ``grams`` (gram, c) has each symbol with its longest context. Tables go from the longest contexts to the empty one
    for the counts, and back up for the probabilities: ``r`` is that of the symbol once its context has been escaped.
    """
    length = F.length("gram") - 1
    levels: dict[int, DataFrame] = {}
    for k in range(order, -1, -1):
        own = grams.where(length == k).select("gram", "c")
        if k < order:
            own = own.unionByName(levels[k + 1].select(F.expr("substring(gram, 2)").alias("gram"), "c"))
        levels[k] = materialize(own.groupBy("gram").agg(F.sum("c").alias("c")), f"lm-level-{k}")
    out, lower = None, None
    for k in range(order + 1):
        rows = levels[k].select("gram", "c", F.expr(f"substring(gram, 1, {k})").alias("context"))
        if lower is None:
            rows = rows.withColumns({"c1": F.lit(0), "n1": F.lit(0), "d1": F.lit(0), "r1": F.lit(0.0)})
        else:
            rows = rows.withColumn("shorter", F.expr("substring(gram, 2)")).join(lower, "shorter")
        stats = rows.groupBy("context").agg(
            F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("d"), F.sum(F.when(F.col("c") > 0, F.col("c1")).otherwise(0)).alias("e")
        )
        rows = rows.join(stats, "context")
        if lower is None:
            escaped = F.log10(1 / (F.lit(SYMBOLS) - F.col("d")))
        else:
            left_n, left_d = F.col("n1") - F.col("e"), F.col("d1") - F.col("d")
            escaped = (
                F.when(F.col("c1") > 0, F.log10(F.try_divide(F.col("c1"), left_n + left_d)))
                .when(left_n + left_d > 0, F.log10(F.try_divide(left_d, left_n + left_d)) + F.col("r1"))
                .otherwise(F.col("r1"))
            )
        n, d = F.col("n"), F.col("d")
        rows = rows.withColumn("r", escaped)
        lp = F.when(F.col("c") > 0, F.log10(F.try_divide(F.col("c"), n + d))).when(n > 0, F.log10(F.try_divide(d, n + d)) + F.col("r")).otherwise(F.col("r"))
        rows = materialize(rows.select("gram", "c", "n", "d", "r", lp.alias("lp")), f"lm-probabilities-{k}")
        lower = rows.select(F.col("gram").alias("shorter"), F.col("c").alias("c1"), F.col("n").alias("n1"), F.col("d").alias("d1"), F.col("r").alias("r1"))
        # START is a context only at a unit's beginning: below the longest length only such grams are asked for
        asked = rows.select("gram", "lp") if k == order else rows.where(F.col("gram").startswith(START)).select("gram", "lp")
        out = asked if out is None else out.unionByName(asked)
    return out


def _code_lengths(units: DataFrame, order: int, block_units: int) -> DataFrame:
    """(unit, lp) of all units: log10 of the model's probability."""
    blocks = max(1, -(-units.count() // block_units))
    dealt = materialize(units.select("unit", "c", F.pmod(F.xxhash64("unit"), F.lit(blocks)).alias("block")).repartition("block"), "lm-blocks")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, part in batch.groupby("block"):
                counts: dict[str, int] = {}
                for unit, c in zip(part["unit"].tolist(), part["c"].tolist(), strict=True):
                    for g in grams_of(unit, order):
                        counts[g] = counts.get(g, 0) + c
                yield pd.DataFrame({"block": block, "gram": list(counts), "c": list(counts.values())})

    asked = dealt.mapInPandas(count, "block long, gram string, c long").groupBy("block", "gram").agg(F.sum("c").alias("c"))
    asked = materialize(asked, "lm-asked")
    trie = _trie(materialize(asked.groupBy("gram").agg(F.sum("c").alias("c")), "lm-grams"), order)
    answers = asked.select("block", "gram").join(trie, "gram")

    def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lp = dict(zip(right["gram"].tolist(), right["lp"].tolist(), strict=True))
        get = lp.__getitem__
        return pd.DataFrame({"unit": left["unit"], "lp": [sum(map(get, grams_of(u, order))) for u in left["unit"].tolist()]})

    return dealt.select("unit", "block").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(add, "unit string, lp double")


def score(docs: DataFrame, order: int = 5, head_units: int = 250_000, block_units: int = 60_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("trains", in_training("doc_id"))
    train_docs = rows.where("trains").count()
    units = materialize(_count_units(rows), "lm-units")
    base, end_log, _, train_tokens = _baseline(units, train_docs)
    values = units.join(_code_lengths(units, order, block_units), "unit").join(base, "unit", "left")
    values = materialize(values.select("unit", "c", "lp", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_tokens", "n_known")], F.coalesce("base", F.lit(0.0)).alias("base")), "lm-values")

    # the most frequent units, head_units at most, by steps of about a hundredth of their counts: there are some 4,000 steps
    step = F.floor(F.log2(F.col("c") + 1) * 64)
    least, held = math.inf, 0
    for r in values.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > head_units:
            break
        least = r["step"]
    top = values.where(step >= F.lit(least)).select("unit", "lp", "base", "n_tokens", "n_known").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((np.array(top["unit"].to_pylist(), object), np.column_stack([top[c].to_numpy().astype(np.float64) for c in top.column_names[1:]])))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        names, table = shared.value
        index = dict(zip(names.tolist(), range(len(names)), strict=True))
        table = np.vstack([table, np.zeros((1, 4))])
        get = index.get
        for batch in batches:
            out = []
            for doc_id, text, trains in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["trains"].tolist(), strict=True):
                units = units_of(text if isinstance(text, str) else None)
                at = np.fromiter(map(get, units, repeat(-1)), np.int64, len(units))
                sums = table[at].sum(axis=0)
                rest = Counter([units[k] for k in np.flatnonzero(at < 0).tolist()])
                out.append((uid, doc_id, not trains, len(text.encode()) if isinstance(text, str) else 0, *sums.tolist(), list(rest), list(rest.values())))
                uid += 1
            frame = pd.DataFrame(out, columns=["uid", "doc_id", "held_out", "n_bytes", "lp", "base", "n_tokens", "n_known", "rest", "times"])
            yield frame.assign(doc_id=batch["doc_id"].values)

    found = rows.mapInPandas(look_up, "uid long, doc_id long, held_out boolean, n_bytes long, lp double, base double, n_tokens double, n_known double, rest array<string>, times array<long>")
    found = materialize(found, "lm-looked-up")
    tail = found.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("uid", F.col("x.rest").alias("unit"), F.col("x.times").alias("times"))
    sums = tail.join(values.where(step < F.lit(least)).drop("c"), "unit").groupBy("uid").agg(*[F.sum(F.col(x) * F.col("times")).alias(f"t_{x}") for x in ("lp", "base", "n_tokens", "n_known")])
    whole = {x: F.col(x) + F.coalesce(f"t_{x}", F.lit(0)) for x in ("lp", "base", "n_tokens", "n_known")}
    return found.join(sums, "uid", "left").select(
        "doc_id",
        "held_out",
        (whole["n_tokens"] + 1).cast("long").alias("n_tokens"),
        (whole["n_known"] + F.lit(1 if train_docs else 0)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (whole["base"] + F.lit(end_log)).alias("base_score"),
        whole["lp"].alias("score"),
        "n_bytes",
    )
