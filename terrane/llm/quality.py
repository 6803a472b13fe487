"""Quality rules with risk-controlled thresholds.

Each rule compares one measure of a text with a cutoff. The rules are tightened together, along one path of steps: a step
makes one rule's cutoff stricter, and those steps come first that reject most bad documents for each good one. The path is
learned from a fifth of the labelled documents, by a hash of their ids, and fixed before the others are looked at. These
are the holdouts: per stratum (language), the share of good documents that all rules together reject at a step has an exact
(Clopper-Pearson) binomial upper bound; steps are tested in their order, and the last one before the first whose bound
exceeds ``risk`` is taken (a fixed sequence of tests, so no correction is needed along it, and none for the rules). The
error level is divided by the number of strata (Bonferroni), so with probability 1 - ``error`` every stratum loses at most
``risk`` of its good documents to the rules. Only strata with so many good holdouts that a step can pass at all are
tested and counted; the others have no cutoffs.

Defined cases: null text has no words (all measures 0); a document without words is rejected by the base rule; labels of
a document given more than once count as one, good if any says so; a null stratum is a stratum of its own; repeated
documents are judged row by row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import fresh_names, materialize

MEASURES = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct_words long"
_BLANK = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: One labelled document in so many helps to find the path.
PATH_SHARE = 5


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words in windows of three that occur twice or more; ``ids`` are below ``kinds`` (at most two million)."""
    if len(ids) < 4:
        return 0
    keys = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(ids), bool)
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    for j in range(3):
        hit[at + j] = True
    return int(hit.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES`` from n_words on."""
    if not text:
        return (0, 0, 0, 0, 0, 0, 0)
    words = text.encode("utf-8").split()
    n = len(words)
    kinds: dict[bytes, int] = {}
    ids = np.array([kinds.setdefault(w, len(kinds)) for w in words], np.int64)
    if len(kinds) > 2_000_000:
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
        repeats = len(hit)
    else:
        repeats = repeated_words(ids, len(kinds))
    lines = text.split("\n")
    duplicates = 0
    if len(lines) > 1:
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                duplicates += bool(line.strip(_BLANK))
            else:
                seen.add(line)
    chars = len(text) - sum(map(text.count, _BLANK))
    return (n, chars, sum(map(text.count, _SYMBOLS)), duplicates, repeats, len(lines), len(kinds))


def measures(docs: DataFrame, stratum_col: str | None = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures per row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MEASURES.split(", ")]
        for batch in batches:
            rows = [measure_text(t if isinstance(t, str) else None) for t in batch["text"].tolist()]
            out = pd.DataFrame(rows, columns=names[2:], dtype="int64")
            out.insert(0, "doc_id", batch["doc_id"].values)
            out.insert(1, "stratum", batch["stratum"].values)
            yield out

    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), F.col(text_col).alias("text")).mapInPandas(run, MEASURES)


@dataclass(frozen=True)
class Rule:
    """Reject where ``top / bottom`` (0 for an empty bottom) is above a cutoff; ``cutoffs`` from the mildest on."""

    name: str
    top: str
    bottom: str
    cutoffs: tuple[float, ...]

    def value(self) -> Column:
        return F.coalesce(F.try_divide(F.expr(self.top).cast("double"), F.expr(self.bottom).cast("double")), F.lit(0.0))


_SHARES = tuple(k / 100 for k in range(95, 0, -5))
#: The rules of production: symbols a character, duplicate lines, repeated windows, word kinds, long and short words.
RULES = (
    Rule("symbols", "n_symbols", "word_chars", tuple(k / 100 for k in range(60, 0, -2))),
    Rule("dup_lines", "n_dup_lines", "n_lines", _SHARES),
    Rule("repeats", "n_repeat_words", "n_words", _SHARES),
    Rule("few_kinds", "n_words - n_distinct_words", "n_words", _SHARES),
    Rule("long_words", "word_chars", "n_words", tuple(float(k) for k in range(40, 8, -2))),
)


def upper_bound(rejected: int, n: int, error: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a proportion, by bisection on the binomial distribution's tail."""
    if rejected >= n:
        return 1.0

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(rejected + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = rejected / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid <= 0 or mid < 1 and tail(mid) > error:
            low = mid
        else:
            high = mid
    return high


def strictest(rejected: list[int], n: int, risk: float, error: float) -> int | None:
    """The index of the last cutoff before the first that isn't shown to reject at most ``risk``."""
    best = None
    for k, r in enumerate(rejected):
        if n == 0 or r > risk * n or upper_bound(r, n, error) > risk:
            break
        best = k
    return best


def is_for_path(id_col: str = "doc_id") -> Column:
    """Whether a labelled document helps to find the path; all others are holdouts."""
    return F.crc32(F.col(id_col).cast("string")) % PATH_SHARE == 0


def reached(rule: Rule) -> Column:
    """How many of a rule's cutoffs a row stays below: the rule rejects it from the cutoff of that index on."""
    return sum((F.when(rule.value() <= c, 1).otherwise(0) for c in rule.cutoffs), F.lit(0))


def path_of(good: dict[str, list[int]], bad: dict[str, list[int]]) -> list[tuple[str, int]]:
    """Steps (rule, index of its cutoff) from counts of rows by the number of cutoffs that they stay below.

    Of all stricter cutoffs that reject more bad rows, the one with most of them for each further good one comes next; of
    equal ones that of the first rule and the mildest cutoff.
    """
    total = lambda counts, k: sum(counts[: k + 1])  # noqa: E731 - rows that the cutoff of index k rejects
    at, path = dict.fromkeys(good, -1), []
    while True:
        moves = []
        for place, (rule, held) in enumerate(at.items()):
            for k in range(held + 1, len(bad[rule]) - 1):
                more = total(bad[rule], k) - (total(bad[rule], held) if held >= 0 else 0)
                lost = total(good[rule], k) - (total(good[rule], held) if held >= 0 else 0)
                if more > 0:
                    moves.append((-more / (lost + 0.5), place, k, rule))
        if not moves:
            return path
        _, _, k, rule = min(moves)
        at[rule] = k
        path.append((rule, k))


def testable(counts: list[int], risk: float, error: float) -> int:
    """The least number of good holdouts of a stratum for which a test can pass, all such strata sharing the error."""
    ordered = sorted(counts, reverse=True)
    need = lambda m: math.log(max(1, m) / error) / -math.log1p(-risk)
    m = max([k for k, n in enumerate(ordered, 1) if n >= need(k)], default=1)
    return math.ceil(need(m))


def thresholds(measured: DataFrame, labels: DataFrame, rules=RULES, risk: float = 0.02, error: float = 0.05) -> dict[tuple[str | None, str], float]:
    """Cutoffs by (stratum, rule), learned from all labelled documents.

    The driver gets counts by rule and cutoff, and by stratum and step, of strata that have enough good documents for any
    step at all, so their number is bounded by that of labels.
    """
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("good"))
    levels = [reached(r).alias(f"below_{k}") for k, r in enumerate(rules)]
    held = measured.join(marks, "doc_id").where("good IN (0, 1)").select("stratum", "good", is_for_path().alias("for_path"), *levels)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"below_{k}").alias("below")) for k in range(len(rules))])).alias("x")
    shown = held.where("for_path").select("good", each).groupBy("good", "x.rule", "x.below").count().collect()
    counts = {g: {r.name: [0] * (len(r.cutoffs) + 1) for r in rules} for g in (0, 1)}
    for row in shown:
        counts[row["good"]][rules[row["rule"]].name][row["below"]] = row["count"]
    path = path_of(counts[1], counts[0])
    if not path:
        return {}
    # the first step at which each rule rejects a row, by the number of cutoffs that it stays below
    firsts = []
    for k, r in enumerate(rules):
        steps = [next((t for t, (name, index) in enumerate(path) if name == r.name and index >= below), len(path)) for below in range(len(r.cutoffs) + 1)]
        firsts.append(F.element_at(F.array(*[F.lit(t) for t in steps]), F.col(f"below_{k}") + 1))
    good = held.where("NOT for_path AND good = 1").select("stratum", F.least(*firsts).alias("first"))
    enough = math.log(1 / error) / -math.log1p(-risk)
    # the sum is over the counts by step, of which a stratum has no more than steps
    whole = F.sum("count").over(Window.partitionBy("stratum"))
    by_step = good.groupBy("stratum", "first").count().withColumn("n", whole).where(F.col("n") >= enough).collect()
    sizes = {row["stratum"]: row["n"] for row in by_step}
    least = testable(list(sizes.values()), risk, error)
    sizes = {x: n for x, n in sizes.items() if n >= least}
    rejected = {x: [0] * (len(path) + 1) for x in sizes}
    for row in by_step:
        if row["stratum"] in sizes:
            rejected[row["stratum"]][row["first"]] = row["count"]
    found = {}
    for x, n in sizes.items():
        k = strictest(np.cumsum(rejected[x][:-1]).tolist(), n, risk, error / len(sizes))
        for rule, index in path[: 0 if k is None else k + 1]:
            found[x, rule] = next(r for r in rules if r.name == rule).cutoffs[index]
    return found


def judge(measured: DataFrame, cutoffs: dict[tuple[str | None, str], float], rules=RULES) -> DataFrame:
    """The measures with base_failed, failed_rules and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # one row a stratum with cutoffs; strata are few (no more than labels can vouch for), and the size is bounded by theirs
    by_stratum: dict[str | None, dict[str, float]] = {}
    for (stratum, name), c in cutoffs.items():
        by_stratum.setdefault(stratum, {})[name] = c
    at, held = fresh_names(measured, 2)
    table = measured.sparkSession.createDataFrame(list(by_stratum.items()), f"{at} string, {held} map<string,double>")
    columns, failed = measured.columns, []
    measured = measured.join(F.broadcast(table) if len(by_stratum) <= 10_000 else table, F.col("stratum").eqNullSafe(F.col(at)), "left")
    for r in rules:
        failed.append(F.when(r.value() > F.element_at(F.col(held), F.lit(r.name)), F.lit(r.name)))
    rejected = F.filter(F.array(*failed), lambda x: x.isNotNull())
    return measured.select(*columns, base.alias("base_failed"), rejected.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Measures and verdicts of all documents; the measures (numbers only) are written once and read twice."""
    measured = materialize(measures(docs), "quality-measures")
    return judge(measured, thresholds(measured, labels, risk=risk, error=error))
