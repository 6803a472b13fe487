"""Toxicity scores from a lexicon, matched by Levenshtein automata on its trie, with context weights.

The lexicon holds seed terms and terms learned from labelled documents: whole words and word beginnings (stems) that are
far more frequent among toxic documents. All its Levenshtein automata are run at once as one deterministic automaton,
built lazily from sets of (trie node, edits): reading a word costs one step a character, and most words die after a few.
A hit counts by the term's weight, exact and misspelled hits apart, and less inside quotation marks or after a reporting
verb in its context window. A logistic model of the document's hits gives the score; it is fitted on out-of-fold
features, so that terms picked up by chance don't look better than they are.

Learning uses at most ``sample_toxic`` toxic and ``sample_clean`` clean labelled documents, taken by a hash of their ids;
nothing else of ids, labels, language or source is used. Scoring reads whole texts where they lie, without a shuffle.

Defined cases: null and empty texts get the score of a text without hits; labels given more than once count as toxic if
any is; with fewer than ``MIN_CLASS`` documents of a class the seed lexicon and preset coefficients are used; repeated
rows are scored each on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.memory import kept
from terrane.session import materialize

#: Common English insults.
SEED_TERMS = (
    "airhead", "bastard", "bigot", "clown", "coward", "creep", "cretin", "dimwit", "disgusting", "dumbass", "fool", "freak", "garbage",
    "idiot", "idiots", "imbecile", "jerk", "loser", "losers", "lowlife", "lunatic", "maggot", "moron", "morons", "nitwit", "parasite",
    "pathetic", "pervert", "psycho", "repulsive", "scum", "scumbag", "sicko", "stupid", "subhuman", "trash", "vermin", "vile", "worthless", "wretch",
)
#: Verbs that report what somebody else said.
REPORTING = frozenset("said says wrote writes called calls quoted quotes dijo dice escribió dit écrit disait sagte sagt schrieb".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_OPEN, _CLOSE = "\"'“”„«‘", "\"'”“»’"
MIN_CLASS = 8
STEM = range(4, 9)


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


#: An automaton with more states than this starts anew; one more word adds at most its length.
MOST_STATES = 150_000


class LexiconAutomaton:
    """The union of the terms' Levenshtein automata over their trie, made deterministic as words are read."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # most edits that a term below a node allows
        for k, t in enumerate(terms):
            node, edits = 0, allowed_edits(t.text)
            self.reach[0] = max(self.reach[0], edits)
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits)
            self.ends[node].append(k)
        self.forget()

    def forget(self) -> None:
        """Drop the states made so far; they are made again as words need them."""
        self.ids: dict[bytes, int] = {}
        self.sets: list[bytes] = []  # by state its trie nodes and edits so far, packed: 4 * node + edits
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple] = []
        self.start = self._state(self._close({0: 0}))

    def _close(self, state: dict[int, int]) -> dict[int, int]:
        """With terms' characters that the word leaves out."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and state.get(child, 99) > e + 1:
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return state

    def _state(self, state: dict[int, int]) -> int:
        if not state:
            return -1
        key = array("I", sorted([4 * node + e for node, e in state.items()])).tobytes()
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            found = [(k, e) for node, e in state.items() for k in self.ends[node] if e <= allowed_edits(self.terms[k].text)]
            best = lambda keep: max((x for x in found if keep(*x)), key=lambda x: (self.terms[x[0]].weight, -x[1]), default=None)
            self.accepts.append((
                best(lambda k, e: e == 0 and self.terms[k].stem), best(lambda k, e: e > 0 and self.terms[k].stem),
                best(lambda k, e: e == 0), best(lambda k, e: e > 0),
            ))
        return self.ids[key]

    def step(self, s: int, c: str) -> int:
        to = self.steps[s].get(c)
        if to is None:
            new: dict[int, int] = {}

            def put(node: int, e: int) -> None:
                if e <= self.reach[node] and new.get(node, 99) > e:
                    new[node] = e

            for x in array("I", self.sets[s]):
                node, e = x >> 2, x & 3
                put(node, e + 1)
                for label, child in self.children[node].items():
                    put(child, e if label == c else e + 1)
            to = self.steps[s][c] = self._state(self._close(new))
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best hit; exact before misspelled, then by weight."""
        if len(self.sets) > MOST_STATES:
            self.forget()
        s, exact, fuzzy = self.start, None, None
        weight = lambda x: self.terms[x[0]].weight
        for c in word:
            s = self.step(s, c)
            if s < 0:
                break
            a = self.accepts[s]
            if a[0] and (exact is None or weight(a[0]) > weight(exact)):
                exact = a[0]
            if a[1] and (fuzzy is None or weight(a[1]) > weight(fuzzy)):
                fuzzy = a[1]
        else:
            a = self.accepts[s]
            if a[2] and (exact is None or weight(a[2]) > weight(exact)):
                exact = a[2]
            if a[3] and (fuzzy is None or weight(a[3]) > weight(fuzzy)):
                fuzzy = a[3]
        return exact or fuzzy


class Matcher(dict):
    """Word to its hit (term, edits) or None; emptied at 150,000 words."""

    def __init__(self, terms: list[Term]):
        super().__init__()
        self.terms, self.automaton = terms, LexiconAutomaton(terms)

    def __missing__(self, word: str):
        if len(self) >= 150_000:
            self.clear()
        core = _EDGE.sub("", word)
        hit = self.automaton.match(core) if core else None
        if not core.isalpha() and (hit is None or hit[1]):
            plain = word.translate(_LEET)
            other = self.automaton.match(_EDGE.sub("", plain)) if any(c.isalpha() for c in core) else None
            if other and (hit is None or other[1] < hit[1]):
                hit = other[0], max(1, other[1])  # a spelling with digits or signs is a misspelling
        self[word] = hit
        return hit

    def features(self, text: str | None, window: int) -> tuple[float, ...]:
        words = text.lower().split() if text else []
        exact = fuzzy = most = 0.0
        n_exact, n_fuzzy, n_quoted, kinds = 0, 0, 0, set()
        for at, hit in [(k, h) for k, h in enumerate(map(self.__getitem__, words)) if h is not None]:
            term = self.terms[hit[0]]
            share, quoted = context_weight(words, at, window)
            n_quoted += quoted
            if hit[1]:
                fuzzy += term.weight * share / hit[1]
                n_fuzzy += 1
            else:
                exact += term.weight * share
                most = max(most, term.weight * share)
                n_exact += 1
                kinds.add(words[at])
        rate = 100 * exact / max(len(words), 20)
        return (math.log1p(exact), math.log1p(fuzzy), math.log1p(rate), most, math.log1p(len(kinds)), n_exact, n_fuzzy, n_quoted)


MODELLED = 5  # the first features, which the model uses


def context_weight(words: list[str], at: int, window: int) -> tuple[float, bool]:
    """How much a hit counts: less inside quotation marks or after a reporting verb within the window."""
    before, after = words[max(0, at - window) : at + 1], words[at : at + window + 1]
    opened = any(w[0] in _OPEN for w in before)
    if opened and any(w.rstrip(".,;:!?")[-1:] in _CLOSE and w.rstrip(".,;:!?") for w in after):
        return 0.25, True
    if any(w.strip(".,:;") in REPORTING for w in before[:-1]):
        return 0.5, True
    return 1.0, False


@dataclass
class ToxicityModel:
    terms: list[Term]
    coefficients: list[float] = field(default_factory=lambda: [-4.0, 1.2, 0.6, 0.8, 0.2, 0.5])
    window: int = 6
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.coefficients[0] + features[:, :MODELLED] @ np.array(self.coefficients[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _normal(word: str) -> str:
    return _EDGE.sub("", word)


def learn_terms(counts: list[tuple[str, bool, int, int]], toxic: int, clean: int, most: int) -> list[Term]:
    """Terms from (text, stem, toxic documents, clean documents) counts, and the seeds.

    A term needs three toxic documents and a log-odds ratio of 1.5 that is three standard errors above 0; those that a
    stem of nearly their weight begins are left out; the ``most`` strongest stay.
    """
    weigh = lambda t, n: math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
    found = []
    for text, stem, t, n in counts:
        w = weigh(t, n)
        if t >= 3 and w >= 1.5 and w / math.sqrt(1 / (t + 0.5) + 1 / (n + 0.5)) >= 3:
            found.append(Term(text, stem, min(w, 8.0)))
    found.sort(key=lambda x: (len(x.text), not x.stem, x.text))
    stems: dict[str, float] = {}
    kept = []
    for term in found:
        covered = max((stems[term.text[:k]] for k in STEM if term.text[:k] in stems), default=-1.0)
        if covered >= term.weight - 0.5:
            continue
        kept.append(term)
        if term.stem:
            stems[term.text] = term.weight
    kept.sort(key=lambda x: (-x.weight, x.text, x.stem))
    kept = kept[:most]
    known = {t.text for t in kept}
    seen = {text: (t, n) for text, stem, t, n in counts if not stem}
    for text in SEED_TERMS:
        if text not in known:
            t, n = seen.get(text, (0, 0))
            w = min(6.0, weigh(t + 3, n)) if toxic and clean else 4.0
            if w > 0.5:
                kept.append(Term(text, False, w))
    return kept


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton's method with halved steps; no coefficient of a hit is negative."""
    x = np.hstack([np.ones((len(features), 1)), features[:, :MODELLED]])
    penalty = ridge * np.array([0.01, *[1.0] * MODELLED])
    active, w = np.ones(x.shape[1], bool), np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - labels @ z + 0.5 * (penalty * v * v).sum())

    for _ in range(MODELLED + 1):
        best = loss(w)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = (x.T @ (labels - p) - penalty * w)[active]
            hessian = (x[:, active] * (p * (1 - p))[:, None]).T @ x[:, active] + np.diag(penalty[active])
            step = np.zeros_like(w)
            step[active] = np.linalg.solve(hessian, gradient)
            while np.abs(step).max() > 1e-8 and not loss(w + step) < best:
                step /= 2
            if np.abs(step).max() <= 1e-8:
                break
            w, best = w + step, loss(w + step)
        negative = active & (w < 0) & (np.arange(len(w)) > 0)
        if not negative.any():
            break
        active &= ~negative
        w[negative] = 0
    return w.tolist()


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_toxic: int = 4000,
    sample_clean: int = 8000,
    max_terms: int = 2000,
    window: int = 6,
) -> ToxicityModel:
    """The model, learned from labelled documents outside the held-out quarter.

    ``sample_toxic`` and ``sample_clean`` bound the labelled texts, ``max_terms`` the learned words and stems each (chosen
    from the ten times as many of highest log odds, which is what reaches the driver).
    """
    known = labels.where(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known.withColumn("turn", F.xxhash64("doc_id"))
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy("turn", "doc_id").limit(n)
    # bounded by the two parameters, so it may be broadcast
    sample = pick(1, sample_toxic).unionByName(pick(0, sample_clean)).withColumn("fold", F.pmod("turn", F.lit(2)).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", "fold")
    texts = materialize(texts, "toxicity-sample")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    if min((sum(n for (_, y), n in sizes.items() if y == k) for k in (0, 1)), default=0) < MIN_CLASS:
        return ToxicityModel([Term(t, False, 4.0) for t in SEED_TERMS], window=window)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for text, y, fold in zip(batch["text"], batch["toxic"], batch["fold"], strict=True):
                words = {_normal(w) for w in set(text.lower().split())} - {""} if isinstance(text, str) else set()
                stems = {w[:k] for w in words for k in STEM if len(w) > k}
                for stem, part in ((False, words), (True, stems)):
                    for w in part:
                        counts.setdefault((w, stem), [0, 0, 0, 0])[2 * fold + y] += 1
                if len(counts) > 60_000:
                    yield frame(counts)
                    counts = {}
        yield frame(counts)

    def frame(counts: dict) -> pd.DataFrame:
        return pd.DataFrame([(w, s, *c) for (w, s), c in counts.items()], columns=["term", "stem", "n0", "t0", "n1", "t1"])

    total = texts.mapInPandas(count, "term string, stem boolean, n0 long, t0 long, n1 long, t1 long").groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")])
    odds = (F.col("t0") + F.col("t1") + 0.5) / (F.col("n0") + F.col("n1") + 0.5)
    ranked = total.where("t0 + t1 >= 3").orderBy(F.desc(odds * F.log1p(F.col("t0") + F.col("t1"))), "term", "stem")
    seeds = total.where(F.col("term").isin(*SEED_TERMS) & ~F.col("stem"))
    rows = {(r["term"], r["stem"]): r for r in [*ranked.limit(10 * max_terms).collect(), *seeds.collect()]}.values()

    def terms(folds: tuple[int, ...]) -> list[Term]:
        counts = [(r["term"], r["stem"], sum(r[f"t{f}"] for f in folds), sum(r[f"n{f}"] for f in folds)) for r in rows]
        return learn_terms(counts, sum(sizes.get((f, 1), 0) for f in folds), sum(sizes.get((f, 0), 0) for f in folds), max_terms)

    other = [terms((1,)), terms((0,))]  # by the fold that is scored

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = [Matcher(t) for t in other]
        for batch in batches:
            x = [matchers[f].features(t if isinstance(t, str) else None, window) for t, f in zip(batch["text"], batch["fold"], strict=True)]
            yield pd.DataFrame([r[:MODELLED] for r in x], columns=[f"x{k}" for k in range(MODELLED)]).assign(y=batch["toxic"].astype(float).values)

    got = texts.mapInPandas(featured, ", ".join(f"x{k} double" for k in range(MODELLED)) + ", y double").toPandas().to_numpy()
    return ToxicityModel(terms((0, 1)), fit(got[:, :MODELLED], got[:, MODELLED]), window)


RESULT = "struct<score: double, n_exact: long, n_fuzzy: long, n_quoted: long>"


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with the struct column ``into``, in place of any of that name: score, exact, misspelled and quoted hits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_terms and the seeds

    @F.pandas_udf(RESULT)
    def score(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        matcher = kept(("toxicity", m.key), lambda: Matcher(m.terms))
        x = np.array([matcher.features(t if isinstance(t, str) else None, m.window) for t in texts.tolist()]).reshape(-1, MODELLED + 3)
        return pd.DataFrame({"score": m.score(x), "n_exact": x[:, MODELLED], "n_fuzzy": x[:, MODELLED + 1], "n_quoted": x[:, MODELLED + 2]}).astype({"n_exact": "int64", "n_fuzzy": "int64", "n_quoted": "int64"})

    return docs.withColumn(into, score(F.col(text_col)))
