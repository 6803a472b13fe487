"""Secret scans with a trigram inverted index, by DataFrame functions only.

``trigram_query`` derives from a rule's regular expression a Boolean query over trigrams that every match must satisfy.
The index has a posting (trigram, document key) for each trigram that some query names; intersecting a query's postings
gives the documents that may match, and only those are verified by the expression itself. Rules without mandatory
trigrams scan all texts. Candidates are joined to the texts by broadcast as long as there are at most
``broadcast_candidates``, else by a shuffle.

Matches are leftmost and do not overlap, per rule; those that fail a rule's length are dropped after matching.

Defined cases: null and empty texts have no matches; equal rows (id and text) share their postings and are each
reported; a null id is a key like any other; other columns are kept by ``scan`` and may have any name that does not
begin with ``secret_``; an empty table gives no rows.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import fresh_names, materialize

Query = tuple  # ("tri", t) | ("and", [Query]) | ("or", [Query]) | ("all",)
ALL: Query = ("all",)
_MOST_STRINGS = 24


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  #: least length of ``group``
    group: int = 0


#: The base kinds, in their order, and further kinds of well-known shapes.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", "(?i:(password|passwd|secret|token|api_?key))" + ASSIGN[ASSIGN.index(")") + 1 :], 12, 2),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/@]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES


def _and(parts: list[Query]) -> Query:
    flat = []
    for p in parts:
        for q in p[1] if p[0] == "and" else [p]:
            if q != ALL and q not in flat:
                flat.append(q)
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _or(parts: list[Query]) -> Query:
    if ALL in parts or not parts:
        return ALL
    needs = lambda q: {repr(x) for x in (q[1] if q[0] == "and" else [q])}
    kept: list[Query] = []
    for p in sorted(parts, key=lambda q: len(needs(q))):  # what another alternative already allows adds nothing
        if not any(needs(q) <= needs(p) for q in kept):
            kept.append(p)
    return kept[0] if len(kept) == 1 else ("or", kept)


def _of_strings(strings: set[str]) -> Query:
    """What a text that holds one of the strings must have."""
    return _or([_and([("tri", s[k : k + 3]) for k in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """The strings (lowered) that the part can be, if few, and a query that any match satisfies."""
    queries: list[Query] = []
    run = {""}
    whole = True

    def flush() -> None:
        nonlocal run, whole
        queries.append(_of_strings(run))
        run, whole = {""}, False

    for op, arg in parsed:
        strings, query = None, ALL
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 6:
            strings = {chr(v).lower() for _, v in arg}
        elif op is sre.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is sre.BRANCH:
            found = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in found):
                strings = set().union(*[s for s, _ in found])
            else:
                query = _or([_of_strings(s) if s is not None else q for s, q in found])
        elif op is sre.MAX_REPEAT:
            low, high, body = arg
            inner, inner_query = _walk(body)
            if (low, high) == (0, 1) and inner is not None:
                strings = inner | {""}
            elif low == high and inner is not None and len(inner) == 1 and low <= 8:
                strings = {next(iter(inner)) * low}
            elif low >= 1:
                query = _of_strings(inner) if inner is not None else inner_query
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        flush()
        if strings is not None and len(strings) <= _MOST_STRINGS:
            run = set(strings)
        else:
            queries.append(query)
    if whole:
        return run, _of_strings(run)
    flush()
    return None, _and(queries)


def trigram_query(pattern: str) -> Query:
    """A query over lowered trigrams that holds for any text with a match; ``("all",)`` where none are mandatory."""
    strings, query = _walk(sre_parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def trigrams(query: Query) -> list[str]:
    if query[0] == "tri":
        return [query[1]]
    return sorted({t for q in (query[1] if len(query) > 1 else []) for t in trigrams(q)})


def query_column(query: Query, has) -> Column:
    """The query as a condition; ``has(trigram)`` says whether the document is in the trigram's postings."""
    if query[0] == "tri":
        return has(query[1])
    if query == ALL:
        return F.lit(True)
    parts = [query_column(q, has) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def bound(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def build_index(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules' queries name."""
    named = sorted({t for r in rules for t in trigrams(trigram_query(r.pattern))})
    found = bound(F.lower(F.col(text_col)), lambda low: F.filter(F.array(*[F.lit(t) for t in named]), lambda t: F.contains(low, t)))
    rows = docs.where(F.col(text_col).isNotNull()).select(document_key(id_col, text_col).alias("key"), found.alias("found"))
    return rows.select(F.explode("found").alias("trigram"), "key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(key, rules): the documents in the intersection of a rule's postings, with the kinds to verify."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    named = sorted({t for q in queries.values() for t in trigrams(q)})
    at = {t: k for k, t in enumerate(named)}
    words = -(-len(named) // 62)
    masks = []
    for w in range(words):
        bit = F.lit(0).cast("long")
        for t, k in at.items():
            if k // 62 == w:
                bit = F.when(F.col("trigram") == t, F.lit(1 << (k % 62)).cast("long")).otherwise(bit)
        masks.append(F.bit_or(bit).alias(f"m{w}"))
    joined = index.groupBy("key").agg(*masks)
    has = lambda t: F.col(f"m{at[t] // 62}").bitwiseAND(F.lit(1 << (at[t] % 62)).cast("long")) != 0
    kinds = F.filter(F.array(*[F.when(query_column(q, has), F.lit(k)) for k, q in queries.items() if q != ALL]), lambda x: x.isNotNull())
    return joined.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """The rule's matches in a text, found by cutting the text at them and adding up the lengths."""
    pattern = F.lit(rule.pattern)

    def collect(cut: Column) -> Column:
        matches = F.regexp_extract_all(text, pattern, F.lit(0))
        checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
        rows = F.arrays_zip(F.slice(cut, 1, F.size(cut) - 1).alias("gap"), matches.alias("match"), checked.alias("checked"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

        def add(state: Column, x: Column) -> Column:
            begin = state["at"] + F.length(x["gap"])
            end = begin + F.length(x["match"])
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            return F.struct(end.alias("at"), F.when(F.length(x["checked"]) >= rule.least, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(rows, start, add, lambda s: s["spans"])

    return F.when(text.rlike(rule.pattern), bound(F.split(text, rule.pattern, -1), collect)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, rules=RULES, broadcast_candidates: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``, in place of any of that name: all matches by start, then rank of the rule (code
    points, end exclusive)."""
    key, kinds = fresh_names(docs, 2)
    found = materialize(candidates(build_index(docs, rules, id_col, text_col), rules), "secret-candidates")
    found = found.toDF(key, kinds)
    if found.count() <= broadcast_candidates:
        found = F.broadcast(found)
    keyed = docs.withColumn(key, document_key(id_col, text_col)).join(found, key, "left")
    text, parts = F.coalesce(F.col(text_col), F.lit("")), []
    for rank, rule in enumerate(rules):
        spans = spans_of(rule, rank, text)
        if trigram_query(rule.pattern) != ALL:
            spans = F.when(F.array_contains(kinds, rule.kind), spans).otherwise(F.array().cast(SPAN))
        parts.append(spans)
    return keyed.withColumn("secret_spans", F.array_sort(F.concat(*parts))).drop(key, kinds)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each merged span replaced by the mark; a text without spans stays as it is."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return (
            F.when(s["start"] >= state["at"], F.struct(s["end"].alias("at"), F.array_append(state["parts"], piece).alias("parts")))
            .otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["parts"].alias("parts")))
        )

    whole = F.aggregate(spans, start, add, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
