"""License scans by a positional rare-token index, by DataFrame functions only.

Templates (short notices and the opening of full texts) are indexed by word: posting (template, position). Document
frequencies of the templates' words are counted over all documents. In a file, each template's own words of highest IDF
are looked up; each occurrence at p with a posting at q votes for the template lying at p - q, and templates whose votes
agree on an offset are verified by their mandatory key phrase at that place. Phrases that name a licence family outright
are found besides, wherever their words stand next to each other.

Defined cases: null and empty texts have no words, no label and score 0; equal offsets and repeated rows are judged alike;
ties between templates keep both labels; other columns are kept, whatever their names (but for one of the result's name);
an empty table gives no rows (and all IDFs are equal).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import fresh_names

#: Phrases that name a family.
FAMILIES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, notice, mandatory key phrase.
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit-notice", "released under the mit license", "under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("lgpl", "this work is licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "this work is licensed under the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms with or without modification"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright and related or neighboring rights"),
    ("all-rights", "copyright all rights reserved", "all rights reserved"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, notice, _ in templates for w in notice.split()})


def inverse_frequencies(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[str, float]:
    """IDF of each template word over all documents; one count a word reaches the driver."""
    vocab = vocabulary(templates)
    held = F.array_intersect(words_of(lowered(F.col(text_col))), F.array(*[F.lit(w) for w in vocab]))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    n, found = docs.count(), {r["word"]: r["count"] for r in counts}
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) for w in vocab}


def _literal_map(entries: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])


def scan(docs: DataFrame, idf: dict[str, float], rare: int = 8, templates=TEMPLATES, text_col: str = "text", into: str = "license_scan") -> DataFrame:
    """``docs`` with n_words, base places, labels and score in the struct column ``into``, in place of any of that name.

    ``rare``: so many of each template's words in the file are looked up, those of highest IDF. A template is verified
    when at least half as many votes as it has looked-up words agree on an offset.
    """
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, (_, notice, _) in enumerate(templates):
        for q, w in enumerate(notice.split()):
            postings.setdefault(w, []).append((k, q))
    ranked = sorted(postings, key=lambda w: (-idf[w], w))
    rank = {w: r for r, w in enumerate(ranked)}
    # a template is only verified with its whole mandatory phrase, so a file without the phrase's rarest word can't hold it
    openers = sorted({min(phrase.split(), key=lambda w: (rank.get(w, -1), w)) for _, _, phrase in templates} | {f.split()[-1] for f in FAMILIES})
    pair = "array<struct<t:int,q:int>>"
    table = _literal_map({w: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in p]).cast(pair) for w, p in postings.items()})
    ranks = _literal_map({w: F.lit(r) for w, r in rank.items()})
    own = F.array(*[F.array(*[F.lit(r) for r in sorted(rank[w] for w in set(n.split()))]) for _, n, _ in templates])
    sizes = F.array(*[F.lit(len(set(n.split()))) for _, n, _ in templates])
    lengths = F.array(*[F.lit(len(n.split())) for _, n, _ in templates])
    phrases = F.array(*[F.lit(f" {p} ") for _, _, p in templates])
    labels = F.array(*[F.lit(x) for x, _, _ in templates])
    vote = "struct<t:int,off:int,n:int>"

    def places(words: Column) -> Column:
        """(start, label) of the families' phrases."""

        def of(phrase: str, label: str) -> Column:
            parts = phrase.split()
            first = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
            stands = F.filter(first, lambda i: F.array_join(F.slice(words, i + 1, len(parts)), " ") == phrase)
            return F.transform(stands, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

        return F.concat(*[of(phrase, label) for phrase, label in FAMILIES.items()])

    def matches(words: Column) -> Column:
        """(label, share) of the verified templates."""
        seen = F.filter(F.transform(words, lambda w, i: F.struct(F.element_at(ranks, w).alias("r"), i.alias("i"), w.alias("w"))), lambda x: x["r"].isNotNull())

        def look_up(seen: Column) -> Column:
            here = F.array_distinct(F.transform(seen, lambda x: x["r"]))
            # by template: the last rank that is looked up, and how many are
            chosen = bound(here, lambda h: F.transform(own, lambda o: F.slice(F.array_intersect(o, h), 1, rare)))
            return bound(F.transform(chosen, lambda c: F.struct(F.coalesce(F.array_max(c), F.lit(-1)).alias("last"), F.size(c).alias("n"))), lambda top: votes(seen, top))

        def votes(seen: Column, top: Column) -> Column:
            postings_of = lambda x: F.filter(F.element_at(table, x["w"]), lambda p: x["r"] <= F.element_at(top, p["t"] + 1)["last"])
            each = F.flatten(F.transform(seen, lambda x: F.transform(postings_of(x), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["q"]).alias("off")))))
            start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("off"), F.lit(0).alias("n"), F.array().cast(f"array<{vote}>").alias("done"))
            close = lambda s: F.when(s["n"] >= 2, F.array_append(s["done"], F.struct(s["t"].alias("t"), s["off"].alias("off"), s["n"].alias("n")))).otherwise(s["done"])
            run = F.aggregate(
                F.array_sort(each),
                start,
                lambda s, x: F.when(
                    (s["t"] == x["t"]) & (s["off"] == x["off"]),
                    F.struct(s["t"].alias("t"), s["off"].alias("off"), (s["n"] + 1).alias("n"), s["done"].alias("done")),
                ).otherwise(F.struct(x["t"].alias("t"), x["off"].alias("off"), F.lit(1).alias("n"), close(s).alias("done"))),
                close,
            )
            return bound(run, lambda found: F.transform(F.filter(found, lambda v: verified(v, top)), lambda v: F.struct(F.element_at(labels, v["t"] + 1).alias("label"), share(v).alias("share"))))

        def share(v: Column) -> Column:
            return F.least(F.lit(1.0), v["n"].cast("double") / F.least(F.element_at(sizes, v["t"] + 1), F.lit(rare)))

        def verified(v: Column, top: Column) -> Column:
            # an offset may lie before the text's start, where a notice is cut
            begin = F.greatest(v["off"], F.lit(0))
            near = F.concat(F.lit(" "), F.array_join(F.slice(words, begin + 1, F.element_at(lengths, v["t"] + 1)), " "), F.lit(" "))
            return (2 * v["n"] >= F.element_at(top, v["t"] + 1)["n"]) & F.contains(near, F.element_at(phrases, v["t"] + 1))

        return bound(seen, look_up)

    low_, found_, words_ = fresh_names(docs, 3)
    low = F.col(low_)
    opened = low.rlike("|".join(openers))
    nothing = F.struct(F.array().cast("array<struct<at:int,label:string>>").alias("places"), F.array().cast("array<struct<label:string,share:double>>").alias("matches"))
    found = F.when(opened, bound(words_of(low), lambda ws: F.struct(places(ws).alias("places"), matches(ws).alias("matches")))).otherwise(nothing)
    out = docs.withColumn(low_, lowered(F.col(text_col))).withColumn(found_, found).withColumn(words_, F.regexp_count(low, F.lit(WORD)).cast("long"))
    hits, places_of = F.col(found_)["matches"], F.col(found_)["places"]
    at = F.transform(places_of, lambda x: x["at"])
    base = F.array_sort(F.array_distinct(F.transform(places_of, lambda x: x["label"])))
    more = F.transform(hits, lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform(hits, lambda x: x["share"])), F.lit(0.0))
    scan = F.struct(
        F.col(words_).alias("n_words"),
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        base.alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, more))).alias("labels"),
        F.greatest(best, F.when(F.size(at) > 0, 0.5).otherwise(0.0)).alias("score"),
    )
    return out.withColumn(into, scan).drop(low_, found_, words_)
