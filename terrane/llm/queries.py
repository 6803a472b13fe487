"""The thin queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, licenses, lmscore, merkle, neardup, packing, quality, secrets, substrings, tokenfiles, tokens, toxicity, vectorcodes, warc
from terrane.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"), end_id=2)


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), end_id=0)


OP4_SQL = """
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM sized),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, d.n, i, item_id FROM dwin d JOIN iwin b ON d.n = b.n AND d.win = b.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query("op4_decontaminate", OP4_SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("stratum", "n_lines", "n_distinct_words").withColumn("failed_rules", F.concat_ws(",", "failed_rules"))


@query("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model)
    score = F.col("toxicity.score")
    return found.select("doc_id", toxicity.is_held_out().alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted"), "toxicity.n_exact", "toxicity.n_fuzzy", "toxicity.n_quoted")


@query("op6_ppm_scores")
def op6_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    """Every rule as a list of its matches' spans: pieces between the matches give the starts."""
    ctes, unions = [], []
    for rank, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        ctes.append(
            f"r{rank} AS (SELECT doc_id, row_number() OVER () AS rid, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits, "
            f"regexp_extract_all(t, '{pattern}', {r.group}) AS checked FROM docs WHERE regexp_matches(t, '{pattern}'))"
        )
        unions.append(
            f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, "
            f"length(hits[i]) AS n, length(checked[i]) AS m, {r.least} AS least FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM r{rank})"
        )
    return (
        "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\n" + ",\n".join(ctes) + ",\nspans AS (" + "\nUNION ALL ".join(unions) + "),\n"
        "kept AS (SELECT doc_id, rank, kind, s, kind || ':' || s || ':' || (s + n) AS x FROM spans WHERE m >= least),\n"
        "joined AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
        "string_agg(x, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(x, ',' ORDER BY s, rank) AS spans FROM kept GROUP BY doc_id)\n"
        "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans "
        "FROM docs d LEFT JOIN joined USING (doc_id)"
    )


@query("op9_secret_scan", _op9_sql())
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["rank"] < len(secrets.BASE_RULES))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secret_spans")).alias("spans"))


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("license_scan")
    joined = [F.array_join(s[x], ",").alias(x) for x in ("base_labels", "labels")]
    plain = [s[x].alias(x) for x in ("n_words", "n_base", "first_word", "last_word", "score")]
    return licenses.scan(docs, licenses.inverse_frequencies(docs)).select("doc_id", *plain, *joined)


@query("op10_warc_derivatives")
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derivative_files(table(spark, sf_dir, "pages"))
    return found.select("page_id", "kind", "record_id", "refers_to", "target_uri", "block_digest", "source_digest", "n_bytes", "digest_ok", F.sha2("text", 256).alias("text_sha256"))


OP11_SQL = """
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS turn FROM windows) WHERE turn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
placed AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM split)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


@query("op11_substring_dedup", OP11_SQL)
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.without_repeats(table(spark, sf_dir, "documents"), window=20))


def _op12_sql(rounds: int = 4) -> str:
    """Plain Lloyd rounds, all distances worked out; integers of this size are exact as doubles."""
    ctes = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "cut AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS p))",
        "book0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM cut) WHERE e < 256)",
    ]
    for k in range(rounds + 1):
        far = "list_inner_product(c.x, c.x) + list_inner_product(b.x, b.x) - 2 * list_inner_product(c.x, b.x)"
        ctes.append(f"near{k} AS MATERIALIZED (SELECT vec_id, p, m.e AS e, m.d AS d, x FROM (SELECT vec_id, c.p AS p, any_value(c.x) AS x, min({{'d': {far}, 'e': b.e}}) AS m FROM cut c JOIN book{k} b ON c.p = b.p GROUP BY vec_id, c.p))")
        if k < rounds:
            means = f"SELECT p, e, list(c ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(y) / count(*)) AS c FROM (SELECT p, e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM near{k}) GROUP BY p, e, i) GROUP BY p, e"
            ctes.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.x, b.x) AS x FROM book{k} b LEFT JOIN ({means}) n USING (p, e))")
    ctes.append(f"done AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM book{rounds}))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM done JOIN kept USING (vec_id), digest"


@query("op12_vector_codes", _op12_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectorcodes.with_label_errors(vectorcodes.encoded(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


#: CRC-32 bit by bit over the id's digits; nodes of the trees level by level; a leaf's siblings by its index.
OP13_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g, text, lang, source, n_chars,
         n_chars + CASE WHEN xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1))))) % 7 = 0 THEN 1 ELSE 0 END AS other
  FROM documents
), leaves AS (
  SELECT doc_id, g, sha256(a || n || t) AS leaf, sha256(a || o || t) AS again
  FROM (SELECT doc_id, g,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n, coalesce(strlen(CAST(other AS VARCHAR)) || ':' || other, '-') AS o, coalesce(strlen(text) || ':' || text, '-') AS t FROM docs)
), placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree AS (
  SELECT g, 0 AS lvl, idx, leaf AS h, n FROM placed
  UNION ALL SELECT g, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lvl, idx // 2, n
), nodes AS MATERIALIZED (SELECT * FROM tree),
subs AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, subroot AS h, n FROM subs
  UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n
), tops AS MATERIALIZED (SELECT * FROM top),
steps AS MATERIALIZED (
  SELECT p.doc_id, p.leaf, p.idx, p.g, t.lvl AS k, (p.idx >> t.lvl) % 2 AS side, s.h AS sib
  FROM placed p JOIN (SELECT DISTINCT g, lvl, n FROM nodes) t ON t.g = p.g AND t.n > 1 LEFT JOIN nodes s ON s.g = p.g AND s.lvl = t.lvl AND s.idx = xor(p.idx >> t.lvl, 1)
  UNION ALL SELECT p.doc_id, p.leaf, p.idx, p.g, 1000 + t.lvl, (b.idx >> t.lvl) % 2, s.h
  FROM placed p JOIN subs b ON b.g = p.g JOIN (SELECT DISTINCT lvl, n FROM tops) t ON t.n > 1 LEFT JOIN tops s ON s.lvl = t.lvl AND s.idx = xor(b.idx >> t.lvl, 1)
), ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g, idx ORDER BY k) AS turn FROM steps),
fold AS (
  SELECT g, idx, 0 AS turn, again AS h FROM placed
  UNION ALL SELECT f.g, f.idx, f.turn + 1, sha256(CASE WHEN r.sib IS NULL THEN f.h WHEN r.side = 1 THEN r.sib || f.h ELSE f.h || r.sib END) FROM fold f JOIN ranked r ON r.g = f.g AND r.idx = f.idx AND r.turn = f.turn + 1
), folded AS (SELECT g, idx, arg_max(h, turn) AS folded_root FROM fold GROUP BY g, idx),
proofs AS (SELECT g, idx, sha256(coalesce(string_agg(sib, '' ORDER BY k), '')) AS proof_sha256 FROM ranked GROUP BY g, idx)
SELECT p.doc_id, p.leaf, b.subroot, r.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM placed p JOIN subs b USING (g) JOIN folded f ON f.g = p.g AND f.idx = p.idx LEFT JOIN proofs q ON q.g = p.g AND q.idx = p.idx, (SELECT h FROM tops WHERE n = 1) r
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(merkle.manifest(table(spark, sf_dir, "documents"), merkle.one_more()))
