"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, neardup, packing, secrets, tokens, toxicity
from terrane.session import fresh_names, materialize, table

#: Documents with this score or more are rejected as toxic.
TOXIC = 0.3


def _text_batches(spark: SparkSession) -> None:
    """Rows hold whole texts, so few of them go to a Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the model, learned from the labels of ``sf_dir``, scores as toxic."""
    _text_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (found,) = fresh_names(docs, 1)
    return toxicity.scored(docs, model, into=found).where(F.col(found)["score"] < TOXIC).drop(found)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group linked by 0.8 or more on shingles of five words."""
    _text_batches(spark)
    return neardup.deduplicated(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that share ten consecutive words, or a whole shorter item, with the benchmark."""
    _text_batches(spark)
    (hit,) = fresh_names(docs, 1)
    return decontaminate.flagged(docs, table(spark, sf_dir, "benchmark"), hit).where(~F.col(hit)).drop(hit)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark and brings the number of characters up to date."""
    # the other columns travel in a struct, so that none of their names can clash
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    found = secrets.scan(docs.select("doc_id", "text", rest.alias("rest")))
    changed = found.withColumn("text", secrets.redacted(F.col("text"), F.col("secret_spans")))
    n_chars = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("rest")["n_chars"])
    columns = {"text": F.col("text"), "n_chars": n_chars}
    return changed.select(*[columns.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens."""
    _text_batches(spark)
    return packing.pack(docs, tokens.vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Tokenizers and the toxicity model are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
