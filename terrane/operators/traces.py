"""Roll-ups of request traces and evaluation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requests(events: DataFrame) -> DataFrame:
    """One row per request of (request_id, event, name, latency_ms, is_error): counts, latency sums and the tools used,
    the most used first."""
    tools = events.where("event = 'tool_call'").groupBy("request_id", "name").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("ms"))
    by_tool = tools.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "name"))), lambda x: F.concat_ws("=", x["name"], (-x["n"]).cast("string"))), ",").alias("tools"))
    totals = events.groupBy("request_id").agg(
        F.count_if(F.col("event") == "round_end").alias("rounds"), F.count_if(F.col("event") == "tool_call").alias("tool_calls"),
        F.count_if(F.col("is_error")).alias("errors"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency_ms"),
    )
    return totals.join(by_tool, "request_id", "left")


def axis_means(scores: DataFrame) -> DataFrame:
    """Mean score by axis over rows with an array ``scores`` of struct(axis, score); null scores don't count."""
    flat = scores.select(F.explode("scores").alias("s")).select("s.axis", "s.score")
    return flat.groupBy("axis").agg(F.avg("score").alias("mean_score"), F.count("score").alias("n_scores"))


def runs_with_scores(traces: DataFrame, scores: DataFrame) -> DataFrame:
    """Every trace with its score, if any, by prompt and run."""
    return traces.join(scores, ["prompt_id", "run"], "left")
