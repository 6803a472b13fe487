"""Requests folded from their trace events, round by round: of a table at once, of a stream with state.

Events have (request_id, event, round_i, latency_ms, is_error, ts): a round's tools are its "tool_call" events, its own
time that of "round_end"; "request_end" ends a request. A stream's request is given out once the watermark is ``wait`` past
its last event, ended or not, so events that come out of order within the lateness are all counted; later ones are dropped
by the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROUND = "round_i long, n_tools long, n_errors long, tool_ms double, round_ms double"
_STATE = "folded string, last_ms long"


def _sums() -> list[Column]:
    tool, done = F.col("event") == "tool_call", F.col("event") == "round_end"
    ms = F.coalesce("latency_ms", F.lit(0.0))
    return [
        F.count_if(tool).alias("n_tools"), F.count_if(tool & F.coalesce("is_error", F.lit(False))).alias("n_errors"),
        F.sum(F.when(tool, ms).otherwise(0.0)).alias("tool_ms"), F.sum(F.when(done, ms).otherwise(0.0)).alias("round_ms"),
    ]


def rounds(events: DataFrame) -> DataFrame:
    """(request_id, round_i, n_tools, n_errors, tool_ms, round_ms, ended) of a table of events; ``ended``: whether the
    request's end is among them. Events without a round belong to none."""
    ended = events.groupBy("request_id").agg(F.max(F.col("event") == "request_end").alias("ended"))
    return events.where("round_i IS NOT NULL").groupBy("request_id", "round_i").agg(*_sums()).join(ended, "request_id")


def prompt_means(folded: DataFrame, prompts: DataFrame) -> DataFrame:
    """(prompt, n_requests, mean_tools, mean_tool_ms, mean_wall_ms) over the requests (request_id, prompt), from their rounds."""
    each = folded.groupBy("request_id").agg(F.sum("n_tools").alias("tools"), F.sum("tool_ms").alias("tool_ms"), F.sum(F.col("tool_ms") + F.col("round_ms")).alias("wall_ms"))
    means = [F.avg(c).alias(f"mean_{c}") for c in ("tools", "tool_ms", "wall_ms")]
    return prompts.join(each, "request_id").groupBy("prompt").agg(F.count("*").alias("n_requests"), *means)


def stream_rounds(events: DataFrame, late: str = "1 hour", wait_ms: int = 3_600_000) -> DataFrame:
    """``rounds`` of a stream, in append mode: a request's rounds come out together, once."""
    timed = events.select("request_id", "event", F.col("round_i").cast("long").alias("round_i"), F.col("latency_ms").cast("double").alias("latency_ms"), F.coalesce("is_error", F.lit(False)).alias("is_error"), F.col("ts").cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", late)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else ('{"ended": false, "rounds": {}}', 0)
        folded = json.loads(held)
        if state.hasTimedOut:
            state.remove()
            rows = [(key[0], int(r), *sums, folded["ended"]) for r, sums in folded["rounds"].items()]
            if rows:
                yield pd.DataFrame(rows, columns=["request_id", "round_i", "n_tools", "n_errors", "tool_ms", "round_ms", "ended"])
            return
        for batch in batches:
            folded["ended"] |= bool((batch["event"] == "request_end").any())
            for r in batch[batch["round_i"].notna()].itertuples():
                sums = folded["rounds"].setdefault(str(int(r.round_i)), [0, 0, 0.0, 0.0])
                ms = 0.0 if pd.isna(r.latency_ms) else float(r.latency_ms)
                if r.event == "tool_call":
                    sums[0] += 1
                    sums[1] += bool(r.is_error)
                    sums[2] += ms
                elif r.event == "round_end":
                    sums[3] += ms
            last = max(last, int(batch["ts"].max().timestamp() * 1000))
        state.update((json.dumps(folded), last))
        # a time below the watermark can't be waited for: the request then goes out with the next batch
        state.setTimeoutTimestamp(max(last + wait_ms, state.getCurrentWatermarkMs() + 1))

    kind = dict(events.dtypes)["request_id"]
    return timed.groupBy("request_id").applyInPandasWithState(fold, f"request_id {kind}, {ROUND}, ended boolean", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
