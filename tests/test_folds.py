"""Folded requests: a stream in small batches, out of order, gives what the table gives."""

import datetime as dt
import random

from pyspark.sql import functions as F

from terrane.operators.trees import another_way
from terrane.plans import catalog
from terrane.streaming import folds

SCHEMA = "request_id long, event string, round_i long, latency_ms double, is_error boolean, ts timestamp"


def some_events(r):
    start, rows = dt.datetime(2024, 1, 1), []
    for request in range(30):
        at = start + dt.timedelta(minutes=20 * request)
        for k in range(r.randrange(1, 4)):
            for _ in range(r.randrange(4)):
                rows.append((request, "tool_call", k, r.choice([None, float(r.randrange(90))]), r.choice([None, True, False]), at + dt.timedelta(seconds=r.randrange(500))))
            rows.append((request, "round_end", k, float(r.randrange(900)), None, at + dt.timedelta(seconds=500)))
        rows.append((request, "request_start", None, 1.0, None, at))
        if request % 4:
            rows.append((request, "request_end", None, 5.0, None, at + dt.timedelta(seconds=600)))
    return rows


def test_stream_equals_table(spark, tmp_path):
    r = random.Random(1)
    rows = sorted(some_events(r), key=lambda x: x[5] + dt.timedelta(seconds=r.randrange(600)))  # late, within the hour
    rows.append((999, "tool_call", 0, 1.0, False, dt.datetime(2024, 2, 1)))  # moves the watermark past all others
    rows.append((0, "tool_call", 0, 1.0, False, dt.datetime(2024, 1, 1)))  # and this one is too late
    cut = [0, 40, 90, len(rows) - 2, len(rows) - 1, len(rows)]
    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = folds.stream_rounds(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination(240)
    key = lambda df: sorted(tuple(x) for x in df.select("request_id", "round_i", "n_tools", "n_errors", "tool_ms", "round_ms", "ended").collect())
    expected = folds.rounds(spark.createDataFrame(rows[:-2], SCHEMA))
    assert key(spark.table("folded")) == key(expected)
    assert {x["ended"] for x in expected.collect()} == {True, False}


def test_prompt_means(spark):
    rows = folds.rounds(spark.createDataFrame(some_events(random.Random(2)), SCHEMA))
    prompts = spark.range(30).select(F.col("id").alias("request_id"), (F.col("id") % 3).alias("prompt"))
    found = folds.prompt_means(rows, prompts).collect()
    assert sum(x["n_requests"] for x in found) == 30 and all(x["mean_wall_ms"] >= x["mean_tool_ms"] for x in found)


def test_queries_are_there():
    assert {"round_folds", "prompt_means"} <= set(catalog.oracle_sql())


def test_another_way():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(3, 9)
        graph = {v: {} for v in range(n)}
        for _ in range(r.randrange(2, 14)):
            a, b = r.sample(range(n), 2)
            graph[a][b] = graph[b][a] = float(r.randrange(1, 9))
        far = {v: float("inf") for v in graph} | {0: 0.0}
        for _ in range(n):
            for a, xs in graph.items():
                for b, c in xs.items():
                    far[b] = min(far[b], far[a] + c)
        limit = float(r.randrange(1, 20))
        assert another_way(graph, 0, n - 1, limit) == (far[n - 1] <= limit)
