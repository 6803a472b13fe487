"""Headline queries at ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = (
    "stations_near", "radius_join", "nearest_station", "sector_neighbours", "stations_along_route", "cost_direct", "cost_scenic", "cost_direct_multi",
    "paved_edges", "edge_duplicates", "compare_percentiles", "route_breakdown", "route_shared_pairs", "cumulative_km", "stage_split", "curvature_window",
    "components", "triangle_dedup", "city_route", "raster_blur", "sample_along", "trace_fold", "sessionised_events",
)


def main() -> None:
    import tempfile

    from pyspark.sql import SparkSession

    from terrane.plans import catalog

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans, took = catalog.queries(), {}
    plans["stations_near"](spark, SF).collect()  # the session's own start isn't measured
    for name in NAMES:
        start = time.perf_counter()
        plans[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
