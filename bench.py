"""Headline timings as one JSON line: each scenario plain, explained, and explained without early filters."""

from __future__ import annotations

import json
import os
from statistics import median

from pyspark.sql import SparkSession

from lacuna.api import compute_msrs
from lacuna.bench import scenarios, timed
from lacuna.functions.question import twig


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name, (df, question) in scenarios(spark, d).items():
        t = twig(question)
        for kind, run in (("plain", df), ("explained", compute_msrs(df, t)), ("unoptimized", compute_msrs(df, t, optimize=False))):
            timed(run)
            times[f"{name}_{kind}"] = round(median(timed(run) for _ in range(5)), 4)
    explained = sum(v for k, v in times.items() if k.endswith("_explained"))
    plain = sum(v for k, v in times.items() if k.endswith("_plain"))
    print(json.dumps({"metric": "explain_total", "value": round(explained, 4), "unit": "sec", "overhead_ratio": round(explained / plain, 3), "queries": times, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
