"""Scenario runner: python -m lacuna.bench DATA_DIR REPETITIONS WARMUP(0|1) MASK OUT, plain query against explanation."""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .api import compute_msrs
from .functions.question import twig


def scenarios(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, dict]]:
    """Queries in the shapes of the usual scenarios, over the driver's tables, each with its question."""
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("orders", "customer", "lineitem", "documents")}
    o, c, l = t["orders"], t["customer"], t["lineitem"]  # noqa: E741
    parts = o.withColumn("part", F.explode(F.split("o_orderpriority", "-")))
    joined = c.filter("c_acctbal > 0").join(o.filter("o_totalprice > 100000"), c.c_custkey == o.o_custkey)
    return {
        "T1": (t["documents"].filter(F.contains("text", F.lit("the"))).select("doc_id", "lang"), {"lang": None}),
        "D1": (parts.filter("part = 'URGENT'").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), "part"), {"part": "containsHIGH"}),
        "D2i": (parts.select("o_custkey", "part").groupBy("o_custkey").agg(F.collect_list("part").alias("parts")), {"parts": {"element": "containsURG"}}),
        "D2p": (o.filter("o_orderstatus = 'F'").filter("o_totalprice > 250000").select("o_orderkey", "o_orderpriority"), {"o_orderpriority": "1-URGENT"}),
        "D2wn": (joined.select("c_name", "o_orderpriority", "c_mktsegment"), {"o_orderpriority": "1-URGENT", "c_mktsegment": "BUILDING"}),
        "D2": (joined.groupBy("c_mktsegment").agg(F.collect_list("o_orderpriority").alias("priorities")), {"c_mktsegment": "BUILDING"}),
        "J": (o.join(l, o.o_orderkey == l.l_orderkey).filter("l_quantity > 45").select("o_orderkey", "o_orderpriority", "l_returnflag"), {"o_orderpriority": "1-URGENT", "l_returnflag": "R"}),
    }


def timed(df: DataFrame) -> float:
    t = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t


def main(d: str, repetitions: str = "5", warmup: str = "1", mask: str = "-1", out: str = "") -> None:
    spark = SparkSession.builder.getOrCreate()
    rows: dict[str, list[float]] = {}
    for k, (name, (df, question)) in enumerate(scenarios(spark, d).items()):
        if int(mask) >> k & 1:
            for kind, run in (("plain", df), ("explained", compute_msrs(df, twig(question)))):
                rows[f"{name} {kind}"] = [timed(run) for _ in range(int(repetitions) + int(warmup))][int(warmup) :]
    text = sources.measurements(rows)
    if out:
        with open(out, "a", encoding="utf-8") as f:
            f.write(text)
    print(text)


if __name__ == "__main__":
    main(*sys.argv[1:])
