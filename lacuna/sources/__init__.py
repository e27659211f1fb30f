"""Inputs and outputs of scenarios: any format Spark reads, with a schema taken once from a sample."""

from __future__ import annotations

import csv
import io
from statistics import mean, median, pstdev

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "xml", "avro")


def schema_of(spark: SparkSession, path: str, fmt: str = "json", **options) -> StructType:
    """The schema of a sample file, to read the whole with."""
    return spark.read.format(fmt).options(**options).load(path).schema


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None, **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}), **options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_result(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def measurements(rows: dict[str, list[float]]) -> str:
    """Seconds of each run by name, as `;`-separated lines with average, median and population deviation."""
    out = io.StringIO()
    w = csv.writer(out, delimiter=";", lineterminator="\n")
    w.writerow(["name", "runs", "average", "median", "stddev", "seconds"])
    for name, s in rows.items():
        w.writerow([name, len(s), round(mean(s), 4), round(median(s), 4), round(pstdev(s), 4), " ".join(f"{x:.4f}" for x in s)])
    return out.getvalue()
