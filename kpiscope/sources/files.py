"""Readers and writers: CSV, JSON, JSONL and Parquet folders of source tables."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.sources.schemas import SCHEMAS


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``); a
    temporary folder stands in for it in a local session only."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="kpiscope-")
        atexit.register(shutil.rmtree, own, True)
        shared = f"file://{own}"
    return f"{shared.rstrip('/')}/kpiscope/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).option("header", True).option("mode", "FAILFAST").csv(f"{folder}/{name}.csv")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_csv(spark, folder, name) for name in SCHEMAS}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, last_refresh_at, cadence_hours, as_of): one row for each source."""
    inner = "struct<last_refresh_at:string,expected_cadence_hours:double,row_counts:map<string,bigint>>"
    raw = spark.read.schema(f"as_of date, sources map<string,{inner}>").option("multiLine", True).json(path)
    return raw.select("as_of", F.explode("sources").alias("source", "s")).select(
        "source", F.col("s.last_refresh_at").alias("last_refresh_at"),
        F.col("s.expected_cadence_hours").alias("cadence_hours"), F.col("s.row_counts").alias("row_counts"), "as_of",
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) as one union of counts, a single job."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_month_partitions(df: DataFrame, path: str, date: str = "date") -> None:
    """Parquet by month, so that window filters prune folders; rows of a month meet first."""
    df.withColumn("month", F.date_format(date, "yyyy-MM")).repartition("month").write.mode("overwrite").partitionBy("month").parquet(path)


def append_jsonl(path: str, event: Mapping[str, object]) -> None:
    """One audit event as a line of a local log, written by the driver."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(event, sort_keys=True, default=str) + "\n")
