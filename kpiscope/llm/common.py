"""Shared helpers: intermediate tables in the cluster's shared folder, text access, checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (a local test) a temporary folder is used; on a cluster
    that is refused, as executors would not see the driver's disk.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = conf.get("spark.master", "")
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if master not in _OWN_DIRS:
        _OWN_DIRS[master] = tempfile.mkdtemp(prefix="kpiscope-")
        atexit.register(_remove_local, _OWN_DIRS[master])
    return "file://" + _OWN_DIRS[master]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/kpiscope/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            delete_path(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            pass

    atexit.register(clean)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks only, and what was
    computed (Python passes above all) is not computed again for each reader.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """The text's UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(bytearray()))


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
