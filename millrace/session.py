"""Session helpers: shipping this package to Python workers, shared scratch tables."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)
#: Used only where the session names no spark.checkpoint.dir (tests, local runs).
LOCAL_SCRATCH = "file:///tmp/checkpoints"
_written: list[str] = []


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from the place the driver imports it from.

    On a cluster the package is installed or passed with ``--py-files``; the extra
    entry is harmless there because a missing folder on the path is skipped.
    """
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a local one, for local runs only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (root or LOCAL_SCRATCH).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage (a lost executor recomputes from the table, not from
    the source) and makes sure an expensive step runs once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def forget(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        if df is not None and hasattr(df, "_settled_at"):
            _delete(df.sparkSession, df._settled_at)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all scratch tables that this process has written and say how many; what was computed from them can't be read again."""
    paths = list(_written)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
