"""Result tables as parquet. A run replaces its own partition and nothing else, so running a day
again is safe, also after a failure half way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.session import checkpoint_dir


def write_run(df: DataFrame, path: str, run_date: str) -> None:
    """Write one run's rows under its date."""
    (
        df.withColumn("run_date", F.lit(run_date).cast("date")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)
    )


def read_runs(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """All runs, or those from a date on (partition pruning)."""
    df = spark.read.parquet(path)
    return df.filter(F.col("run_date") >= F.lit(since).cast("date")) if since else df


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder for one job run under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Cut the lineage with a written table in the shared folder the cluster names; a lost
    executor then costs a re-read, not a recompute."""
    path = f"{folder.rstrip('/')}/{name}" if folder else workspace(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Evenly sized partitions before heavy work per row; Spark picks the number from the data."""
    return df.hint("rebalance")
