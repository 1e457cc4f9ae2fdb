"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build(app: str = "talus", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above. On a cluster leave ``master`` unset."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local(cores: int | None = None, **extra: str) -> SparkSession:
    """Single-machine session for tests and the bench."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return build(
        master=f"local[{n}]",
        **{
            "spark.sql.shuffle.partitions": str(n),
            "spark.driver.memory": os.environ.get("TALUS_DRIVER_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.streaming.stateStore.maintenanceInterval": "600s",
            **extra,
        },
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written tables: the one the cluster names in spark.checkpoint.dir, else the
    warehouse folder of the session, which executors reach as well."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_talus"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so they can import it also
    where it isn't installed. Spark's own file server carries the archive; the copy made here is only
    what it reads."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="talus-")) / "talus.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)


_SHIPPED: set[str] = set()
