"""Session settings and table loading shared by every query."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("folioforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FOLIOFORGE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch to a Python worker: rows may be long texts, and several batches are held at a time.
ARROW_BYTES = "4m"
_ARROW_KEY, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m", "64MB")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context, and bound their batches unless the session does."""
    sc = spark.sparkContext
    if spark.conf.get(_ARROW_KEY) in _ARROW_DEFAULT:
        spark.conf.set(_ARROW_KEY, ARROW_BYTES)
    if getattr(sc, "_folioforge_shipped", False):
        return
    root, tmp = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="folioforge-pkg-")
    atexit.register(shutil.rmtree, tmp, True)
    path = Path(tmp) / "folioforge_pkg.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"folioforge/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    sc._folioforge_shipped = True
