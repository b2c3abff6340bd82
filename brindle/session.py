"""Session settings and table access shared by every query."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings shop_orders users shop_items "
    "trips cab_types xy_points nums subject_areas doc_labels"
).split()

#: Settings the library relies on. All can be changed at run time, so they also apply to a session made elsewhere.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),  # batches of long texts stay small
}


def session(master: str = "local[*]", app: str = "brindle", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with this library's settings; `conf` keys are written with double underscores for dots."""
    builder = SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false")
    for k, v in RUNTIME.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    ship(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in a directory (file or folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | tuple[str, ...]) -> None:
    """Temporary views, so that SQL text finds the tables by name."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="brindle-ship-")) / "brindle.zip"  # on the driver only: Spark serves it to the executors
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
