"""Intermediate tables written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_made: set[str] = set()


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def local_path(spark: SparkSession, path: str) -> Path:
    """The path for what knows the machines' file system only."""
    sc = spark.sparkContext
    uri = sc._jvm.org.apache.hadoop.fs.Path(path).toUri()
    if (uri.getScheme() or sc._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(sc._jsc.hadoopConfiguration()).getScheme()) != "file":
        raise ValueError(f"{path} is not in the file system")
    return Path(uri.getPath())


def is_one_process(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's process."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir. It goes when the driver's JVM ends; what a killed driver
    leaves behind bears its application's id. Only where the session names no folder and all runs in one process
    (tests), a folder of its own is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not is_one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found}/brindle-{spark.sparkContext.applicationId}"
    if path not in _made:
        fs, at = _fs(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _made.add(path)
    return path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a table once and read it back, which cuts lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables that the application has made so far. For long sessions: call it when the results
    that were asked for have been written; DataFrames that were made before cannot be run any more."""
    fs, at = _fs(spark, shared_dir(spark))
    for f in fs.listStatus(at):
        fs.delete(f.getPath(), True)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores appended while a column (in any letter case) already has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Tables of more bytes are never shuffled only to be spread; their scan has tasks enough.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as there are cores, where a small table's scan would start fewer (its files have too few
    row groups to be split).

    For operators that compute a lot per row. Tables of more than SPREAD_BYTES stay as they are scanned."""
    plan = df._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df  # its shuffles decide
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df
