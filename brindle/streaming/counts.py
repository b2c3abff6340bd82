"""Streaming aggregates over a folder of Parquet files, or any other stream with the same columns."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.storage import shared_dir


def stream_of(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Files of a folder (or one file) as a stream, in steps of some files."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream's source is a folder or a pattern
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def count_by(stream: DataFrame, *keys: str) -> DataFrame:
    """Rows per key so far."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, time: str, late: str, size: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Rows per window (and key); rows that are later than the watermark are left out, and state is dropped behind it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size, slide), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, time: str, late: str, gap: str, *keys: str) -> DataFrame:
    """Rows per session: a session ends when its key has been silent for the gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def first_seen(stream: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def _start(result: DataFrame, mode: str, base: str, done: list[int], **trigger):
    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/step={n}")  # idempotent: a repeated step writes the same folder
        done.append(n)

    return result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(**trigger).foreachBatch(keep).start()


def _emitted(result: DataFrame, mode: str, base: str, done: list[int], step: str | None) -> DataFrame:
    spark, schema = result.sparkSession, result.schema
    if not done:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{base}/out/step={max(done)}")
    out = spark.read.schema(schema).parquet(*(f"{base}/out/step={n}" for n in sorted(set(done))))
    return out.withColumn(step, F.regexp_extract(F.input_file_name(), r"step=(\d+)", 1).cast("int")) if step else out


def run_to_end(result: DataFrame, mode: str = "update", step: str | None = None) -> DataFrame:
    """Process what the source holds now, and return what was emitted as a table.

    State and progress lie in the shared folder. In `complete` mode each step's whole result is written to a folder of its
    own, and the last one is returned; in `update` and `append` mode all emitted rows are, with the number of their step
    in a column `step` if it is named."""
    base, done = f"{shared_dir(result.sparkSession)}/stream-{uuid.uuid4().hex}", []
    q = _start(result, mode, base, done, availableNow=True)
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return _emitted(result, mode, base, done, step)


def run_batches(result: DataFrame, mode: str, batches: int, within: float = 120.0, step: str | None = None) -> DataFrame:
    """What an endless stream emits in its first micro-batches, as `run_to_end` gives it."""
    base, done = f"{shared_dir(result.sparkSession)}/stream-{uuid.uuid4().hex}", []
    q = _start(result, mode, base, done, processingTime="0 seconds")
    end = time.time() + within
    try:
        while len(done) < batches:
            if q.exception() or not q.isActive:
                raise RuntimeError(str(q.exception()))
            if time.time() > end:
                raise TimeoutError(f"fewer than {batches} batches in {within} s")
            time.sleep(0.05)
    finally:
        q.stop()
    return _emitted(result, mode, base, [n for n in done if n < batches], step)


def to_memory(result: DataFrame, mode: str) -> DataFrame:
    """What the source holds now, through Spark's sink in the driver's memory; for results known to be small."""
    name = f"memory_{uuid.uuid4().hex}"
    q = result.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(result.sparkSession)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    return result.sparkSession.table(name)
