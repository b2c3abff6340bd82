"""Spans from trace records: starts and ends are paired, and durations summed up by name.

Records are rows of a table (context, position, instant and what else is known), whose position is "S:name" or "E:name".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import ordered
from brindle.storage import materialize


def spans(records: DataFrame, context: str, position: str, instant: str, tie: str) -> DataFrame:
    """(context, name, start, end, micros): each end with the latest start of its context and name that still waits.

    Records with another position are left out. Of records of one instant the order is that of `tie`. An end without a
    start is an error, a start without an end gives no span. Paired by depth: what has the depth d alternates between
    start and end, so no context is gathered."""
    r = records.select(F.col(context).alias("context"), F.substring(position, 1, 2).alias("_kind"), F.substr(F.col(position), F.lit(3)).alias("name"), F.col(instant).alias("instant"), F.col(tie).alias("_tie")).where("_kind IN ('S:', 'E:')")
    step = F.when(F.col("_kind") == "S:", 1).otherwise(-1)
    deep = ordered.prefix_sum(r, ["context", "name"], ["instant", "_tie"], step, "_after")
    depth = F.when(F.col("_kind") == "S:", F.col("_after")).otherwise(F.col("_after") + 1)
    ok = F.when(depth < 1, F.raise_error(F.concat(F.lit("no start for the end of "), F.col("name")))).otherwise(depth)
    paired = ordered.shift(deep.withColumn("_depth", ok), ["context", "name", "_depth"], ["instant", "_tie"], F.col("instant"), 1, "start")
    done = paired.where("_kind = 'E:'")
    return done.select("context", "name", "start", F.col("instant").alias("end"), F.timestamp_diff("MICROSECOND", F.col("start"), F.col("instant")).alias("micros"))


def summary(found: DataFrame, *by: str) -> DataFrame:
    """Count, median, maximum and total of the durations by name (or other columns), in microseconds."""
    return found.groupBy(*(by or ("name",))).agg(F.count(F.lit(1)).alias("count"), F.median("micros").alias("median"), F.max("micros").alias("longest"), F.sum("micros").alias("total"))


def task_records(spark: SparkSession, event_log: str) -> DataFrame:
    """Trace records of the tasks in a Spark event log (a file or folder of JSON lines, spark.eventLog.dir): the context is the
    stage, the name its task's locality, and instants are those of launch and finish."""
    log = spark.read.schema("Event string, `Stage ID` int, `Task Info` struct<`Task ID`: bigint, `Launch Time`: bigint, `Finish Time`: bigint, `Executor ID`: string>").json(event_log)
    ended = log.where("Event = 'SparkListenerTaskEnd'").select(F.col("Stage ID").alias("stage"), F.col("Task Info.*"))
    at = lambda c: F.timestamp_millis(F.col(c))
    both = F.explode(F.array(F.struct(F.lit("S:").alias("k"), at("Launch Time").alias("t")), F.struct(F.lit("E:").alias("k"), at("Finish Time").alias("t"))))
    return materialize(ended.select("stage", "Task ID", "Executor ID", both.alias("r")).select(F.concat_ws("/", "stage", "Task ID").alias("context"), F.concat("r.k", F.lit("stage "), F.col("stage")).alias("position"), F.col("r.t").alias("instant"), F.col("Executor ID").alias("executor"), F.when(F.col("r.k") == "S:", 0).otherwise(1).alias("tie")), "records")
