"""Sources and sinks: Parquet, CSV, JSON, delimited and plain text, JDBC, rows in memory, ranges, generated points.

Readers of text formats take an explicit schema, so that a file is read once and columns can be pruned.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.functions.text import quote_csv
from brindle.storage import local_path


def parquet(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumnsRenamed(rename) if rename else df


def csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header, sep=sep, quote='"', escape='"', multiLine=False)


def tbl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Fields separated by | with one at the end of the line, as TPC-H's generator writes them."""
    return spark.read.schema(schema).csv(path, sep="|", header=False)


def json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **properties: str) -> DataFrame:
    """A table of a database; with a numeric key it is read in parallel ranges. Needs the database's driver jar."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def rows(spark: SparkSession, data: Iterable, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(list(data), schema)


def from_rdd(spark: SparkSession, rdd, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(rdd, schema)


def numbers(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Whole numbers from first to last, both included."""
    return spark.range(first, last + 1)


def points(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n rows of a generated benchmark table: id in 0 .. n/10 as double, two uniform doubles. Made from a hash of the row's
    number and the seed, so the same for the same seed, however the rows are partitioned."""
    uniform = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / F.lit(float(1 << 53))).cast("double")
    return spark.range(n).select(F.floor(uniform(0) * n / 10).cast("double").alias("id"), uniform(1).alias("double_x"), uniform(2).alias("double_y"))


def rate(spark: SparkSession, per_second: int = 10) -> DataFrame:
    """A stream of (timestamp, value)."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def rate_batches(spark: SparkSession, rows: int) -> DataFrame:
    """A stream of (timestamp, value) with so many rows in every micro-batch: the same numbers in every run."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows).option("numPartitions", 2).load()


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "overwrite", **options: str) -> None:
    """Write as parquet, orc, csv, json or text, in folders by the values of `by`."""
    defaults = {"csv": {"header": "true", "quote": '"', "escape": '"'}}.get(kind, {})
    w = df.write.mode(mode).options(**{**defaults, **options})
    (w.partitionBy(*by) if by else w).format(kind).save(path)


def infer_csv(spark: SparkSession, sample: str) -> str:
    """Schema (DDL) of a line of CSV."""
    return spark.range(1).select(F.schema_of_csv(F.lit(sample))).first()[0]


def save_object(df: DataFrame, path: str) -> None:
    """A collection kept for later, read again with `parquet`."""
    write(df, path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", **properties: str) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **properties).save()


#: The driver of the database that Spark brings.
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def derby(df: DataFrame, name: str, path: str) -> str:
    """A table of a new embedded Derby database in a folder that all executors share; its URL, by which any process reads it.

    An embedded database belongs to one process, so where executors are processes of their own, no task can write to the
    database in which the driver made the table. Here tasks write the rows as CSV, the driver's process takes them in by
    Derby's bulk import, and the database is closed and packed into an archive, which is read-only and can be open in all."""
    at = local_path(df.sparkSession, path)
    quoted = lambda f: quote_csv(F.col(f"`{f.name}`")) if f.dataType.typeName() == "string" else F.hex(f"`{f.name}`") if f.dataType.typeName() == "binary" else F.col(f"`{f.name}`").cast("string")
    fields = [F.coalesce(quoted(f), F.lit("")) for f in df.schema]  # texts in quotes, as Derby trims others; nulls are empty
    write(df.select(F.concat(fields[0], *(x for f in fields[1:] for x in (F.lit(","), f))).alias("value")), f"{path}/rows", "text")
    base = f"jdbc:derby:directory:{at}/made"
    write_jdbc(df.where("false"), f"{base};create=true", name, driver=DERBY)  # of no partitions: only the driver's process creates it
    jvm = df.sparkSession._jvm
    open_ = lambda url: jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(url, jvm.java.util.Properties())
    connection = open_(base)
    try:
        call = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
        for part in sorted((at / "rows").glob("part-*")):
            call.setString(1, name.upper())
            call.setString(2, str(part))
            call.execute()
    finally:
        connection.close()
    try:
        open_(f"{base};shutdown=true")
    except Py4JJavaError as e:  # Derby tells so that it has closed the database
        if e.java_exception.getSQLState() != "08006":
            raise
    with zipfile.ZipFile(at / "made.jar", "w", zipfile.ZIP_STORED) as z:  # pages of what is not compressed are found at once
        for f in sorted((at / "made").rglob("*")):
            if f.is_file() and f.suffix != ".lck":
                z.write(f, f.relative_to(at))
    return f"jdbc:derby:jar:({at}/made.jar)made"


def write_to(df: DataFrame, name: str, path: str, kind: str = "parquet") -> DataFrame:
    """Create or replace a catalogue's table by the second data source API, and read it."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    df.writeTo(name).using(kind).option("path", path).create()
    return df.sparkSession.read.format(kind).load(path)
