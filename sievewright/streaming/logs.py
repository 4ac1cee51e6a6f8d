"""Streams over append-only logs: status counts, last entries, windows of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievewright.session import shared_dir


def log_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 64) -> DataFrame:
    """New files of a Parquet log as a stream; at most per_trigger files a micro-batch. A log of one file is read from its folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def status_counts(stream: DataFrame, status: str) -> DataFrame:
    """Running counts per status; the state holds one row a status."""
    return stream.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


def instant(c: Column) -> Column:
    """A time without zone as the instant that UTC clocks show it, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c.cast("timestamp_ntz")).cast("timestamp")


def wall(c: Column) -> Column:
    """An instant as UTC clocks show it."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def windowed(stream: DataFrame, at: str, late: str = "1 day", size: str = "7 days") -> DataFrame:
    """Counts per window of event time; entries later than `late` behind the watermark are left out, and closed windows leave the state."""
    timed = stream.withColumn(at, instant(F.col(at))).withWatermark(at, late)
    return timed.groupBy(F.window(at, size).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def first_per_key(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first entry of each key within the watermark: resuming does not process a key twice."""
    return stream.withColumn(at, instant(F.col(at))).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_to_end(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming aggregate over what is there, restartable through its checkpoint, and returns its result.

    Each micro-batch writes its result to a folder of its own below the shared one; the last one is the answer, or, in
    append mode, all of them. Nothing passes through the driver.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        done.append(number)

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{base}/out/{n}" for n in (done if mode == "append" else done[-1:])])


def drain(df: DataFrame, path: str) -> None:
    """Runs a stream of rows into a Parquet folder, each row once."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
