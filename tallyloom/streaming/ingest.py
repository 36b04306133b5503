"""Incremental, idempotent ingestion with Structured Streaming.

The state of every operator is Spark's checkpoint: offsets, sources read and state
stores. Late rows are covered by a watermark, repeats by a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyloom.sources.writers import upsert_table


def file_stream(spark: SparkSession, path: str, schema: StructType, *, files_per_batch: int | None = 2, time_col: str | None = None, only: str | None = None) -> DataFrame:
    """Parquet files as a stream, a few files a batch; ``time_col`` becomes a zoned timestamp."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if only:
        reader = reader.option("pathGlobFilter", only)
    df = reader.parquet(path)
    return df.withColumn(time_col, F.col(time_col).cast("timestamp")) if time_col else df


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType, **kw) -> DataFrame:
    """One Parquet table of a data directory as a stream, be it a file or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    is_file = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    df = file_stream(spark, folder if is_file else f"{folder}/{name}.parquet", schema, only=f"{name}.parquet" if is_file else None, **kw)
    return df


def once(stream: DataFrame, keys: list[str], time_col: str, lateness: str = "1 hour") -> DataFrame:
    """Each key once within the lateness; state older than that is dropped."""
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, time_col: str, width: str, by: list[str], lateness: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time_col, lateness).groupBy(F.window(time_col, width), *by).agg(F.count("*").alias("n"))


def sliding(stream: DataFrame, time_col: str, width: str, slide: str, by: list[str], lateness: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time_col, lateness).groupBy(F.window(time_col, width, slide), *by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time_col: str, gap: str, by: list[str], lateness: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time_col, lateness).groupBy(F.session_window(time_col, gap), *by).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there, batch by batch, then stops; a later call goes on where this one ended."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def upserting(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the latest row of each key; a batch that is run again changes nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        upsert_table(batch, path, keys, order)

    return sink


def changed_only(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of ``new`` that are new or differ in a field: what a sink has to write."""
    o = old.select(*keys, F.struct(*fields).alias("_o"))
    return new.join(o, keys, "left").where(~F.struct(*fields).eqNullSafe(F.col("_o"))).drop("_o")


def pending(df: DataFrame, marker_col: str, marker: str, order: str, most: int) -> DataFrame:
    """The oldest rows that carry the marker of unfinished work."""
    return df.where(F.col(marker_col) == marker).orderBy(F.asc_nulls_last(order)).limit(most)


def resume_point(saved: DataFrame, by: str, time_col: str) -> DataFrame:
    """Oldest saved time of each unit: where a backward sweep goes on."""
    return saved.groupBy(by).agg(F.min(time_col).alias("oldest"))


def lookback(df: DataFrame, time_col: str, now: str, hours: int) -> DataFrame:
    """Rows of the last hours before ``now``; longer than the period between runs, so that runs overlap and
    what one left undone the next takes up. A key makes the overlap harmless (:func:`once`)."""
    end = F.lit(now).cast("timestamp")
    return df.where((F.col(time_col) > end - F.make_dt_interval(hours=F.lit(hours))) & (F.col(time_col) <= end))


def run_for(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: float) -> bool:
    """What is there, batch by batch, until it is done or the time is up; whether it was done.

    The batch that runs when the time is up is given up and runs again in the next call.
    """
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done = q.awaitTermination(int(max(1, seconds)))
    if not done:
        q.stop()
    return bool(done)


def sweep(units: DataFrame, state: DataFrame, *, unit: str, order: str) -> DataFrame:
    """Units of a backward sweep that no state row calls done, newest first; ``resume_from`` is the oldest time saved of a unit begun.

    ``state``: (unit, done, oldest), the latest row of a unit counts by ``oldest``, then ``done``.
    """
    s = state.groupBy(unit).agg(F.max("done").alias("_done"), F.min("oldest").alias("resume_from"))
    j = units.join(s, unit, "left").where(~F.coalesce("_done", F.lit(False))).drop("_done")
    return j.orderBy(F.desc(order), unit)
