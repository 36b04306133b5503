"""Rebuilding conversations from message rows.

Method: partition by conversation key, secondary-sort by time, then validation by a
finite-state automaton. The key is the time of the first message, which answers name
in several notations. The automaton reads the messages of a conversation in order:

    start --first message with visible text--> open --visible text of another person--> answered
    any state --message without time, or before the first--> broken
    start --first message without visible text, or none at all--> broken

and keeps what ends in ``answered``. None of its transitions depends on the order of
the messages between, so it runs as an aggregate with map-side combine.

Scale: the texts are reduced to "visible or not" before the first shuffle. One
conversation may hold a third of all rows: turns are numbered within minutes of a
conversation, with the number of turns before each minute from tables of counts by hour
and by minute, so no task sees a whole conversation. The table of people is small (checked); it meets the senders
by equality joins.

Defined cases: of rows with one ``dedup_key`` the smallest id stands, rows with a null
key are kept apart; ties in time are broken by id; messages without visible text (null,
blank, zero-width) count for the checks but have no turn; a sender that is missing is
taken from the name; two first messages of one time share their answers with the
smaller id. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.variants import likeliest
from tallyloom.session import cut

MINUTE_US = 60_000_000
VISIBLE = r"[^\p{Z}\p{Cc}\p{Cf}\s]"


def micros(text: Column) -> Column:
    """Microseconds of a time written as epoch seconds or in ISO 8601 with any offset; else null."""
    epoch = F.regexp_extract(text, r"^\s*(\d{9,11}(?:\.\d+)?)\s*$", 1)
    iso = F.regexp_replace(F.trim(text), r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.when(epoch != "", (epoch.try_cast("decimal(20,6)") * 1_000_000).cast("bigint")).otherwise(F.unix_micros(iso.try_cast("timestamp")))


def messages(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Rows to ``(id, key, ts, first, who, person, visible)``, ingested twice or not at all once."""
    emails = people.select(F.lower("email").alias("address"), F.lit(True).alias("listed")).where(F.col("address").isNotNull()).distinct()
    address = F.lower(F.regexp_extract("sender", r"(?<![\w.\-])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+", 0))
    slim = rows.select(
        F.col("_id").alias("id"),
        "dedup_key",
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("ts"),
        F.when(F.col("parents").rlike(r"\S"), micros(F.col("parents"))).alias("parent"),
        F.coalesce(~F.col("parents").rlike(r"\S"), F.lit(True)).alias("first"),
        F.when(address != "", address).alias("address"),
        F.when(F.coalesce(address, F.lit("")) == "", F.coalesce(F.nullif(F.trim("sender"), F.lit("")), F.trim("name"))).alias("typed"),
        F.coalesce(F.col("content").rlike(VISIBLE), F.lit(False)).alias("visible"),
    )
    own = F.coalesce("dedup_key", F.concat(F.lit("\x1f"), F.col("id").cast("string")))
    slim = slim.groupBy(own.alias("k")).agg(F.min(F.struct("id", "ts", "parent", "first", "address", "typed", "visible")).alias("m")).select("m.*")
    typed = slim.where(F.col("typed").isNotNull()).select(F.col("typed").alias("value")).distinct()
    found = likeliest(typed, people).select(F.col("value").alias("typed"), F.lower("email").alias("by_spelling"))
    slim = slim.join(found, "typed", "left")
    slim = slim.withColumn("address", F.coalesce("address", "by_spelling")).join(F.broadcast(emails), "address", "left")
    return slim.select(
        "id",
        F.when(F.col("first"), F.col("ts")).otherwise(F.col("parent")).alias("key"),
        "ts",
        "first",
        F.coalesce("address", F.lower("typed"), F.lit("")).alias("who"),
        F.coalesce("listed", F.lit(False)).alias("person"),
        "visible",
    )


def validate(m: DataFrame) -> DataFrame:
    """The automaton: ``(key, conv_id, opener)`` of each conversation that ends answered."""
    by_sender = m.groupBy("key", "who", "person").agg(
        F.min(F.when(F.col("first"), F.struct("id", "ts", "who", "visible"))).alias("head"),
        F.max(F.col("ts").isNull()).alias("timeless"),
        F.min("ts").alias("earliest"),
        F.max("visible").alias("spoke"),
    )
    heads = by_sender.groupBy("key").agg(F.min("head").alias("head"), F.max("timeless").alias("timeless"), F.min("earliest").alias("earliest"))
    heads = heads.where(F.col("head").isNotNull() & ~F.col("timeless") & F.col("head.visible") & (F.col("earliest") >= F.col("head.ts")))
    heads = heads.select("key", F.col("head.id").alias("conv_id"), F.col("head.who").alias("opener"))
    answered = by_sender.where(F.col("spoke") & F.col("person")).join(heads, "key").where(F.col("who") != F.col("opener"))
    return answered.select("key", "conv_id", "opener").distinct()


def conversations(rows: DataFrame, people: DataFrame) -> DataFrame:
    """``(conv_id, turn, _id, role)`` of each message of each kept conversation."""
    m = cut(messages(rows, people).where(F.col("key").isNotNull()))
    kept = validate(m)
    spoken = m.where(F.col("visible") & F.col("ts").isNotNull()).withColumn("minute", F.floor(F.col("ts") / MINUTE_US))
    minutes = spoken.groupBy("key", "minute").agg(F.count("*").alias("n")).withColumn("hour", F.floor(F.col("minute") / 60))
    hours = minutes.groupBy("key", "hour").agg(F.sum("n").alias("n")).join(kept, "key")
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select("key", "hour", "conv_id", "opener", before(["key"], "hour").alias("before_hour"))
    minutes = minutes.join(hours, ["key", "hour"]).select("key", "minute", "conv_id", "opener", (F.col("before_hour") + before(["key", "hour"], "minute")).alias("before"))
    in_minute = Window.partitionBy("key", "minute").orderBy("ts", "id")
    role = F.when(F.col("who") == F.col("opener"), "opener").when(F.col("person"), "replier").otherwise("machine")
    return spoken.join(minutes, ["key", "minute"]).select(
        "conv_id", (F.col("before") + F.row_number().over(in_minute)).cast("int").alias("turn"), F.col("id").alias("_id"), role.alias("role")
    )
