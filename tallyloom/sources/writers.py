"""Sinks. Spark's commit protocol makes each write atomic; a key makes it repeatable."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.upsert import latest_wins, replace_by_key
from tallyloom.session import cut


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes Parquet, replacing only the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _paths(spark: SparkSession, path: str) -> tuple:
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, new, old = (hadoop.Path(path.rstrip("/") + s) for s in ("", ".new", ".old"))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, new, old


def recover(spark: SparkSession, path: str) -> bool:
    """Ends a :func:`swap` that was cut off at any point; whether there is a table then.

    With a table in place what lies beside it is dropped. Between the two renames the old
    table stands aside and the new one is complete: it is put in place. A new table that
    was still being written is dropped and the old one put back.
    """
    fs, target, new, old = _paths(spark, path)
    if not fs.exists(target):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(new, "_SUCCESS")):
            fs.rename(new, target)
        elif fs.exists(old):
            fs.rename(old, target)
    there = fs.exists(target)
    if there:
        fs.delete(new, True)
        fs.delete(old, True)
    return there


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at the path; the old one while a :func:`swap` is between its two renames."""
    fs, target, _, old = _paths(spark, path)
    return spark.read.parquet(path if fs.exists(target) or not fs.exists(old) else str(old.toString()))


def swap(df: DataFrame, path: str) -> None:
    """Writes beside the path and renames; ``df`` may read from ``path``.

    Readers through :func:`read_table` see the old or the new table; a crash at any point
    loses no row, since the next writer begins with :func:`recover`.
    """
    fs, target, new, old = _paths(df.sparkSession, path)
    df.write.mode("overwrite").parquet(path.rstrip("/") + ".new")
    if fs.exists(target):
        fs.delete(old, True)
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)


def upsert_table(new: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Keeps the latest row of each key in a Parquet table."""
    spark = new.sparkSession
    old = spark.read.parquet(path) if recover(spark, path) else new.limit(0)
    swap(latest_wins(old, new, keys, order), path)


def replace_in_table(new: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces all rows of the keys that ``new`` touches."""
    spark = new.sparkSession
    swap(replace_by_key(spark.read.parquet(path), new, keys) if recover(spark, path) else new, path)


def append_verified(df: DataFrame, path: str) -> int:
    """Appends and reads back: the rows of ``df`` as a bag must be in the files it added, else an error.

    The bag is compared by its number and the sum of its rows' hashes, without a shuffle of
    rows; ``df`` is written once, from a cut, so that both sides are the same rows.
    """
    spark = df.sparkSession
    rows = cut(df)

    def bag(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)")), F.lit(0))).first())

    before = bag(read_table(spark, path).select(*df.columns)) if recover(spark, path) else (0, 0)
    rows.write.mode("append").parquet(path)
    want, got = bag(rows), bag(read_table(spark, path).select(*df.columns))
    if (before[0] + want[0], before[1] + want[1]) != got:
        raise ValueError(f"{want[0]} rows were appended to {path}, but {got[0] - before[0]} were read back")
    return want[0]


def export_units(df: DataFrame, path: str, unit: str) -> int:
    """One folder of files for each unit; units already there stay, so an export cut off goes on where it ended.

    Returns the number of units written.
    """
    spark = df.sparkSession
    fs, target, _, _ = _paths(spark, path)
    done = spark.read.parquet(path).select(F.col(unit).cast("string").alias("_done")).distinct() if fs.exists(target) else spark.createDataFrame([], "_done string")
    rest = cut(df.join(done, F.col(unit).cast("string") == F.col("_done"), "left_anti"))
    overwrite_partitions(rest.repartition(unit), path, [unit])
    return rest.select(unit).distinct().count()


def fixed_columns(df: DataFrame, layout: list[tuple[str, str | None, str]]) -> DataFrame:
    """A flat export of strings: ``layout`` lists (name, column or None, default)."""
    return df.select(*((F.coalesce(F.col(c).cast("string"), F.lit(d)) if c else F.lit(d)).alias(n) for n, c, d in layout))


def flattened(df: DataFrame, nested: str, prefix: str) -> DataFrame:
    """Fields of a struct as prefixed columns; arrays, maps and structs inside as JSON."""
    cols = []
    for f in df.schema[nested].dataType.fields:
        c = F.col(f"`{nested}`.`{f.name}`")
        deep = f.dataType.typeName() in ("array", "map", "struct")
        cols.append((F.to_json(c) if deep else c).alias(prefix + f.name))
    return df.select(*[c for c in df.columns if c != nested], *cols)


def encodable(df: DataFrame, columns: list[str], encoding: str) -> DataFrame:
    """Rows with a value that an encoding can't hold, with ``bad`` naming the columns."""

    def misfits(*values: pd.Series) -> pd.Series:
        def fits(v: str | None) -> bool:
            try:
                return v is None or v.encode(encoding) is not None
            except UnicodeEncodeError:
                return False

        flags = [[fits(v) for v in x] for x in values]
        return pd.Series([[c for c, ok in zip(columns, row, strict=True) if not ok] for row in zip(*flags, strict=True)])

    # one batch for all columns
    return df.withColumn("bad", F.pandas_udf(misfits, "array<string>")(*columns)).where(F.size("bad") > 0)


def encoded(df: DataFrame, columns: list[str], encoding: str) -> DataFrame:
    """``df`` if every value fits the encoding; the export is refused with an error otherwise."""
    bad = encodable(df, columns, encoding).select(F.array_join("bad", ",").alias("b")).groupBy("b").agg(F.count("*").alias("n")).limit(20).collect()  # names of columns
    if bad:
        raise ValueError(f"values that {encoding} can't hold: " + "; ".join(f"{r['b']}: {r['n']} rows" for r in bad))
    return df


def cells(df: DataFrame, *, sheet: str, row: str, values: dict[str, int]) -> DataFrame:
    """Rows to positional cells ``(sheet, row, col, value)`` for a spreadsheet adapter."""
    parts = F.array(*(F.struct(F.lit(c).alias("col"), F.col(n).cast("string").alias("value")) for n, c in values.items()))
    return df.select(sheet, row, F.explode(parts).alias("_c")).select(sheet, row, "_c.*")
