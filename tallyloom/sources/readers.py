"""Readers: byte-decoded CSV, unions of validated files, cell tables, notes and JSON."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "cp932", "shift_jis")
_BOM = b"\xef\xbb\xbf"


def strip_boms(raw: bytes) -> bytes:
    """Bytes without any number of byte order marks."""
    while raw.startswith(_BOM):
        raw = raw[3:]
    return raw


def decode(raw: bytes, required: list[str], encodings: tuple[str, ...] = ENCODINGS) -> tuple[str, str] | None:
    """(text, encoding) of the first encoding whose header line has the required columns."""
    body = strip_boms(raw)
    for e in encodings:
        try:
            text = body.decode(e)
        except UnicodeDecodeError:
            continue
        header = next(csv.reader(io.StringIO(text)), [])
        if set(required) <= {h.strip() for h in header}:
            return text, e
    return None


def read_csv_bytes(spark: SparkSession, paths: str | list[str], columns: list[str], *, required: list[str] | None = None, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """CSV files of unknown encoding as one table of strings, with ``path`` and ``line``.

    A file is read whole by one task, as its encoding is judged by its header. Files
    without the required columns give no row; ``unreadable`` lists them.
    """
    need = required or columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = decode(bytes(raw), need, encodings)
                if not found:
                    continue
                rows = list(csv.DictReader(io.StringIO(found[0])))
                cols = [pa.array([path] * len(rows)), pa.array(range(1, len(rows) + 1), pa.int64())]
                cols += [pa.array([(r.get(c) if r.get(c) is not None else None) for r in rows], pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "line", *columns])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "path string, line bigint, " + ", ".join(f"`{c}` string" for c in columns))


def unreadable(spark: SparkSession, paths: str | list[str], required: list[str], encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """Paths of files that no encoding makes into a table with the required columns."""

    def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["path"]).filter(pa.array([decode(bytes(raw), required, encodings) is None for raw in b.column(1).to_pylist()], pa.bool_()))

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(bad, "path string")


def newest_file(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """One row: the newest file whose name fits a regular expression."""
    f = spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length")
    return f.where(F.element_at(F.split("path", "/"), -1).rlike(pattern)).orderBy(F.desc("modificationTime"), "path").limit(1)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def header_row(cells: DataFrame, *, sheet: str, labels: list[str], search: int = 5) -> DataFrame:
    """First of the top rows of each sheet that holds all labels: ``(sheet, header)``."""
    c = cells.where((F.col("row") <= search) & F.col("value").isin(*labels))
    return c.groupBy(sheet, "row").agg(F.count_distinct("value").alias("n")).where(F.col("n") == len(labels)).groupBy(sheet).agg(F.min("row").alias("header"))


def sheet_table(cells: DataFrame, *, sheet: str, labels: list[str], search: int = 5) -> DataFrame:
    """Cells ``(sheet, row, col, value)`` to rows below the header, a column per label; sheets
    without the header are skipped."""
    head = header_row(cells, sheet=sheet, labels=labels, search=search)
    h = cells.join(head, sheet)
    names = h.where(F.col("row") == F.col("header")).select(sheet, "col", F.col("value").alias("label")).where(F.col("label").isin(*labels))
    body = h.where(F.col("row") > F.col("header")).join(names, [sheet, "col"])
    return body.groupBy(sheet, "row").pivot("label", labels).agg(F.first("value"))


def carried_forward(cells: DataFrame, *, by: str, order: str, value: str, out: str) -> DataFrame:
    """The last known value down the rows of a sheet, as for merged cells."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn(out, F.last(value, ignorenulls=True).over(w))


def right_of_label(cells: DataFrame, labels: list[str], width: int, *, sheet: str) -> DataFrame:
    """First filled cell within ``width`` columns right of each label: ``(sheet, label, value)``."""
    lab = cells.where(F.col("value").isin(*labels)).select(sheet, "row", F.col("col").alias("c0"), F.col("value").alias("label"))
    right = cells.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    j = lab.join(right, [sheet, "row"]).where((F.col("col") > F.col("c0")) & (F.col("col") <= F.col("c0") + width))
    return j.groupBy(sheet, "label").agg(F.min_by("value", F.struct("row", "col")).alias("value"))


def resolve_references(cells: DataFrame, *, sheet: str, depth: int = 3) -> DataFrame:
    """Cells ``(sheet, ref, value)`` whose value is ``=REF`` take the value of that cell, up to ``depth`` steps; else null."""
    out = cells
    for _ in range(depth):
        target = F.when(F.col("value").rlike(r"^=\$?[A-Z]+\$?\d+$"), F.regexp_replace(F.col("value"), r"[=$]", ""))
        look = cells.select(sheet, F.col("ref").alias("_t"), F.col("value").alias("_v"))
        out = out.withColumn("_t", target).join(look, [sheet, "_t"], "left").withColumn("value", F.when(F.col("_t").isNotNull(), F.col("_v")).otherwise(F.col("value"))).drop("_t", "_v")
    return out.withColumn("value", F.when(F.col("value").rlike(r"^=\$?[A-Z]+\$?\d+$"), None).otherwise(F.col("value")))


def stacked_tables(cells: DataFrame, *, sheet: str, marker: str) -> DataFrame:
    """Rows with the number of the table they belong to, a new one at each marker cell."""
    starts = cells.where(F.col("value") == marker).select(sheet, F.col("row").alias("start")).distinct()
    starts = starts.withColumn("table_no", F.row_number().over(Window.partitionBy(sheet).orderBy("start")))
    nxt = F.lead("start").over(Window.partitionBy(sheet).orderBy("start"))
    spans = starts.withColumn("stop", nxt)
    j = cells.alias("c").join(spans.alias("s"), sheet).where((F.col("row") >= F.col("start")) & (F.col("stop").isNull() | (F.col("row") < F.col("stop"))))
    return j.select("c.*", "s.table_no")


def note_text(c: Column, most: int = 20_000) -> Column:
    """``struct(text, truncated)`` of a note."""
    return F.struct(F.substring(c, 1, most).alias("text"), (F.length(c) > most).alias("truncated"))


def transcript_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Spoken lines of a caption file: header, sequence and timing lines dropped; ``(id, line_no, speaker, text)``."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, r"\r?\n")).alias("line_no", "line"))
    kept = lines.where(~F.col("line").rlike(r"^\s*$|^WEBVTT|^\d+$|-->"))
    speaker = F.nullif(F.regexp_extract("line", r"^(?:<v ([^>]+)>)?", 1), F.lit(""))
    label = F.nullif(F.regexp_extract("line", r"^([^:<>]{1,40}): ", 1), F.lit(""))
    text = F.regexp_replace(F.regexp_replace("line", r"^<v [^>]+>|</v>$", ""), r"^[^:<>]{1,40}: ", "")
    return kept.select(id_col, "line_no", F.coalesce(speaker, label).alias("speaker"), text.alias("text"))


def folders_of(path: str) -> list[str]:
    return [p for p in re.split(r"\s*/\s*", path) if p]


def users_named(users: DataFrame, *, id_col: str, names: list[str], deleted: str, bot: str) -> DataFrame:
    """Users who are there and no bots, by the first name that is filled."""
    alive = ~F.coalesce(F.col(deleted), F.lit(False)) & ~F.coalesce(F.col(bot), F.lit(False))
    return users.where(alive).select(id_col, F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names)).alias("name"))


def last_listed(df: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """Listing to ``(key, value)``; the last entry of a key wins."""
    return df.groupBy(key.alias("key")).agg(F.max_by(value, order).alias(value))


def fixed_sheet(cells: DataFrame, *, sheet: str, header: int, first: int, columns: dict[str, str], derived: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Rows of a sheet whose header stands in a fixed row and whose data begin at another, a column for each label.

    ``columns``: label to name. ``derived``: name to (minuend, subtrahend), filled where both
    are numbers. Rows without any value are left out; blank header cells name nothing.
    """
    names = cells.where((F.col("row") == header) & F.trim("value").isin(*columns)).select(sheet, "col", F.trim("value").alias("label"))
    body = cells.where((F.col("row") >= first) & (F.trim("value") != "")).join(names, [sheet, "col"])
    wide = body.groupBy(sheet, "row").pivot("label", list(columns)).agg(F.first("value"))
    out = wide.select(sheet, "row", *(F.col(f"`{label}`").alias(n) for label, n in columns.items()))
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("decimal(18,2)")
    for name, (a, b) in (derived or {}).items():
        out = out.withColumn(name, number(F.col(a)) - number(F.col(b)))
    return out


def file_kind(name: Column, content: Column) -> Column:
    """Kind of a file by its first bytes, or else by its extension: pdf, zip, png, jpeg, gif, text or unknown."""
    head = F.hex(F.substring(content, 1, 8))
    by_bytes = F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif")
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,5})$", 1))
    by_name = F.when(ext.isin("pdf", "png", "gif"), ext).when(ext.isin("jpg", "jpeg"), "jpeg").when(ext.isin("xlsx", "docx", "pptx", "zip"), "zip").when(ext.isin("txt", "csv", "md", "json"), "text")
    return F.coalesce(by_bytes, by_name, F.lit("unknown"))


def safe_names(df: DataFrame, name: str, *, order: str, out: str = "safe_name") -> DataFrame:
    """File names without signs that file systems refuse, told apart by a number where two become equal."""
    stem = F.regexp_replace(F.regexp_replace(F.trim(name), r"[\\\\/:*?\"<>|\s\x00-\x1f]+", "_"), r"^[._]+", "")
    d = df.withColumn("_s", F.when(F.length(stem) > 0, stem).otherwise("file"))
    n = F.row_number().over(Window.partitionBy(F.lower("_s")).orderBy(order))
    ext = F.regexp_extract("_s", r"(\.[A-Za-z0-9]{1,5})$", 1)
    numbered = F.concat(F.regexp_replace("_s", r"\.[A-Za-z0-9]{1,5}$", ""), F.lit("_"), n.cast("string"), ext)
    return d.withColumn("_n", n).withColumn(out, F.when(F.col("_n") == 1, F.col("_s")).otherwise(numbered)).drop("_s", "_n")


def staged(spark: SparkSession, path: str, schema: str, *, key: str, order: str) -> DataFrame:
    """Records of an earlier stage kept as lines of JSON, the latest of each key."""
    r = spark.read.schema(schema).json(path).where(F.col(key).isNotNull())
    return r.groupBy(key).agg(F.max_by(F.struct(*[c for c in r.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def note_or_reason(path: Column, body: Column, most: int = 20_000) -> Column:
    """``struct(text, truncated, reason)`` of a note: no path, missing, empty, or null where it was read."""
    reason = F.when(F.coalesce(F.trim(path), F.lit("")) == "", "no path").when(body.isNull(), "missing").when(F.trim(body) == "", "empty")
    return F.struct(F.when(reason.isNull(), F.substring(body, 1, most)).alias("text"), F.coalesce(F.length(body) > most, F.lit(False)).alias("truncated"), reason.alias("reason"))
