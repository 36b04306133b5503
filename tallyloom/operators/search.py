"""Search over the unified record table: newest rows, threads and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, n: int, *, time_col: str = "timestamp", id_col: str = "_id") -> DataFrame:
    """Top ``n`` by time, missing times last; ties by id. A TakeOrderedAndProject."""
    return df.orderBy(F.desc_nulls_last(time_col), F.asc(id_col)).limit(n)


def with_truncation(df: DataFrame, n: int, **kw) -> DataFrame:
    """``newest`` with the flag ``truncated``: whether there were more than ``n`` rows."""
    top = newest(df, n + 1, **kw)
    rows = Window.partitionBy(F.lit(1))  # at most n + 1 rows
    return newest(top.withColumn("truncated", F.count("*").over(rows) > n), n, **kw)


def newest_per(df: DataFrame, by: str, caps: int | dict[str, int], *, time_col: str = "timestamp", id_col: str = "_id") -> DataFrame:
    """The newest rows of each group, up to a cap that may differ by group.

    ``rank <= n`` over the window is planned as a group limit, so each task keeps its best
    rows before the shuffle and no group passes whole.
    """
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(time_col), F.asc(id_col))
    ranked = df.withColumn("_rn", F.row_number().over(w))
    if isinstance(caps, int):
        return ranked.where(F.col("_rn") <= caps).drop("_rn")
    most = max(caps.values())
    cap = F.lit(0)
    for k, v in caps.items():
        cap = F.when(F.col(by) == k, v).otherwise(cap)
    return ranked.where((F.col("_rn") <= most)).where(F.col("_rn") <= cap).drop("_rn")


def expand_threads(seeds: DataFrame, rows: DataFrame, *, key: str, id_col: str = "_id", least: int = 2) -> DataFrame:
    """Rows of the threads that the seeds belong to, each once; threads of ``least`` rows or more."""
    keys = seeds.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key).distinct()
    big = rows.join(keys, key, "left_semi").groupBy(key).agg(F.countDistinct(id_col).alias("_n")).where(F.col("_n") >= least).select(key)
    return rows.join(big, key, "left_semi").dropDuplicates([id_col])


def children_by_time(parents: DataFrame, children: DataFrame, *, parent_time: str, child_parent: str) -> DataFrame:
    """Pairs of a parent and the rows that name its time, equal to the second.

    The minute is the join key, the second the test, so it is an equality join.
    """
    p = parents.withColumn("_sec", F.unix_seconds(F.col(parent_time).cast("timestamp")))
    c = children.withColumn("_sec", F.unix_seconds(F.col(child_parent).cast("timestamp")))
    return p.alias("p").join(c.alias("c"), F.col("p._sec") == F.col("c._sec"))


def explode_links(df: DataFrame, links_col: str, *, sep: str = r"[\n;]") -> DataFrame:
    """``(link, pos)`` of each link of a text or array column, blanks dropped."""
    is_array = dict(df.dtypes)[links_col].startswith("array")
    c = F.col(links_col) if is_array else F.split(F.col(links_col), sep)
    clean = F.filter(F.transform(c, lambda x: F.trim(F.regexp_replace(x, r"\s+$", ""))), lambda x: x != "")
    return df.select("*", F.posexplode(clean).alias("pos", "link"))


def attachments(df: DataFrame, files: DataFrame, *, links_col: str, path_col: str, id_col: str) -> DataFrame:
    """First file of each link by path; each (row, path) once, at its first place."""
    links = explode_links(df.select(id_col, links_col), links_col).groupBy(id_col, "link").agg(F.min("pos").alias("pos"))
    best = files.groupBy(F.col(path_col).alias("link")).agg(F.min(F.struct(*[c for c in files.columns if c != path_col])).alias("file"))
    return links.join(best, "link").select(id_col, "pos", "link", "file.*")


def month_chunks(df: DataFrame, *, time_col: str, by: list[str], text_col: str, id_col: str, size: int = 40) -> DataFrame:
    """Texts of a month in chunks of ``size`` rows, in order: ``(by, month, chunk, n, text)``.

    ``size`` bounds what one row of the result holds.
    """
    month = F.date_format(time_col, "yyyy-MM")
    w = Window.partitionBy(*by, "month").orderBy(F.asc(time_col), F.asc(id_col))
    numbered = df.withColumn("month", month).withColumn("_rn", F.row_number().over(w)).withColumn("chunk", F.floor((F.col("_rn") - 1) / size))
    items = F.array_sort(F.collect_list(F.struct("_rn", F.coalesce(text_col, F.lit("")).alias("t"))))
    return numbered.groupBy(*by, "month", "chunk").agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("text"))


def canonical_pool(df: DataFrame, *, key: Column, query_col: str, body_col: str, top: int = 30) -> DataFrame:
    """One row per canonical key: distinct queries that found it and its longest body; best ``top``."""
    merged = df.groupBy(key.alias("key")).agg(F.count_distinct(query_col).alias("n_queries"), F.max(F.struct(F.length(body_col).alias("len"), F.col(body_col).alias("body"))).alias("b"))
    return merged.select("key", "n_queries", F.col("b.body").alias("body"), F.col("b.len").alias("body_len")).orderBy(F.desc("n_queries"), F.desc("body_len"), "key").limit(top)


def replace_mentions(df: DataFrame, users: DataFrame, *, id_col: str, text_col: str, user_id: str, user_name: str, pattern: str = r"<@([A-Z0-9]+)>") -> DataFrame:
    """Mentions by id become ``@name``; ids without a user stay. One equality join on the ids that occur."""
    marked = df.select(id_col, text_col, F.regexp_extract_all(text_col, F.lit(pattern), 1).alias("_ids"))
    hit = marked.select(id_col, F.explode(F.array_distinct("_ids")).alias("_u")).join(users.select(F.col(user_id).alias("_u"), F.col(user_name).alias("_n")).dropDuplicates(["_u"]), "_u")
    maps = hit.groupBy(id_col).agg(F.collect_list(F.struct("_u", "_n")).alias("_m"))
    out = df.join(maps, id_col, "left")
    empty = F.array().cast("array<struct<_u:string,_n:string>>")
    text = F.aggregate(F.coalesce("_m", empty), F.col(text_col), lambda t, m: F.replace(t, F.concat(F.lit("<@"), m["_u"], F.lit(">")), F.concat(F.lit("@"), m["_n"])))
    return out.withColumn(text_col, text).drop("_m")


def capped_cascade(df: DataFrame, reasons: list[tuple[str, Column]], *, group: str, order: list[Column], per_group: int, total: int) -> DataFrame:
    """Every row with ``reason``: the first condition that drops it, over_group beyond the cap of
    its group, over_total beyond the total; null for the rows kept.

    Ranks are taken among the rows still in; the total is a top-n, not a global window.
    """
    from tallyloom.functions.choices import first_reason

    d = df.withColumn("reason", first_reason(reasons))
    rn = F.row_number().over(Window.partitionBy(group, F.col("reason").isNull()).orderBy(*order))
    d = d.withColumn("reason", F.when(F.col("reason").isNull() & (rn > per_group), "over_group").otherwise(F.col("reason")))
    top = d.where(F.col("reason").isNull()).orderBy(*order).limit(total).select(*[c for c in df.columns]).withColumn("_top", F.lit(True))
    keep = top.select(*df.columns[:1], "_top")
    return d.join(keep, df.columns[0], "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_top").isNull(), "over_total").otherwise(F.col("reason"))).drop("_top")


def replan(df: DataFrame, *, group: str, most: int = 300) -> DataFrame:
    """One row: number of rows, number of distinct groups, and why to ask again: none, many or null."""
    r = df.agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"))
    return r.withColumn("reason", F.when(F.col("n") == 0, "none").when(F.col("n") > most, "many"))


def first_seeds(seeds: DataFrame, key: str, order: list[Column], most: int = 10) -> DataFrame:
    """The first distinct keys of the seeds in their order, at most ``most``: what :func:`expand_threads` is asked for."""
    best = seeds.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(F.struct(*order)).alias("_o"))
    return best.orderBy("_o", key).limit(most).select(key)


def sources_or_warning(readers: dict[str, object]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Frames of the sources that can be read, and a warning for each that can't: a failing source is as good as empty.

    Each reader is called and its first row read, so that a failure shows here.
    """
    good, warnings = {}, {}
    for name, reader in readers.items():
        try:
            df = reader()
            df.limit(1).collect()
            good[name] = df
        except Exception as e:  # whatever a source raises is its warning
            warnings[name] = f"{type(e).__name__}: {str(e)[:200]}"
    return good, warnings


def picked_files(df: DataFrame, *, by: list[str], name: str, base: Column, newness: str, kind: str, kinds: list[str], most: int = 3) -> DataFrame:
    """Of each group the files to read: one for each base name, by the order of the kinds, newest first, ``most`` of them.

    Kinds that are not listed are never taken. A base name goes to the first kind that has it.
    """
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    d = df.withColumn("_r", rank).where("_r > 0").withColumn("_b", base)
    one = d.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_r", F.desc(newness), name))).where("_n = 1")
    top = one.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_r", F.desc(newness), name))).where(F.col("place") <= most)
    return top.drop("_r", "_b", "_n")


def capped_threads(df: DataFrame, *, thread: str, time: str, id_col: str, threads: int = 15, rows: int = 30) -> DataFrame:
    """The rows of the threads that moved last, ``threads`` of them, each with its first ``rows`` rows."""
    last = df.where(F.col(thread) != "").groupBy(thread).agg(F.max(time).alias("_last")).orderBy(F.desc_nulls_last("_last"), thread).limit(threads)
    kept = df.join(F.broadcast(last.select(thread)), thread, "left_semi")  # at most ``threads`` rows
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(thread).orderBy(F.asc_nulls_last(time), id_col))).where(F.col("_n") <= rows).drop("_n")
