"""Dates and months as column expressions; unreadable input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First years of Japanese eras less one.
ERAS = {"令和": 2018, "R": 2018, "平成": 1988, "H": 1988, "昭和": 1925, "S": 1925}


def year_month(c: Column) -> Column:
    """``YYYYMM`` of the first year 20yy with a month after it."""
    y = F.regexp_extract(c, r"(20\d\d)\D{0,3}(0?[1-9]|1[0-2])(?!\d)", 1)
    m = F.regexp_extract(c, r"(20\d\d)\D{0,3}(0?[1-9]|1[0-2])(?!\d)", 2)
    packed = F.regexp_extract(c, r"(?<!\d)(20\d\d(?:0[1-9]|1[0-2]))(?:\d\d)?(?!\d)", 1)
    return F.when(packed != "", packed).when(y != "", F.concat(y, F.lpad(m, 2, "0")))


def any_timestamp(c: Column, zone: str = "+09:00") -> Column:
    """Time of ISO text, epoch seconds or milliseconds; a text without offset is of ``zone``."""
    number = F.regexp_extract(c, r"^\s*(\d{9,13}(?:\.\d+)?)\s*$", 1).try_cast("decimal(20,6)")
    seconds = F.when(number >= 100_000_000_000, number / 1000).otherwise(number)
    text = F.regexp_replace(F.trim(c), r"([+-]\d\d)(\d\d)$", "$1:$2")
    text = F.when(text.rlike(r"(?:Z|[+-]\d\d:\d\d)$") | ~text.rlike(r"\d:\d\d"), text).otherwise(F.concat(text, F.lit(zone)))
    day = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(text, F.lit(f"T00:00:00{zone}"))).otherwise(text)
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("bigint")), day.try_cast("timestamp"))


def era_date(c: Column) -> Column:
    """Date of an era year, month and day; the first year may be written in words."""
    pattern = r"(令和|平成|昭和|R|H|S)\s*(元|\d{1,2})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})"
    era = F.regexp_extract(c, pattern, 1)
    first = F.lit(None).cast("int")
    for name, year in ERAS.items():
        first = F.when(era == name, F.lit(year)).otherwise(first)
    year = F.when(F.regexp_extract(c, pattern, 2) == "元", 1).otherwise(F.regexp_extract(c, pattern, 2).try_cast("int"))
    text = F.concat_ws("-", (first + year).cast("string"), F.lpad(F.regexp_extract(c, pattern, 3), 2, "0"), F.lpad(F.regexp_extract(c, pattern, 4), 2, "0"))
    return F.when(first.isNotNull(), text.try_cast("date"))


def loose_date(c: Column) -> Column:
    """Date of many spellings: ISO, slashes, dots, packed, kanji, eras."""
    p = r"(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})"
    parts = F.concat_ws("-", F.regexp_extract(c, p, 1), F.lpad(F.regexp_extract(c, p, 2), 2, "0"), F.lpad(F.regexp_extract(c, p, 3), 2, "0"))
    packed = F.regexp_replace(F.regexp_extract(c, r"(?<!\d)((?:19|20)\d{6})(?!\d)", 1), r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")
    return F.coalesce(parts.try_cast("date"), packed.try_cast("date"), era_date(c))


def within_days(a: Column, b: Column, days: int, *, null_passes: bool) -> Column:
    """Inclusive window between two dates; ``null_passes`` makes it lenient."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(null_passes))


def same_month(a: Column, b: Column) -> Column:
    """Same ``YYYYMM``; an unreadable month is the same as any."""
    return F.coalesce(a == b, F.lit(True))


def renewal_period(start: Column, end: Column) -> Column:
    """The period of the same number of months that follows, end of month clamped."""
    months = F.round(F.months_between(F.date_add(end, 1), start)).cast("int")
    first = F.date_add(end, 1)
    return F.struct(first.alias("start"), F.date_sub(F.add_months(first, months), 1).alias("end"))


def month_end(d: Column, ahead: int = 0) -> Column:
    return F.last_day(F.add_months(d, ahead))


def default_end(start: Column, end: Column, hours: int = 1) -> Column:
    return F.coalesce(end, start + F.make_dt_interval(hours=F.lit(hours)))


def year_candidates(c: Column, low: int = 1985, high: int = 2100) -> Column:
    """Years in a text within a range, each once, sorted."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: (y >= low) & (y <= high))))


def month_starts(first: Column, last: Column) -> Column:
    """First days of the months between two dates."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


def business_days(first: Column, last: Column, holidays: list[str] | None = None) -> Column:
    """Days between two dates without weekends and holidays (a short fixed list)."""
    days = F.sequence(first, last, F.expr("interval 1 day"))
    off = F.array(*(F.lit(h).cast("date") for h in holidays or [])) if holidays else None
    return F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7) & (~F.array_contains(off, d) if off is not None else F.lit(True)))


def era_text(d: Column) -> Column:
    """A date in the present era as people write it; null before its first year."""
    year = F.year(d) - ERAS["令和"]
    return F.when(year >= 1, F.concat(F.lit("令和"), year.cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日")))
