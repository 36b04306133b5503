"""Numbers and amounts as column expressions. Null and zero are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Decimal of a written number: separators, currency, percent, triangles and brackets for minus."""
    t = F.translate(F.trim(c), "０１２３４５６７８９．－，", "0123456789.-,")
    negative = t.rlike(r"^[△▲(\-]")
    bare = F.regexp_replace(t, r"[^0-9.]", "")
    n = F.when(bare.rlike(r"^\d+(\.\d+)?$"), bare.try_cast("decimal(30,6)"))
    return F.when(negative, -n).otherwise(n)


def safe_div(a: Column, b: Column, digits: int = 2) -> Column:
    """Quotient rounded half to even; null where a side is null or the base is zero."""
    return F.bround(F.try_divide(a, b), digits)


def signed_text(n: Column) -> Column:
    """With separators and an explicit sign; zero without sign, null as a dash."""
    return F.when(n.isNull(), F.lit("-")).when(n > 0, F.concat(F.lit("+"), F.format_number(n, 0))).otherwise(F.format_number(n, 0))


def apply_change(current: Column, *, absolute: Column, plus: Column, percent: Column, rate: Column) -> Column:
    """New value: absolute, else plus amount, else plus percent, else times rate, else as it is; cut to whole."""
    return F.coalesce(absolute, current + plus, (current + current * percent / 100), current * rate, current).cast("bigint")


def prorated(amount: Column, start: Column) -> Column:
    """Share of a monthly amount for the days left from ``start`` on, rounded up."""
    days = F.dayofmonth(F.last_day(start))
    return F.ceil(amount * (days - F.dayofmonth(start) + 1) / days)


def floor_tax(base: Column, rate: Column) -> Column:
    return F.floor(base * rate)


def included_tax(amount: Column, rate: str = "1.10") -> Column:
    """Tax inside an amount: amount less the amount without tax, rounded half to even."""
    return (amount - F.bround(amount / F.lit(rate).cast("decimal(5,2)"), 0)).cast("bigint")


def range_bounds(c: Column) -> Column:
    """Half-open interval of a label such as ``10-20``, ``under 10``, ``over 50``."""
    two = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1)
    a, b = F.get(two, F.lit(0)).try_cast("double"), F.get(two, F.lit(1)).try_cast("double")
    under, over = c.rlike(r"(?i)under|below|less|未満|以下"), c.rlike(r"(?i)over|above|more|以上|\+$")
    low = F.when(b.isNotNull(), a).when(under, 0.0).otherwise(a)
    high = F.when(b.isNotNull(), b).when(under, a).when(over, F.lit(float("inf"))).otherwise(a)
    return F.when(a.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def overlap(low: Column, high: Column, low2: Column, high2: Column) -> Column:
    """Width that two intervals share, at least zero."""
    return F.greatest(F.lit(0).cast("double"), F.least(high, high2).cast("double") - F.greatest(low, low2).cast("double"))


def bin_label(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the half-open bin; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        out = F.when((value >= low) & (value < high), F.lit(label)).otherwise(out)
    return out


def unit_scaled(value: Column, limit: float, factor: float) -> Column:
    """Values under the limit are taken to be in the larger unit."""
    return F.when(value < limit, value * factor).otherwise(value)


def reduced_price(value: Column, limit: int = 10_000) -> Column:
    """A value above the limit divided by it until it is not above, in closed form."""
    n = F.when(value > limit, F.ceil(F.log(value / limit) / F.log(F.lit(float(limit))))).otherwise(0)
    return value / F.pow(F.lit(float(limit)), n)


def best_band(low: Column, high: Column, bands: list[tuple[str, float, float]]) -> Column:
    """Name of the band that an interval overlaps most, the first on ties; null without overlap."""
    widths = [(name, overlap(low, high, F.lit(a), F.lit(b))) for name, a, b in bands]
    most = F.greatest(*(w for _, w in widths)) if len(widths) > 1 else widths[0][1]
    out = F.lit(None).cast("string")
    for name, w in reversed(widths):
        out = F.when((w == most) & (w > 0), F.lit(name)).otherwise(out)
    return out


def decade_of(label: Column, low: int = 20, high: int = 60) -> Column:
    """``struct(decade, dropped)`` of an age label: the decade of its upper bound, or the label where that is out of range or missing."""
    ages = F.regexp_extract_all(label, F.lit(r"(\d+)"), 1)
    decade = F.floor(F.array_max(F.transform(ages, lambda x: x.try_cast("int"))) / 10) * 10
    ok = F.coalesce((decade >= low) & (decade <= high), F.lit(False))
    return F.struct(F.when(ok, decade).cast("int").alias("decade"), F.when(~ok, label).alias("dropped"))
