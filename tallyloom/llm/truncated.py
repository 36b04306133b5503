"""Texts cut off by field limits, and how often each source cuts.

Method: self-join by prefix over hashes of fixed-length prefixes. A text is cut into
units (lines and sentences; digits, quote marks, mentions and, in transcripts,
labels, hesitations and sound notes are taken out, so that copies meet). Only the
last unit of a text can be cut. Equal units are counted first; then every distinct
last unit is looked up as a strict prefix of longer units: the units are keyed by
their first characters, learn from the tails under this key which prefix lengths
matter, and meet the tails by the prefix of exactly these lengths. A tail that is
mostly a prefix of longer copies and rarely a whole unit is cut. Tails of which no
longer copy exists are judged by their last two words, joined in the same way with
the distinct word pairs of all units. A cut mark of the exporting system, a broken
last character and an unclosed JSON record need no copy.

Scale: the texts are read once; units are counted within each batch before any shuffle; every join is an
equality join on distinct units, no group is collected, nothing comes to the driver.

Defined cases: null and blank texts are not cut; a text that ends with sentence-final
punctuation is whole; equal texts are judged alike; an array of links is judged by its
last value, an empty or null array has none. Repeated rows are reported once for each
row id; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

#: Share of whole units under which a last word pair (or a whole unit without blanks) is cut.
WHOLE_SHARE = 0.02
#: The same for units in a script without blanks, which have fewer occurrences.
WHOLE_SHARE_CJK = 0.13
#: The same for the shapes of links.
WHOLE_SHARE_LINK = 0.12
#: Ends of units for each word pair, from which the share of ends of a pair is estimated (a unit has some six words).
ENDS_EXPECTED = 0.16
#: Bands of tail lengths; the lower end is the length of the key.
LENGTHS = ((1, 7), (8, 19), (20, 39), (40, 99), (100, 0))

# Marks that exporting systems leave where they cut, and a broken character.
CUT_MARK = re.compile(r"(?:（以降省略）|…?\s*\((?:rest omitted|truncated|message clipped)\)|\[truncated\]|\[\.\.\.\]|\ufffd)[\s\u200b]*\Z")
# A sound note, time or voice tag that a transcript opens and doesn't close.
OPEN_NOTE = re.compile(r"(?:\[[^\]\n]*|\([^)\n]*|(?<=[\s>:-])\*[^*\n]*|(?:^|\n)[^♪\n]*(?:♪[^♪\n]*♪[^♪\n]*)*♪[^♪\n]*|\n<(?:v(?![^\n]*</v>\s*\Z)[^\n]*)?)\Z")
_END = r"[.?!。？！\]}】»](?:</v>)?[\"'”)]*$"
_FILLER = re.compile(r"(?i)(?<![^\W\d_])(?:u+h*m+|u+h+|e+r+m*|h+m+|m{2,})(?![^\W\d_])[,.…]*\s?")
_NOTE = re.compile(r"[\[(*♪][^\[\]()*♪\n]*[\])*♪]+\s?")
_VOICE = re.compile(r"^(?:\[?00:00(?::00)?(?:\.000)?\]?[ \t]*)?(?:<v [^>\n]*>|(?:[^\s:：<\[(][^:：\n<]{0,40}?)(?:[:：][ \t]*| - ))(?![0\n])|</v>")
_MENTION = re.compile(r"@[^\W\d_][^\W\d_]+(?:-[^\W\d_]+)?(?:[ 　](?:(?=[A-ZÀ-Þ])[^\W\d_]+(?:-[^\W\d_]+)?|[㐀-鿿]+))?")
_DIGITS = str.maketrans("123456789", "0" * 9)
_BLANKS = " \t\r\u200b\u3000\xa0"


def units(text: str, spoken: bool) -> list[str]:
    """The units of a text, in order."""
    t = text.translate(_DIGITS)
    if spoken:
        t = _FILLER.sub("", _NOTE.sub("", t))
    for a in (". ", "? ", "! "):
        t = t.replace(a, a[0] + "\n")
    out = []
    for u in t.replace("。", "。\n").split("\n"):
        u = u.lstrip(">|" + _BLANKS).rstrip(_BLANKS)
        if u and spoken:
            u = _VOICE.sub("", u).strip(_BLANKS)
        if "@" in u:
            u = _MENTION.sub("", u).strip(_BLANKS)
        if u:
            out.append(u)
    return out


def surely_cut(text: str, spoken: bool) -> bool | None:
    """True for a cut that needs no copy, None for a whole record, else False."""
    end = text[-80:]
    if CUT_MARK.search(end) or (spoken and OPEN_NOTE.search(text[text.rfind("\n", 0, -1) :] if "\n" in text[:-1] else text)):
        return True
    if text[:1] in "{ \n" and text.lstrip().startswith('{"'):
        return None if end.rstrip().endswith("}") else True
    return False


def _count_units(rows: DataFrame) -> DataFrame:
    """(id, spoken, of, text) to (id, of, unit, inner): a row for each last unit, with inner 0 (-1 where
    the cut is sure), and for each distinct inner unit of a batch with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inner: Counter[str] = Counter()
            at, of, last, sure = [], [], [], []
            for i, (spoken, mine, text) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                cut_here = surely_cut(text, spoken)
                if cut_here is None:
                    continue
                if u := [""] if cut_here else units(text, spoken):
                    at.append(i)
                    of.append(mine)
                    sure.append(-1 if cut_here else 0)
                    last.append(u.pop())
                    inner.update(u)
            n = len(inner)
            ids = pa.concat_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.nulls(n, b.column(0).type)])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(of + [False] * n, pa.bool_()), pa.array(last + list(inner), pa.string()), pa.array(sure + list(inner.values()), pa.int64())],
                names=["id", "of", "unit", "inner"],
            )

    key = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {key}, of boolean, unit string, inner bigint")


def _prefix_counts(tails: DataFrame, all_units: DataFrame) -> DataFrame:
    """For each distinct tail the occurrences of units it is a strict prefix of: (tail, longer, inside),
    ``inside`` those that go on within the tail's last word.

    For each band of lengths the units are first counted by their beginning, one
    character longer than the band; a beginning then learns by its key which lengths
    occur and meets the tails by the prefixes of these lengths.
    """
    parts = []
    for low, high in LENGTHS:
        size = F.length("tail")
        of_band = tails.where((size >= low) & ((size <= high) if high else F.lit(True)))
        sizes = of_band.select(F.substring("tail", 1, low).alias("key"), size.alias("size")).groupBy("key").agg(F.collect_set("size").alias("sizes"))  # at most one entry for each length
        heads = all_units.select(F.substring("unit", 1, high + 1).alias("head"), "n").groupBy("head").agg(F.sum("n").alias("n")) if high else all_units.select(F.col("unit").alias("head"), "n")
        met = heads.where(F.length("head") > low).withColumn("key", F.substring("head", 1, low)).join(sizes, "key").select("head", "n", F.explode("sizes").alias("size"))
        within = F.expr("substring(head, size, 2)").rlike(r"^[\p{L}\p{M}]{2}$")
        parts.append(met.where(F.length("head") > F.col("size")).select(F.expr("substring(head, 1, size)").alias("tail"), "n", F.when(within, F.col("n")).otherwise(0).alias("inside")))
    prefixes = parts[0]
    for p in parts[1:]:
        prefixes = prefixes.unionByName(p)
    return prefixes.groupBy("tail").agg(F.sum("n").alias("longer"), F.sum("inside").alias("inside"))


def _pair_counts(tails: DataFrame, all_units: DataFrame) -> DataFrame:
    """For the last two words of each tail: (tail, pair_on, pair_end) occurrences that go on and that end a unit."""
    words = F.split("unit", r"[\s　]+")
    w = all_units.select("n", words.alias("w"))
    pairs = w.select("n", F.size("w").alias("size"), "w", F.posexplode("w").alias("at", "last"))
    pairs = pairs.select("n", F.when(F.col("at") > 0, F.get("w", F.col("at") - 1)).otherwise("^").alias("prev"), "last", (F.col("at") == F.col("size") - 1).alias("ends"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    pairs = pairs.groupBy("prev", "last").agg(n(F.col("ends")).alias("end"), n(~F.col("ends")).alias("on"))
    tw = F.split("tail", r"[\s　]+")
    t = tails.select("tail", F.when(F.size(tw) > 1, F.get(tw, F.size(tw) - 2)).otherwise("^").alias("prev"), F.try_element_at(tw, F.lit(-1)).alias("part"))
    # a pair learns by its first word which lengths of the second matter, and meets them by equality on both
    sizes = t.select("prev", F.length("part").alias("size")).groupBy("prev").agg(F.collect_set("size").alias("sizes"))  # at most one entry for each length of a word
    met = pairs.join(sizes, "prev").select("prev", "last", "on", "end", F.explode("sizes").alias("size")).where(F.length("last") >= F.col("size"))
    same = F.length("last") == F.col("size")
    found = met.groupBy("prev", F.expr("substring(last, 1, size)").alias("part")).agg(
        F.sum(F.when(same, F.col("on")).otherwise(F.col("on") + F.col("end"))).alias("pair_on"), F.sum(F.when(same, F.col("end")).otherwise(0)).alias("pair_end")
    )
    return t.join(found, ["prev", "part"]).select("tail", "pair_on", "pair_end")


def cut_tails(counted: DataFrame) -> DataFrame:
    """The open last units of ``counted`` (unit, inner), distinct, with their evidence."""
    whole = cut(counted.groupBy("unit").agg(F.sum(F.greatest("inner", F.lit(1))).alias("n"), F.max(F.col("inner") == 0).alias("last")))
    open_tails = cut(whole.where(F.col("last") & ~F.col("unit").rlike(_END)).select(F.col("unit").alias("tail"), F.col("n").alias("whole")))
    longer = _prefix_counts(open_tails, whole.select("unit", "n"))
    # tails without a blank are judged by their copies alone
    pairs = _pair_counts(open_tails.where(F.col("tail").rlike(r"\s")), whole.select("unit", "n"))
    return open_tails.join(longer, "tail", "left").join(pairs, "tail", "left").na.fill(0, ["longer", "inside", "pair_on", "pair_end"])


def judge(counts: DataFrame) -> DataFrame:
    """Distinct tails that are cut.

    A cut tail goes on elsewhere (a longer copy, or its last two words inside longer
    units) and is hardly ever a whole end. A copy that goes on within the last word is
    enough, however rare the word is; else the share of ends among the occurrences of the
    pair must be small. The share is estimated from :data:`ENDS_EXPECTED` ends of one
    occurrence before any is seen, so a pair seen a few times only proves nothing.
    """
    whole, longer, inside, on, end = (F.col(c) for c in ("whole", "longer", "inside", "pair_on", "pair_end"))
    spaced = F.col("tail").rlike(r"\s")
    cjk = F.col("tail").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]$")
    others = end - F.least(whole, F.lit(2))  # a tail, or its row ingested twice, is no evidence for itself
    by_pair = F.greatest(others, F.lit(0)) + ENDS_EXPECTED < WHOLE_SHARE * (on + F.greatest(others, F.lit(0)) + 1)
    by_copy = (longer > 0) & (whole < F.when(cjk, WHOLE_SHARE_CJK).otherwise(WHOLE_SHARE) * (whole + longer))
    by_word = (inside > 0) & ((whole < 3) | (whole < WHOLE_SHARE * (whole + inside))) & ((others <= 0) | (others < WHOLE_SHARE * (on + others))) & ~cjk
    return counts.where(F.when(spaced, by_word | (by_pair & ((longer > 0) | (whole < 3) | (whole < WHOLE_SHARE * on)))).otherwise(by_copy))


def _or(c: Column | None, value: bool) -> Column:
    return F.lit(value) if c is None else c


def cut_texts(df: DataFrame, *, id_col: str, text_col: str, transcript: Column | None = None, of: Column | None = None) -> DataFrame:
    """Ids of the rows whose text was cut off before its end.

    ``of``: only these rows are judged, still against the texts of all rows.
    """
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), _or(transcript, False).alias("spoken"), _or(of, True).alias("of")).where(text != "")
    counted = cut(_count_units(rows.select("id", "spoken", "of", "text")))
    sure = counted.where((F.col("inner") == -1) & F.col("of")).select("id")
    tails = counted.where((F.col("inner") == 0) & F.col("of")).select("id", F.col("unit").alias("tail"))
    found = judge(cut_tails(counted.where("inner >= 0").select("unit", "inner"))).select("tail")
    return sure.unionByName(tails.join(found, "tail", "left_semi").select("id"))


def cut_links(df: DataFrame, *, id_col: str, links_col: str) -> DataFrame:
    """Ids of the rows whose last link was cut off: a strict prefix of the shapes of whole links, or a broken escape."""
    last = F.regexp_replace(F.try_element_at(links_col, F.lit(-1)), r"[\s,;|\"'<>]+$", "")
    last = F.regexp_extract(last, r"([^\s\"'<>|]+)$", 1)
    last = F.regexp_extract(last, r"((?:[A-Za-z][A-Za-z0-9+.\-]*://|[A-Za-z]+/)?(?:(?![,;][A-Za-z][A-Za-z0-9+.\-]*(?:://|/)).)*)$", 1)
    shape = F.translate(last, "0123456789abcdef", "x" * 16)
    rows = df.where(F.size(links_col) > 0).select(F.col(id_col).alias("id"), shape.alias("tail"), last.rlike(r"%[0-9A-Fa-f]?$").alias("broken")).where(F.col("tail") != "")
    rows = cut(rows)
    sure, rows = rows.where("broken").select("id"), rows.where("not broken")
    tails = rows.groupBy("tail").agg(F.count("*").alias("whole"))
    longer = _prefix_counts(tails, tails.select(F.col("tail").alias("unit"), F.col("whole").alias("n")))
    found = tails.join(longer, "tail").where(F.col("whole") < WHOLE_SHARE_LINK * (F.col("whole") + F.col("longer")))
    return sure.unionByName(rows.join(found.select("tail"), "tail", "left_semi").select("id"))


def truncated(df: DataFrame, *, id_col: str = "_id", text_col: str = "content", links_col: str = "links", transcript: Column | None = None) -> DataFrame:
    """``(id_col, field)`` of each value cut off before its end."""
    a = cut_texts(df, id_col=id_col, text_col=text_col, transcript=transcript).select(F.col("id").alias(id_col), F.lit(text_col).alias("field"))
    b = cut_links(df, id_col=id_col, links_col=links_col).select(F.col("id").alias(id_col), F.lit(links_col).alias("field"))
    return a.unionByName(b)


def truncation_rates(df: DataFrame, *, id_col: str = "_id", source_col: str = "source", **kw) -> DataFrame:
    """Per source: rows, rows with a cut value and their share."""
    found = truncated(df, id_col=id_col, **kw).select(id_col).distinct().withColumn("cut", F.lit(1))
    return df.select(id_col, source_col).join(found, id_col, "left").groupBy(source_col).agg(F.count("*").alias("rows"), F.count("cut").alias("rows_cut"), (F.count("cut") / F.count("*")).alias("share"))

