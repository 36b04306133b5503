"""Keys and parts of text as column expressions.

Every function takes and returns columns. Built-in expressions are used throughout; the
one exception is Unicode normalisation, which Spark lacks: ``nfkc`` is an Arrow-batched
UDF, meant to be materialised once as a ``*_norm`` column.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"(?<![A-Za-z0-9._%\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
URL = r"https?://[^\s<>\"'|]+"

# Legal forms and honorifics that names are compared without.
LEGAL_FORMS = r"(?i)株式会社|有限会社|合同会社|\(株\)|\(有\)|㈱|㈲|\b(?:gesellschaft mbh|incorporated|corporation|limited|company|gmbh|llc|l\.l\.c\.?|ltd\.?|inc\.?|corp\.?|k\.k\.?|co\.)(?=\s|$|[.,])"
HONORIFICS = r"(?:様|さん|氏|殿|御中)$|^(?i:mr|mrs|ms|mx|dr)\.?\s+"


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Compatibility composition; null stays null."""
    return F.pandas_udf(_nfkc, "string")(c)


def fold(text: str) -> str:
    """Compatibility composition and case folding of a Python text."""
    return unicodedata.normalize("NFKC", text).casefold()


def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold(x))


def match_key(c: Column) -> Column:
    """The key on which texts are searched: NFKC and case folding, so that width and case don't matter.

    An Arrow-batched UDF; tables that are searched often keep it as a column of their own.
    """
    return F.pandas_udf(_fold, "string")(c)


def clean_participant(c: Column) -> Column:
    """A participant's name without bracketed remarks and honorifics."""
    bare = F.regexp_replace(c, r"[(（\[][^)）\]]*[)）\]]", "")
    return F.trim(F.regexp_replace(F.trim(bare), HONORIFICS, ""))


def squash(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"[\s\u3000]+", "")


def compare_key(c: Column) -> Column:
    """Lower case, single blanks, trimmed: the key on which SQL checks can agree."""
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\u3000]+", " ")))


def item_key(c: Column) -> Column:
    """Key of an item description: runs of digits count as one sign."""
    return F.regexp_replace(squash(F.lower(c)), r"[0-9]+", "#")


def party_key(c: Column, variants: dict[str, str] | None = None) -> Column:
    """Key of a payee or vendor: no legal form, leading digits, separators or case; variant
    characters folded to one form."""
    k = F.regexp_replace(c, LEGAL_FORMS, "")
    k = F.lower(F.regexp_replace(k, r"^[0-9]+[\s._-]*|[\s\u3000・･.,\-_/&()（）]+", ""))
    for old, new in (variants or {}).items():
        k = F.translate(k, old, new)
    return k


# Characters of company names that are written in two ways, each with the form that stands for both.
VARIANTS = {
    "輛": "輌", "両": "輌", "濱": "浜", "邊": "辺", "邉": "辺", "齋": "斎", "齊": "斎", "斉": "斎", "﨑": "崎", "曾": "曽", "冨": "富", "廣": "広", "澤": "沢",
    "瀨": "瀬", "龍": "竜", "嶋": "島", "髙": "高", "圓": "円", "國": "国", "學": "学", "眞": "真", "榮": "栄", "壽": "寿", "德": "徳", "籐": "藤", "檜": "桧",
}
# Legal forms that keys of payees and vendors are without.
PAYEE_FORMS = r"株式会社|有限会社|合同会社|一般社団法人|公益社団法人|公益財団法人|\(株\)|\(有\)|\(同\)|㈱|㈲"
VENDOR_NOISE = r"株式会社|有限会社|合同会社|\(株\)|（株）|\(有\)|（有）|㈱|㈲|支店|営業所|様|御中|・|[\s\u3000]"


def payee_key(c: Column) -> Column:
    """Key of a payee: NFKC, without blanks, legal forms and dots or hyphens, variant characters folded."""
    k = F.regexp_replace(squash(nfkc(c)), f"{PAYEE_FORMS}|[・･\\-‐]", "")
    return F.translate(k, "".join(VARIANTS), "".join(VARIANTS.values()))


def vendor_key(c: Column) -> Column:
    """Key of a vendor: without leading digits, legal forms, branch words, honorifics, dots, blanks and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^\d+", ""), VENDOR_NOISE, ""))


def branch_key(c: Column, drop: tuple[str, ...] = ("支店", "チーム", "営業"), aliases: dict[str, str] | None = None) -> Column:
    """Key of a branch: NFKC, separators and the given words dropped, lower case, then aliases resolved."""
    k = F.regexp_replace(nfkc(c), r"[ \u3000\t\r\n\-_./\\\\・]", "")
    k = F.lower(F.regexp_replace(k, "|".join(drop), ""))
    for a, b in (aliases or {}).items():
        k = F.when(k == a, F.lit(b)).otherwise(k)
    return k


def vehicle_key(c: Column) -> Column:
    """Number of a vehicle: the last run of three or four digits, as four digits; null without one."""
    runs = F.regexp_extract_all(squash(nfkc(c)), F.lit(r"(\d{3,4})"), 1)
    return F.lpad(F.try_element_at(runs, F.lit(-1)), 4, "0")


def file_identity(name: Column, url: Column) -> Column:
    """One key for a file from any route: its name and its address without query."""
    return F.concat_ws("\n", F.trim(name), canonical_url(F.trim(url)))


def person_key(c: Column) -> Column:
    """Key of a person: no honorific, bracketed remark, case or blanks."""
    k = F.regexp_replace(F.trim(c), r"[(（\[][^)）\]]*[)）\]]", "")
    return F.lower(squash(F.regexp_replace(F.trim(k), HONORIFICS, "")))


def name_tokens(c: Column) -> Column:
    """Lower-case parts of a name; camelCase, blanks, dots and hyphens divide."""
    k = F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(k), r"[\s\u3000._,\-]+"), lambda x: x != "")


def lot_key(c: Column) -> Column:
    """Lot number: all runs of digits joined by a hyphen; null without digits."""
    runs = F.regexp_extract_all(F.translate(c, "０１２３４５６７８９", "0123456789"), F.lit(r"(\d+)"), 1)
    return F.when(F.size(runs) > 0, F.array_join(runs, "-"))


def town_key(c: Column) -> Column:
    """Town with its block: a digit before the block sign is written as a numeral."""
    k = squash(F.translate(c, "０１２３４５６７８９", "0123456789"))
    for d, n in zip("123456789", "一二三四五六七八九", strict=True):
        k = F.regexp_replace(k, rf"(?<![0-9]){d}(?=丁目)", n)
    return k


def emails(c: Column) -> Column:
    """All addresses of a text in order, lower case, each once; null gives an empty array."""
    return F.coalesce(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({EMAIL})"), 1), F.lower)), F.array().cast("array<string>"))


def first_email(c: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(c, f"({EMAIL})", 1), F.lit("")))


def display_names(c: Column) -> Column:
    """Display names of a header, quotes and addresses taken away, each once."""
    parts = F.transform(F.split(c, r"[;,\n]\s*(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda x: F.trim(F.regexp_replace(x, rf"<[^>]*>|\"|{EMAIL}", "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def domain_of(address: Column) -> Column:
    """Lower-case domain of an address; null without one."""
    return F.nullif(F.lower(F.regexp_extract(address, r"@([A-Za-z0-9.\-]+)", 1)), F.lit(""))


def domains_in_order(*cols: Column) -> Column:
    """Distinct domains over several headers in their order."""
    return F.array_distinct(F.transform(F.flatten(F.array(*(emails(c) for c in cols))), lambda e: F.split_part(e, F.lit("@"), F.lit(2))))


def valid_person(address: Column, machines: str = r"^(?:no-?reply|postmaster|mailer-daemon|notifications?|alerts?|[a-z-]*bot)@") -> Column:
    """The lower-case address of a person; null for anything else."""
    a = F.lower(F.trim(address))
    return F.when(a.contains("@") & ~a.rlike(machines), a)


def urls(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({URL})"), 1))


def canonical_url(c: Column) -> Column:
    """Without query, fragment, trailing slash and ``www.``; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", "")
    host = F.lower(F.regexp_extract(bare, r"^[a-zA-Z]+://(?:www\.)?([^/]+)", 1))
    return F.concat(F.lit("https://"), host, F.regexp_replace(bare, r"^[a-zA-Z]+://[^/]+", ""))


def url_host(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://(?:www\.)?([^/:]+)", 1)), F.lit(""))


def url_class(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the first pattern that fits, else null."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def strip_html(c: Column) -> Column:
    """Text of markup: scripts dropped, breaks kept as newlines, the common entities decoded."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>|</div>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&#37;", "%"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t)


def versioned_name(name: Column, stamp: Column) -> Column:
    """``stem_YYYYMMDD.ext`` of a file name and a time."""
    ext = F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,5})$", 1)
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    return F.concat(stem, F.lit("_"), F.date_format(stamp, "yyyyMMdd"), ext)


def base_name(name: Column) -> Column:
    """File name without version, copy mark, date and extension."""
    stem = F.regexp_replace(F.lower(name), r"\.[a-z0-9]{1,5}$", "")
    return F.trim(F.regexp_replace(stem, r"[\s_-]*(?:v\d+(?:\.\d+)*|\(\d+\)|copy|final|\d{8}|\d{4})$", ""))


def stable_name(*cols: Column) -> Column:
    """A name that depends on the values alone."""
    return F.substring(F.md5(F.concat_ws("\x1f", *cols)), 1, 16)


def chunks(c: Column, size: int) -> Column:
    """A text in pieces of ``size`` characters."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def windows_around(c: Column, words: list[str], radius: int, head: int, most: int = 3) -> Column:
    """The head of a text and up to ``most`` pieces around the first places of the words."""
    at = [F.locate(w, F.lower(c)) for w in words]
    places = F.slice(F.array_sort(F.filter(F.array(*at), lambda x: x > head)), 1, most)
    return F.concat(F.array(F.substring(c, 1, head)), F.transform(places, lambda p: F.substring(c, F.greatest(p - radius, F.lit(1)), F.lit(2 * radius))))


def truncate_marked(c: Column, size: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit(mark))).otherwise(c)


def capped_bullets(c: Column, most: int, sep: str = "\n") -> Column:
    """At most ``most`` non-blank lines."""
    return F.array_join(F.slice(F.filter(F.split(c, sep), lambda x: F.trim(x) != ""), 1, most), sep)
