"""Variant spellings of names: each attached to the person or organisation it means.

Method: noisy-channel attribution. The spellings of the column are counted; those that
are names of the table of people are the canonical forms, ranked by how often they are
written, and that count is the prior of whom they mean. A spelling is explained by a
channel from a canonical form: change of case or width, honorific or title, company in
brackets, reordered parts, initials, account handles, nicknames, romanisation, legal
form, branch or abbreviated words of an organisation, and typing errors (one edit,
transpositions included). The probability of each of these changes, the share of values
that mean nobody of the table, and the priors are learned from the column by expectation
and maximisation over all candidates of all distinct spellings. The posterior of a
candidate is its prior times the likelihood of its changes, times what the row, its
thread and its project tell (an address or a full name of the candidate). A spelling
goes to its maximum posterior; nobody competes with the probability of the letters.

Scale: forms of people and analyses of distinct spellings meet by equality joins, typing
errors by joins on the keys with one sign deleted; no index goes with the tasks but the
romanisation of name parts and the company labels (people are checked to be few).
Frequencies are counted with map-side combine; only spellings with rivals meet the
evidence of their rows, by equality joins on (row, address), (thread, address) and
(project, address). The driver gets one count for each kind of change.

Defined cases: null, empty and blank values have no row; a value with an address is
left out; equal spellings may mean different people in different rows; ties go to the
smaller address; an empty table of people gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.turns import TITLES, romaji
from tallyloom.operators.packed import LEGAL, all_values
from tallyloom.session import bounded_rows, cut

PEOPLE_LIMIT = 50_000

#: Kinds of changes; their probabilities before they are learned, and expectations added to the counts of each.
CHANGES = ("case", "alias", "order", "title", "company", "initial", "handle", "nick", "roman", "typo", "legal", "branch", "short", "part")
START, SMOOTH, ROUNDS = 0.07, 1.0, 3
#: Log probability of a sign of a spelling that means nobody; of the place and sign of a typing error for each sign.
SIGN, NOBODY = math.log(1 / 30), 0.05
#: Evidence of the row, the thread and the project, as added log odds.
IN_ROW, IN_THREAD, PROJECT_WEIGHT = 9.0, 3.0, 1.0
#: Signs from which a key is looked up with a typing error.
LEAST_TYPO = 5

# Short forms of given names, and honorifics.
NICKNAMES = {
    "elizabeth": "liz lizzie beth betty eliza", "katherine": "kate kathy katie kat", "robert": "rob bob bobby bert", "richard": "rick rich dick ricky", "william": "will bill billy liam",
    "michael": "mike mick mikey", "jennifer": "jen jenny jenn", "nicholas": "nick nicky nico", "thomas": "tom tommy", "christopher": "chris kit topher", "margaret": "maggie meg peggy marge",
    "patricia": "pat patty trish tricia", "susan": "sue susie suzy", "daniel": "dan danny", "benjamin": "ben benny benji", "samuel": "sam sammy", "joseph": "joe joey", "edward": "ed eddie ted ned",
    "andrew": "andy drew", "matthew": "matt matty", "gregory": "greg", "rebecca": "becky becca bec", "anthony": "tony", "alexander": "alex sandy", "james": "jim jimmy jamie", "john": "jack johnny", "charles": "charlie chuck",
    "david": "dave davy", "stephen": "steve", "steven": "steve", "timothy": "tim", "jonathan": "jon", "deborah": "deb debbie", "victoria": "vicky tori", "catherine": "cathy kate", "abigail": "abby", "alexandra": "alex sandra", "frederick": "fred freddie", "lawrence": "larry", "philip": "phil", "raymond": "ray", "ronald": "ron", "theodore": "ted theo", "walter": "walt", "barbara": "barb", "christine": "chris tina", "dorothy": "dot", "florence": "flo", "judith": "judy", "pamela": "pam", "sandra": "sandy", "teresa": "terry tess", "leopold": "leo", "rosalind": "ros roz", "florian": "flo", "johanna": "hanna jo", "zoltan": "zoli", "gustav": "gus", "dmitri": "dima mitya",
}
_HONORIFIC = re.compile(r"\s*(?:様|さん|氏|先生|殿|君|ちゃん)$")
_WORDY = {"gesellschaft", "mbh", "kabushiki", "kaisha", "l.l.c", "company", "corporation"}
_LEGAL_FORMS = re.compile(r"(?i)[\s,]*\b(?:limited|ltd|incorporated|inc|l\.?l\.?c|gesellschaft mbh|gmbh|k\.?k|kabushiki kaisha|corporation|corp|co|plc|ag|s\.a|株式会社|有限会社)\b\.?(?=\s|$)")


def fold(text: str) -> str:
    """Width, case and accents taken away."""
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).replace("ø", "o").replace("ß", "ss"))
    return "".join(c for c in t if not unicodedata.combining(c) or "゙" <= c <= "゚").casefold()


def tidy(text: str) -> str:
    t = re.sub(r"[\s　]+", " ", text).strip(" \t\"'“”")
    return " ".join(t.split())


def one_edit(a: str, b: str) -> bool:
    """Damerau-Levenshtein distance of at most one."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def label(company: str | None, email: str) -> str:
    """What stands in brackets for the company of an address."""
    return fold((company or email.split("@")[-1]).split(".")[0])


def forms(name: str | None, email: str | None, aliases: list[str] | None, kana: dict[str, str]) -> dict[str, tuple[tuple[str, ...], bool]]:
    """Keys under which a row of the people may be written: changes made, and whether typing errors are sought."""
    out: dict[str, tuple[tuple[str, ...], bool]] = {}
    if not name or not email:
        return out

    def add(form: str, *changes: str, typo: bool = False) -> None:
        f = fold(tidy(form))
        if f and (f not in out or len(changes) < len(out[f][0])):
            out[f] = (changes, typo or (f in out and out[f][1]))

    whole = tidy(name)
    parts = whole.split(" ")
    add(whole, "case", typo=True)
    for a in aliases or []:
        if a and a != name:
            add(a, "alias")
    if _LEGAL_FORMS.search(whole) or any(w.casefold().strip(".") in LEGAL for w in parts):
        bare = _LEGAL_FORMS.sub("", whole).strip()
        add(bare, "legal", typo=True)
        words = fold(bare).split()
        for w in words[1:]:
            out.setdefault(f"{_SHORT}{words[0]}|{w[0]}", (("short",), False))
        return out
    if len(parts) != 2:
        return out
    roman: tuple[str, ...] = ()
    if re.search(r"[぀-鿿]", whole):
        sur, giv = parts
        add(sur + giv, "case")
        if sur not in kana or giv not in kana:
            return out
        given, surname = kana[giv], kana[sur]
        add(sur, "part")
        add(giv, "part")
        roman = ("roman",)
    else:
        given, surname = parts
    for k, g in enumerate([given, *NICKNAMES.get(fold(given), "").split()]):
        by = (*roman, "nick") if k else roman
        add(f"{g} {surname}", *(by or ("case",)), typo=True)
        for form in (f"{surname} {g}", f"{surname}, {g}"):
            add(form, *by, "order", typo=True)
        i = g[:1]
        for form in (f"{i}. {surname}", f"{i} {surname}", f"{surname} {i}.", f"{surname} {i}", f"{surname}, {i}.", f"{g} {surname[:1]}.", f"{g} {surname[:1]}"):
            add(form, *by, "initial")
        a, s = fold(g), fold(surname)
        for form in (a[:1] + s, f"{a}.{s[:1]}", f"{a}.{s}", f"{s}.{a[:1]}", f"{a[:1]}.{s}", f"{a}{s[:1]}", f"{a}_{s}", f"{s}{a[:1]}"):
            add(form, *by, "handle")
        add(g, *by, "part")
    add(surname, *roman, "part")
    add(email.split("@")[0], "handle")
    return out


#: Marks keys of organisations with abbreviated words: first word and a letter of a later one.
_SHORT = "\x1f"


def analyses(value: str, labels: set[str]) -> list[tuple[str, tuple[str, ...], str | None, str]]:
    """(key, changes taken back, company, text) under which a spelling is looked up."""
    text, company, extra = tidy(value), None, []
    if m := re.fullmatch(r"(.+?)\s*[(\[（]([^()\[\]（）]+)[)\]）]", text):
        text, company = m[1], fold(m[2])
        extra.append("company")
    if (t := _HONORIFIC.sub("", text)) != text:
        text = t
        extra.append("title")
    first, _, rest = text.partition(" ")
    if rest and first.strip(".").casefold() in TITLES:
        text = rest
        extra.append("title")
    company = company if company in labels else None
    branch = re.sub(r"\s+[-–]\s+[^-–]+$", "", text)
    bare = _LEGAL_FORMS.sub("", branch).strip(" ,")
    found: dict[str, tuple[str, ...]] = {}
    for t, changes in ((text, ()), (branch, ("branch",)), (bare, ("branch",) if bare == branch != text else ("legal",) if branch == text else ("branch", "legal"))):
        found.setdefault(fold(t), changes)
    if m := re.fullmatch(r"(.+?),\s*(.+)", bare):
        found.setdefault(fold(f"{m[2]} {m[1]}"), ("order",))
    out = [(k, (*extra, *changes), company, k) for k, changes in found.items() if k]
    words = fold(bare).split()
    if len(words) >= 2 and any(w.endswith(".") for w in words):
        out.append((f"{_SHORT}{words[0]}|{words[1][0]}", tuple(extra), company, " ".join(words)))
    return out


def _form_table(people: DataFrame, kana: dict[str, str]) -> DataFrame:
    """``(key, email, f_changes, typo, label, full)`` of every form; ``full`` the bare name of an organisation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for name, email, aliases, company in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k, (changes, typo) in forms(name, email, aliases, kana).items():
                    for c, v in zip(out, (k, email, list(changes), typo, label(company, email), fold(_LEGAL_FORMS.sub("", tidy(name)).strip()) if k[0] == _SHORT else None), strict=True):
                        c.append(v)
            types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["key", "email", "f_changes", "typo", "label", "full"])

    return people.select("name", "email", "aliases", "company").mapInArrow(run, "key string, email string, f_changes array<string>, typo boolean, label string, full string")


def _analysis_table(spellings: DataFrame, labels: set[str]) -> DataFrame:
    """Distinct (value, n) to ``(value, n, signs, key, a_changes, company, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], ([], [], [], [], [])
            for i, v in enumerate(b.column(0).to_pylist()):
                signs = len(tidy(v))
                for key, changes, company, text in analyses(v, labels):
                    at.append(i)
                    for c, x in zip(out, (signs, key, list(changes), company, text), strict=True):
                        c.append(x)
            types = (pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["value", "n", "signs", "key", "a_changes", "company", "text"])

    return spellings.select("value", "n").mapInArrow(run, "value string, n bigint, signs int, key string, a_changes array<string>, company string, text string")


def _deleted(df: DataFrame) -> DataFrame:
    """Each key as it is (``at`` 0) and with the sign at ``at`` deleted (``gone``)."""
    at = F.explode(F.sequence(F.lit(0), F.length("key")))
    d = df.withColumn("at", at)
    rest = F.when(F.col("at") == 0, F.col("key")).otherwise(F.concat(F.expr("substring(key, 1, at - 1)"), F.expr("substring(key, at + 1)")))
    return d.withColumn("d", F.xxhash64(rest)).withColumn("gone", F.expr("substring(key, at, 1)"))


def candidate_table(spellings: DataFrame, people: DataFrame, kana: dict[str, str], labels: set[str]) -> DataFrame:
    """``(value, n, signs, email, changes)``: whom each distinct spelling may mean, and by which changes."""
    form = cut(_form_table(people, kana))
    look = cut(_analysis_table(spellings, labels))
    fits = F.col("company").isNull() | (F.col("company") == F.col("label"))
    short = F.col("key").startswith(_SHORT)
    # the words of an abbreviated organisation follow those of the full name in order, each a beginning where it ends in a dot
    words = F.regexp_replace(F.regexp_replace("text", r"([^\w\s.])", r"\\$1"), r"\.(?=\s|$)", r"\\S*")
    pattern = F.concat(F.lit("^"), F.regexp_replace(words, r"\s+", r"(?: \\S+)* "), F.lit(r"(?: \S+)*$"))
    met = look.join(form, "key").where(fits & (~short | F.coalesce(F.call_function("rlike", F.col("full"), pattern), F.lit(False))))
    met = met.select("value", "n", "signs", "email", F.concat("a_changes", "f_changes").alias("changes"))
    typed = lambda d: d.where((F.length("key") >= LEAST_TYPO) & ~short)
    # one edit changes a length by one at most, so longer keys meet nothing
    longest = form.where("typo").agg(F.max(F.length("key"))).first()[0] or 0
    a = _deleted(typed(look).where(F.length("key") <= longest + 1)).withColumnsRenamed({"key": "a_key", "at": "a_at", "gone": "a_gone"})
    b = _deleted(typed(form).where("typo")).select("d", "email", "f_changes", "label", F.col("key").alias("b_key"), F.col("at").alias("b_at"), F.col("gone").alias("b_gone"))
    # one sign changed at one place, left out or added, or two neighbours exchanged
    edit = (F.col("a_key") != F.col("b_key")) & ((F.col("a_at") == F.col("b_at")) | (F.col("a_at") * F.col("b_at") == 0) | ((F.abs(F.col("a_at") - F.col("b_at")) == 1) & (F.col("a_gone") == F.col("b_gone"))))
    errors = a.join(b, "d").where(edit & fits).select("value", "n", "signs", "email", F.concat("a_changes", "f_changes", F.array(F.lit("typo"))).alias("changes"))
    # of several ways from one person the shortest stands
    way = F.min(F.struct(F.size("changes").alias("k"), "changes"))
    return met.unionByName(errors.distinct()).groupBy("value", "n", "signs", "email").agg(way.alias("w")).select("value", "n", "signs", "email", F.col("w.changes").alias("changes"))


def _scored(cands: DataFrame, prior: DataFrame, p: dict[str, float], total: float) -> DataFrame:
    """Candidates with ``score``, the log of prior times likelihood, and ``nobody``, that of no candidate."""
    likelihood = F.lit(0.0)
    for c in CHANGES:
        cost = F.lit(math.log(p[c]))
        if c == "typo":  # which of its places, and which sign
            cost = cost - F.log(F.greatest(F.col("signs"), F.lit(1)) * 30.0)
        likelihood = likelihood + F.when(F.array_contains("changes", c), cost).otherwise(0.0)
    c = cands.join(prior, "email", "left")
    return c.withColumn("score", F.log((F.coalesce("c", F.lit(0.0)) + SMOOTH) / total) + likelihood).withColumn("nobody", F.lit(math.log(p["nobody"])) + F.col("signs") * SIGN)


def learn(cands: DataFrame, known: DataFrame, values: int) -> tuple[DataFrame, dict[str, float], float]:
    """Priors (email, c) and probabilities of the changes by expectation and maximisation.

    ``known``: (email, c) of the spellings that are the name itself; ``values``: number of
    all values. Equal spellings are weighed by their number.
    """
    p = dict.fromkeys(CHANGES, START) | {"nobody": NOBODY}
    prior = known
    of = Window.partitionBy("value")
    for _ in range(ROUNDS):
        s = _scored(cands, prior, p, values + 1.0)
        top = F.greatest(F.max("score").over(of), F.col("nobody"))
        share = F.exp(F.col("score") - F.col("top")) / (F.sum(F.exp(F.col("score") - F.col("top"))).over(of) + F.exp(F.col("nobody") - F.col("top")))
        post = cut(s.withColumn("top", top).select("email", "changes", (share * F.col("n")).alias("w")))
        n = {r["change"]: r["w"] for r in post.select(F.explode(F.concat("changes", F.array(F.lit("all")))).alias("change"), "w").groupBy("change").agg(F.sum("w").alias("w")).collect()}  # one row a change
        meant = n.get("all", 0.0)
        p = {c: (n.get(c, 0.0) + SMOOTH * START) / (meant + SMOOTH) for c in CHANGES}
        p["nobody"] = min(0.9, max(1e-4, (values - meant + SMOOTH * NOBODY) / (values + SMOOTH)))
        prior = known.select("email", "c").unionByName(post.select("email", F.col("w").alias("c"))).groupBy("email").agg(F.sum("c").alias("c"))
    return prior, p, values + 1.0


def likeliest(values: DataFrame, people: DataFrame) -> DataFrame:
    """``(value, email)`` of distinct values by the channel alone, all people and changes taken for equally
    frequent; names of the table included. For sender fields, where no column of spellings is at hand."""
    persons = [r.asDict() for r in bounded_rows(people.select("name", "email", "company"), PEOPLE_LIMIT, "people")]
    kana = romaji([(p["name"], p["email"]) for p in persons])
    labels = {label(p["company"], p["email"]) for p in persons if p["name"] and p["email"]}
    cands = candidate_table(values.withColumn("n", F.lit(1).cast("bigint")), people, kana, labels)
    prior = people.select("email", F.lit(0.0).alias("c")).limit(0)
    s = _scored(cands, prior, dict.fromkeys(CHANGES, START) | {"nobody": NOBODY}, len(persons) + 1.0)
    return s.groupBy("value").agg(F.max_by("email", F.struct("score", "email")).alias("email"))


def attribute(df: DataFrame, people: DataFrame, *, id_col: str = "_id", fields: dict[str, str], address_cols: list[str], thread_col: str = "parents", group_col: str = "project", use_prior: bool = True) -> DataFrame:
    """``(id_col, field, pos, email)`` of each value that means somebody in another spelling.

    ``use_prior``: False takes every candidate for equally frequent (to measure the prior).
    """
    persons = [r.asDict() for r in bounded_rows(people.select("name", "email", "company"), PEOPLE_LIMIT, "people")]
    kana = romaji([(p["name"], p["email"]) for p in persons])
    labels = {label(p["company"], p["email"]) for p in persons if p["name"] and p["email"]}
    emails = people.select(F.lower("email").alias("lower"), F.col("email").alias("email")).where(F.col("email").isNotNull()).distinct()
    values = cut(all_values(df, id_col=id_col, fields=fields).drop("entry").where(~F.col("value").contains("@")))
    exact = people.select(F.col("name").alias("value"), "email").where(F.col("value").isNotNull() & F.col("email").isNotNull()).groupBy("value").agg(F.min("email").alias("email"))
    spellings = cut(values.groupBy("value").agg(F.count("*").alias("n")).join(exact, "value", "left"))
    counted = spellings.agg(F.sum("n"), F.sum(F.when(F.col("email").isNotNull(), F.col("n")))).first()
    known_n = spellings.where(F.col("email").isNotNull()).groupBy("email").agg(F.sum("n").cast("double").alias("c"))
    cands = cut(candidate_table(spellings.where(F.col("email").isNull()), people, kana, labels))
    prior, p, total = learn(cands, known_n, counted[0] or 0)
    cands = cut(_scored(cands, prior if use_prior else prior.withColumn("c", F.lit(0.0)), p, total).select("value", "email", "score", "nobody"))
    known = values.join(exact, "value")
    rivals = cands.groupBy("value").agg(F.count("*").alias("rivals"))
    one = cands.join(rivals.where("rivals = 1").select("value"), "value", "left_semi").where("score > nobody")
    sure = values.join(one, "value").select(id_col, "field", "pos", "email")
    open_ = cut(values.join(rivals.where("rivals > 1").select("value"), "value", "left_semi").join(df.select(id_col, F.col(thread_col).alias("thread"), F.col(group_col).alias("grp")), id_col))
    rows = df.join(open_.select(id_col).distinct(), id_col, "left_semi")
    text = F.lower(F.concat_ws(" ", *address_cols))
    found = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?<![\w.\-])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+)"), 1)))
    in_row = rows.select(id_col, found.alias("lower")).join(F.broadcast(emails), "lower").select(id_col, "email")
    in_row = in_row.unionByName(known.join(open_.select(id_col).distinct(), id_col, "left_semi").select(id_col, "email")).distinct().withColumn("in_row", F.lit(IN_ROW))
    threads = open_.where(F.col("thread") != "").select("thread").distinct()
    in_thread = df.select(F.col(thread_col).alias("thread"), F.lower(F.concat_ws(" ", *address_cols)).alias("text")).join(threads, "thread", "left_semi")
    in_thread = in_thread.select("thread", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"((?<![\w.\-])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+)"), 1))).alias("lower"))
    in_thread = in_thread.join(F.broadcast(emails), "lower").select("thread", "email").distinct().withColumn("in_thread", F.lit(IN_THREAD))
    by_group = known.join(df.select(id_col, F.col(group_col).alias("grp")), id_col).groupBy("grp", "email").agg((F.log1p(F.count("*")) * PROJECT_WEIGHT).alias("in_group"))
    scored = (
        open_.join(cands, "value")
        .join(in_row, [id_col, "email"], "left")
        .join(in_thread, ["thread", "email"], "left")
        .join(by_group, ["grp", "email"], "left")
        .withColumn("score", F.col("score") + sum(F.coalesce(c, F.lit(0.0)) for c in ("in_row", "in_thread", "in_group")))
    )
    first = Window.partitionBy(id_col, "field", "pos").orderBy(F.desc("score"), "email")
    best = scored.withColumn("rn", F.row_number().over(first)).where("rn = 1 and score > nobody").select(id_col, "field", "pos", "email")
    return sure.unionByName(best)
