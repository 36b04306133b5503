"""Entity resolution: people, companies and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import clean_participant, domains_in_order, emails, match_key, name_tokens
from tallyloom.operators.matching import contains_pairs
from tallyloom.session import cut


def status(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, status)``: one (the value), ambiguous (null) for several."""
    g = candidates.groupBy(key).agg(F.min(value).alias("_lo"), F.count_distinct(value).alias("n"))
    return g.select(key, F.when(F.col("n") == 1, F.col("_lo")).alias(value), F.when(F.col("n") == 1, "one").otherwise("ambiguous").alias("status"))


def resolve_people(queries: DataFrame, people: DataFrame, *, query: str, variants: str | None = None, raw: DataFrame | None = None, sources: tuple[str, ...] = ("slack", "drive", "file")) -> DataFrame:
    """The person each query text means: ``(query, email, status, how)``.

    A spelling of the query (``variants``: a column with an array of them, by default the
    query itself) held by a person's name, aliases or address, case and width ignored, makes
    that person a candidate; one address resolves (``people``), several are ambiguous. With
    none, ``raw`` is looked up: source by source, a spelling held by the names of rows of
    exactly one address resolves (``raw``). Else the status is none.

    Spellings meet by :func:`contains_pairs` on distinct texts.
    """
    spell = F.explode(F.col(variants)) if variants else F.col(query)
    q = queries.where(F.col(query).isNotNull()).select(F.col(query).alias("_q"), spell.alias("_s")).select("_q", F.trim(match_key(F.col("_s"))).alias("_v")).distinct()
    asked = q.where(F.length("_v") > 0)
    aliases = F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "\n")
    pool = people.where(F.trim("email") != "").select(F.lower(F.trim("email")).alias("email"), match_key(F.concat_ws(" \n", "name", aliases, "email")).alias("_t")).distinct()
    hits = cut(asked.join(contains_pairs(pool, asked, text="_t", needle="_v"), "_v").join(pool, "_t").select("_q", "email").distinct())
    out = status(hits, "_q", "email").withColumn("how", F.lit("people"))
    if raw is not None:
        open_ = asked.join(hits.select("_q"), "_q", "left_anti")
        rows = raw.where(F.col("source").isin(*sources) & F.col("sender").contains("@") & ~F.col("sender").contains(",") & F.col("name").isNotNull())
        rows = rows.select("source", F.lower(F.trim("sender")).alias("email"), match_key(F.col("name")).alias("_t")).distinct()
        met = open_.join(contains_pairs(rows, open_, text="_t", needle="_v"), "_v").join(rows, "_t")
        one = met.groupBy("_q", "source", "_v").agg(F.count_distinct("email").alias("n"), F.min("email").alias("email")).where("n = 1")
        rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
        found = one.groupBy("_q").agg(F.min(F.struct(rank.alias("r"), "_v", "email")).alias("b"))
        out = out.unionByName(found.select("_q", F.col("b.email").alias("email"), F.lit("one").alias("status"), F.lit("raw").alias("how")))
    all_ = queries.select(F.col(query).alias("_q")).where(F.col(query).isNotNull()).distinct()
    return all_.join(out, "_q", "left").select(F.col("_q").alias(query), "email", F.coalesce("status", F.lit("none")).alias("status"), "how")


def addresses_of_names(queries: DataFrame, people: DataFrame, *, query: str) -> DataFrame:
    """The address of a participant's name, only if exactly one row of the people fits: ``(query, email)``.

    First the name without remarks and honorifics, held by a name or an alias; where no row
    holds it, all its parts (blanks and camelCase divide; two at least), each held by a name
    or an alias. Case counts, as people type it.
    """
    aliases = F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "\n")
    p = people.select("email", F.concat_ws("\n", "name", aliases).alias("_t")).where(F.length("_t") > 0).withColumn("_row", F.xxhash64("email", "_t"))
    q = queries.where(F.col(query).isNotNull()).select(F.col(query).alias("_q")).distinct().withColumn("_c", clean_participant(F.col("_q"))).where(F.length("_c") > 0)
    first = q.join(contains_pairs(p, q, text="_t", needle="_c"), "_c").join(p, "_t").groupBy("_q").agg(F.count_distinct("_row").alias("n"), F.min("email").alias("email"))
    parts = F.array_distinct(F.filter(F.split(F.regexp_replace("_c", r"(?<=[a-z])(?=[A-Z])", " "), r"[\s\u3000]+"), lambda x: x != ""))
    rest = q.join(first, "_q", "left_anti").withColumn("_parts", parts).where(F.size("_parts") >= 2)
    each = rest.select("_q", F.size("_parts").alias("_need"), F.explode("_parts").alias("_c"))
    held = each.join(contains_pairs(p, each, text="_t", needle="_c"), "_c").join(p, "_t").groupBy("_q", "_need", "_row", "email").agg(F.count_distinct("_c").alias("k")).where("k = _need")
    second = held.groupBy("_q").agg(F.count_distinct("_row").alias("n"), F.min("email").alias("email"))
    return first.unionByName(second).where("n = 1 and email is not null").select(F.col("_q").alias(query), "email")


def by_all_tokens(queries: DataFrame, people: DataFrame, *, query: str) -> DataFrame:
    """People whose name has every part of the query as a part, only if exactly one: ``(query, email)``.

    Parts are met by equality and counted: no pair is tested that shares no part.
    """
    q = queries.select(query).distinct().withColumn("_parts", F.array_distinct(name_tokens(F.col(query))))
    p = people.select("email", F.explode(F.array_distinct(name_tokens(F.col("name")))).alias("_t"))
    hits = q.select(query, F.size("_parts").alias("_need"), F.explode("_parts").alias("_t")).join(p, "_t").groupBy(query, "_need", "email").agg(F.count("*").alias("n")).where("n = _need")
    return status(hits, query, "email").where("status = 'one'").select(query, "email")


def company_key(c: Column, prefix: str = "pjt_") -> Column:
    """Name of a company or project without its prefix, remarks in brackets, blanks and case."""
    k = F.regexp_replace(F.trim(c), f"^{prefix}", "")
    return F.lower(F.regexp_replace(F.regexp_replace(k, r"[（(\[].*?[）)\]]", ""), r"[\s\u3000]+", ""))


def resolve_company(queries: DataFrame, domain_map: DataFrame, *, query: str) -> DataFrame:
    """Project and domain each query text means: ``(query, project, domain, status)``.

    A project whose key holds the query's or is held by it, or a domain that is the query
    itself. One (project, domain) of the map resolves, repeated rows counting once; several
    are ambiguous, none is none.
    """
    m = domain_map.where(F.trim("project") != "").select(F.trim("project").alias("project"), F.lower(F.regexp_replace(F.trim("domain"), "^@+", "")).alias("domain")).distinct().withColumn("_k", company_key(F.col("project")))
    bare = F.regexp_replace(F.trim(F.col("_q")), r"\s*(さん|様|さま)$", "")
    q = queries.where(F.col(query).isNotNull()).select(F.col(query).alias("_q")).distinct().withColumn("_c", company_key(bare)).withColumn("_d", F.when(bare.contains("."), F.lower(bare)))
    pairs = contains_pairs(q, m, text="_c", needle="_k").unionByName(contains_pairs(m, q, text="_k", needle="_c").select("_c", "_k")).distinct()
    hits = q.join(pairs, "_c").join(m, "_k").select("_q", "project", "domain")
    hits = hits.unionByName(q.join(m, F.col("_d") == F.col("domain")).select("_q", "project", "domain")).distinct()
    g = hits.groupBy("_q").agg(F.count("*").alias("n"), F.min("project").alias("p"), F.min("domain").alias("d"))
    one = F.col("n") == 1
    out = q.select("_q").join(g, "_q", "left")
    return out.select(F.col("_q").alias(query), F.when(one, F.col("p")).alias("project"), F.when(one, F.col("d")).alias("domain"), F.when(F.col("n").isNull(), "none").when(one, "one").otherwise("ambiguous").alias("status"))


def mail_project(mails: DataFrame, domain_map: DataFrame, *, id_col: str, headers: list[str], own_domains: list[str]) -> DataFrame:
    """Project of a mail: the first registered domain in the order of the headers, own domains last.

    A domain of several projects takes the first by name. Mails of no registered domain
    are left out.
    """
    doms = domains_in_order(*map(F.col, headers))
    own = F.array(*map(F.lit, own_domains)) if own_domains else F.array().cast("array<string>")
    d = mails.select(id_col, F.posexplode(doms).alias("rank", "domain")).withColumn("rank", F.col("rank") + F.when(F.array_contains(own, F.col("domain")), 1_000_000).otherwise(0))
    m = domain_map.where(F.col("project").isNotNull() & F.col("domain").isNotNull()).groupBy(F.lower("domain").alias("domain")).agg(F.min("project").alias("project"))
    return d.join(m, "domain").groupBy(id_col).agg(F.min(F.struct("rank", "project", "domain")).alias("b")).select(id_col, "b.project", "b.domain")


def project_cascade(rows: DataFrame, projects: DataFrame, domain_map: DataFrame, *, id_col: str, topic: str, headers: list[str], own_domain: str, prefix: str = "pjt_") -> DataFrame:
    """Project by exact topic, else by a project whose name the topic holds, else by a participant's domain,
    else unclassified if all are of the own domain; ``how`` tells which."""
    names = projects.select("project").where(F.col("project").isNotNull()).distinct().withColumn("k", F.replace(F.lower(F.regexp_replace("project", f"^{prefix}", "")), F.lit("_"), F.lit(" ")))
    t = rows.select(id_col, F.lower(F.trim(topic)).alias("t"))
    exact = t.join(names, F.col("t") == F.col("k")).groupBy(id_col).agg(F.min("project").alias("exact"))
    held = contains_pairs(t, names, text="t", needle="k").join(names, "k").groupBy("t").agg(F.min("project").alias("word"))
    words = t.join(held, "t").select(id_col, "word")
    dom = mail_project(rows, domain_map, id_col=id_col, headers=headers, own_domains=[own_domain]).where(F.col("domain") != own_domain).select(id_col, F.col("project").alias("dom"))
    inside = F.size(F.array_except(domains_in_order(*map(F.col, headers)), F.array(F.lit(own_domain)))) == 0
    j = rows.select(id_col, (inside & (F.size(domains_in_order(*map(F.col, headers))) > 0)).alias("inside")).join(exact, id_col, "left").join(words, id_col, "left").join(dom, id_col, "left")
    how = F.when(F.col("exact").isNotNull(), "topic").when(F.col("word").isNotNull(), "word").when(F.col("dom").isNotNull(), "domain").when(F.col("inside"), "unclassified").otherwise("open")
    return j.select(id_col, F.coalesce("exact", "word", "dom").alias("project"), how.alias("how"))


def all_internal(headers: list[str], own_domain: str) -> Column:
    """There are participants and all share the own domain."""
    d = domains_in_order(*map(F.col, headers))
    return (F.size(d) > 0) & (F.size(F.array_except(d, F.array(F.lit(own_domain)))) == 0)


def participants(df: DataFrame, *, id_col: str, columns: list[str]) -> DataFrame:
    """Distinct addresses of a row over several columns in order: ``(id, pos, email)``."""
    all_ = F.array_distinct(F.flatten(F.array(*(emails(F.col(c)) for c in columns))))
    return df.select(id_col, F.posexplode(all_).alias("pos", "email"))


def merged_participants(entries: DataFrame, *, by: str, order: str, name: str, email: str, blocked: tuple[str, ...] = ()) -> DataFrame:
    """Participants of several lists, each once by its name without case and blanks: ``(by, pos, name, unresolved)``.

    ``order`` puts one list before the other. A name is the first spelling of its key, the
    address where there is no name; it is unresolved if no entry of the key has an address.
    """
    n, e = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(email, F.lit("")))
    shown = F.when(n != "", n).otherwise(e)
    d = entries.select(by, order, shown.alias("_shown"), F.lower(F.regexp_replace(shown, r"[\s\u3000]+", "")).alias("_k"), ((n != "") & (e != "")).alias("_has")).where("_k <> ''")
    if blocked:
        d = d.where(~F.col("_k").isin(*blocked))
    g = d.groupBy(by, "_k").agg(F.min_by("_shown", order).alias("name"), F.min(order).alias("_o"), F.max("_has").alias("_any"))
    pos = F.row_number().over(Window.partitionBy(by).orderBy("_o", "_k"))
    return g.select(by, pos.alias("pos"), "name", (~F.col("name").contains("@") & ~F.col("_any")).alias("unresolved"))
