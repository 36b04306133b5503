"""Catalog of the text queries: name to callable, name to DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.llm.bpe import encode_corpus
from tallyloom.llm.conversations import conversations
from tallyloom.llm.leaks import find_leaks
from tallyloom.llm.levels import reading_levels
from tallyloom.llm.newtext import new_lines
from tallyloom.llm.personal import find_personal, redact, surrogate_table
from tallyloom.llm.truncated import cut_texts, truncated, truncation_rates
from tallyloom.llm.turns import speaker_turns
from tallyloom.llm.variants import attribute
from tallyloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p8_ids(spark, d):
    return encode_corpus(table(spark, d, "documents"))


@query
def p7_found(spark, d):
    return truncated(table(spark, d, "raw").select("_id", "source", "content", "links"), transcript=F.coalesce(F.col("source") == "meeting", F.lit(False)))


@query
def p7_rates(spark, d):
    return truncation_rates(table(spark, d, "raw").select("_id", "source", "content", "links"), transcript=F.coalesce(F.col("source") == "meeting", F.lit(False)))


def _whole_transcripts(spark, d):
    """All meeting rows, and those whose content is not cut; a cut is judged against the texts of all sources."""
    raw = table(spark, d, "raw").select("_id", "source", "content", "name")
    meeting = F.coalesce(F.col("source") == "meeting", F.lit(False))
    cut = cut_texts(raw, id_col="_id", text_col="content", transcript=meeting, of=meeting)
    return raw.where(meeting), raw.where(meeting).join(cut.withColumnRenamed("id", "_id"), "_id", "left_anti")


@query
def p4_found(spark, d):
    return p4_turns(spark, d).select("_id", "turn", "speaker_no", "n_words")


@query
def p4_turns(spark, d):
    all_, whole = _whole_transcripts(spark, d)
    return speaker_turns(whole, table(spark, d, "people"), sample=all_)


@query
def p2_found(spark, d):
    raw = table(spark, d, "raw").select("_id", "sender", "name", "to_addr", "cc_bcc", "parents", "project")
    return attribute(raw, table(spark, d, "people"), fields={"name": "name", "sender": "address"}, address_cols=["sender", "to_addr", "cc_bcc"])


@query
def p5_found(spark, d):
    slack = table(spark, d, "raw").where(F.col("source") == "slack").select("_id", "dedup_key", "timestamp", "parents", "sender", "name", "content")
    return conversations(slack, table(spark, d, "people"))


@query
def p6_found(spark, d):
    return new_lines(table(spark, d, "raw").where(F.col("source") == "gmail").select("_id", "content", "parents", "sender", "timestamp")).select("_id", "line_no")


def _texts(spark, d):
    return table(spark, d, "raw").select("_id", "content", "subject", F.coalesce(F.col("source") == "meeting", F.lit(False)).alias("spoken"))


@query
def p1_found(spark, d):
    return find_personal(_texts(spark, d), table(spark, d, "people"), transcript_col="spoken")


@query
def p1_redacted(spark, d):
    return redact(_texts(spark, d), table(spark, d, "people"), transcript_col="spoken")


@query
def p1_surrogate_text(spark, d):
    """Texts rewritten with surrogates."""
    return redact(_texts(spark, d), table(spark, d, "people"), transcript_col="spoken", secret="tallyloom")


@query
def p1_surrogates(spark, d):
    return surrogate_table(p1_found(spark, d), secret="tallyloom")


@query
def p9_found(spark, d):
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query
def p9_items(spark, d):
    """Leaked items with the number of documents that hold them."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


@query
def p10_found(spark, d):
    return reading_levels(table(spark, d, "documents"), table(spark, d, "level_samples"))


SQL["p5_found"] = """
with s as (select *, row_number() over (partition by coalesce(dedup_key, '#' || _id) order by _id) rn from raw where source = 'slack'),
m as (select _id, epoch_us("timestamp") ts, coalesce(trim(parents), '') = '' as first_row, content,
 case when coalesce(trim(parents), '') = '' then epoch_us("timestamp") when regexp_matches(parents, '^[0-9]+[.][0-9]+$') then (parents::decimal(20,6) * 1000000)::bigint
  else epoch_us(try_cast(regexp_replace(replace(parents, 'Z', '+00:00'), '([+-][0-9][0-9])([0-9][0-9])$', '\\1:\\2') as timestamptz)) end as conv,
 lower(coalesce(nullif(regexp_extract(sender, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+([.][A-Za-z0-9_-]+)+', 0), ''), (select min(email) from people p where p.name = trim(s.name)), s.name, '')) who,
 coalesce(regexp_replace(content, '[\\s\u200b\u3000\ufeff\u00a0]', '', 'g'), '') <> '' as visible from s where rn = 1),
n as (select *, who in (select lower(email) from people where email is not null) person from m where conv is not null),
h as (select conv, min(_id) head from n where first_row group by 1),
k as (select h.conv, h.head, f.who opener from h join n f on f._id = h.head where f.visible and not exists (select 1 from n x where x.conv = h.conv and (x.ts is null or x.ts < f.ts)) and exists (select 1 from n x where x.conv = h.conv and x.visible and x.person and x.who <> f.who))
select head conv_id, (row_number() over (partition by n.conv order by ts, _id))::int turn, _id, case when who = opener then 'opener' when person then 'replier' else 'machine' end as role from n join k on n.conv = k.conv where visible
"""
