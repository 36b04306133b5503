"""Judgements behind an interface: a model call is a function on batches of rows.

The engine supplies inputs and checks answers; tests and offline runs use the
deterministic stand-ins below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.session import cut

Judge = Callable[[list[dict]], list[dict]]


def judged(df: DataFrame, judge: Judge, schema: str, *, key: str, batch: int = 64) -> DataFrame:
    """``(key, *schema)``: answers of a judge for each row, in batches, in the executors.

    A row for which the judge gives nothing has nulls; a failing batch fails the task,
    which Spark runs again.
    """
    out = StructType.fromDDL(schema)
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                rows = part.to_pylist()
                answers = judge(rows)
                if len(answers) != len(rows):
                    raise ValueError("a judge must give one answer for each row")
                yield pa.RecordBatch.from_pylist([{key: r[key]} | {n: (a or {}).get(n) for n in names} for r, a in zip(rows, answers, strict=True)], schema=types)

    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(StructType([df.schema[key], *out.fields]))
    return df.mapInArrow(run, StructType([df.schema[key], *out.fields]))


def never(rows: list[dict]) -> list[dict]:
    """The stand-in that finds no match."""
    return [{"decision": "no_match"} for _ in rows]


def first_candidate(rows: list[dict]) -> list[dict]:
    """The stand-in that takes the first candidate, or no match without any."""
    return [{"decision": "match", "choice": r["candidates"][0]} if r.get("candidates") else {"decision": "no_match"} for r in rows]


def with_required(answers: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Answers that have all required fields, and those to ask again."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    return answers.where(whole), answers.where(~whole)


def judged_or(df: DataFrame, first: Judge, second: Judge, schema: str, *, key: str, required: list[str]) -> DataFrame:
    """Answers of the first judge, and of the second where the first gave not all that is required; ``by`` tells which.

    What neither answers in full stands as the second gave it.
    """
    answers = cut(judged(df, first, schema, key=key))
    whole, again = with_required(answers, required)
    asked = df.join(again.select(key), key, "left_semi")
    return whole.withColumn("by", F.lit("first")).unionByName(judged(asked, second, schema, key=key).withColumn("by", F.lit("second")))


def page_rows(pages: DataFrame, reader: Callable[[dict], list[dict]], schema: str, *, key: str) -> DataFrame:
    """``(key, row_no, *schema)``: the rows that a reader finds on each page, numbered from 1; a page may have none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StructField

    out = StructType([pages.schema[key], StructField("row_no", IntegerType()), *StructType.fromDDL(schema).fields])
    types = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{key: p[key], "row_no": n} | r for p in b.to_pylist() for n, r in enumerate(reader(p), 1)]
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in types.names} for r in rows], schema=types)

    return pages.mapInArrow(run, out)


def rechecked(answers: DataFrame, machine: DataFrame, ok: DataFrame, *, by: str) -> DataFrame:
    """Answers of the groups whose machine check holds (``ok``: by, ok), the machine's own rows for the others; ``by_judge`` tells which."""
    good = ok.where("ok").select(by)
    kept = answers.join(good, by, "left_semi").withColumn("by_judge", F.lit(True))
    return kept.unionByName(machine.join(good, by, "left_anti").withColumn("by_judge", F.lit(False)), allowMissingColumns=True)


def classified(df: DataFrame, judge: Judge, labels: list[str], *, key: str, fallback: str) -> DataFrame:
    """``(key, label, valid)``: the judge's label, or the fallback where it is none of the labels."""
    a = judged(df, judge, "label string", key=key)
    valid = F.coalesce(F.col("label").isin(*labels), F.lit(False))
    return a.select(key, F.when(valid, F.col("label")).otherwise(fallback).alias("label"), valid.alias("valid"))


def keyword_classifier(text: str, rules: list[tuple[str, str]]) -> Judge:
    """The stand-in that labels a text by the first needle it holds, case ignored."""

    def judge(rows: list[dict]) -> list[dict]:
        return [{"label": next((v for n, v in rules if n.casefold() in (r.get(text) or "").casefold()), None)} for r in rows]

    return judge
