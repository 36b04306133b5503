"""The text queries on the smallest data: columns and types as the problems fix them."""

from __future__ import annotations

from pathlib import Path

import pytest

from tallyloom.llm import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")
COLUMNS = {
    "p1_found": {"_id": "bigint", "field": "string", "kind": "string", "value": "string"},
    "p2_found": {"_id": "bigint", "field": "string", "pos": "int", "email": "string"},
    "p4_found": {"_id": "bigint", "turn": "int", "speaker_no": "int", "n_words": "int"},
    "p5_found": {"conv_id": "bigint", "turn": "int", "_id": "bigint", "role": "string"},
    "p6_found": {"_id": "bigint", "line_no": "int"},
    "p7_found": {"_id": "bigint", "field": "string"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p9_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p10_found": {"doc_id": "bigint", "level": "int"},
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name in COLUMNS and name != "p8_ids":
        assert len(set(rows)) == len(rows)


def test_every_document_is_encoded(spark):
    ids = catalog.QUERIES["p8_ids"](spark, str(DATA))
    assert ids.count() == spark.read.parquet(f"{DATA}/documents.parquet").count() and ids.where("ids is null").count() == 0


def test_redaction_keeps_the_rest(spark):
    raw = spark.read.parquet(f"{DATA}/raw.parquet").select("_id", "content")
    red = {r["_id"]: r["content"] for r in catalog.QUERIES["p1_redacted"](spark, str(DATA)).collect()}
    found = {}
    for r in catalog.QUERIES["p1_found"](spark, str(DATA)).where("field = 'content'").collect():
        found.setdefault(r["_id"], []).append((r["value"], r["kind"]))
    for r in raw.collect():
        if r["_id"] not in found:
            assert red[r["_id"]] == r["content"]
        else:
            assert all(f"[{k.upper()}]" in red[r["_id"]] for _, k in found[r["_id"]])
