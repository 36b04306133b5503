"""Catalog of the core queries: name to callable, name to DuckDB SQL."""

from __future__ import annotations

from tallyloom.plans import columns, commerce, more, packed, records, rules, shapes, sheets, streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (columns.R, commerce.R, more.R, packed.R, records.R, rules.R, shapes.R, sheets.R, streams.R):
    QUERIES |= _m.queries
    SQL |= _m.sql
