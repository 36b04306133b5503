"""Remote services read page by page, in the executors, a unit of work per row.

A unit (a project, a month, a mailbox) is paged in order by one task; units run side by
side. A page that is too large is asked for again at half the size, the smaller size is
kept; other failures are tried again with growing waits.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: fetch(unit, token, size) -> (rows, next token or None)
Fetch = Callable[[dict, str | None, int], tuple[list[dict], str | None]]


class PayloadTooLarge(Exception):
    """A page that a service refuses for its size."""


class NotRetryable(Exception):
    """A failure that a second try can't mend."""


def with_retry(call: Callable[[], object], tries: int = 4, wait: float = 1.0, most: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Result of a call, tried again with doubling, jittered waits."""
    for k in range(tries):
        try:
            return call()
        except (PayloadTooLarge, NotRetryable):
            raise
        except Exception:
            if k == tries - 1:
                raise
            sleep(min(most, wait * 2**k) * (0.5 + random.random() / 2))
    raise AssertionError


def pages(unit: dict, fetch: Fetch, size: int = 100, floor: int = 5, sleep: Callable[[float], None] = time.sleep) -> Iterator[list[dict]]:
    """Pages of a unit to the end."""
    token: str | None = None
    while True:
        try:
            rows, token_next = with_retry(lambda: fetch(unit, token, size), sleep=sleep)  # noqa: B023
        except PayloadTooLarge:
            if size <= floor:
                raise
            size = max(floor, size // 2)
            continue
        yield rows
        if token_next is None:
            return
        token = token_next


def descending(pages_: Iterator[list[dict]], time: str, since: object | None = None, most: int | None = None) -> Iterator[list[dict]]:
    """Pages that come newest first, as far as the first row before ``since`` or to ``most`` rows."""
    left = most
    for rows in pages_:
        kept = rows if since is None else [r for r in rows if r.get(time) is not None and r[time] >= since]
        if left is not None:
            kept = kept[:left]
            left -= len(kept)
        yield kept
        if left == 0 or len(kept) < len(rows):
            return


def read_paged(units: DataFrame, fetch: Fetch, schema: str, *, size: int = 100, floor: int = 5, time: str | None = None, since: object | None = None, most: int | None = None) -> DataFrame:
    """All rows of all units, with the schema given; a page is one Arrow batch, so no unit is held whole.

    ``time`` with ``since`` or ``most``: the service gives the newest first, and each unit is read
    only as far as that (:func:`descending`).
    """
    out = StructType.fromDDL(schema)
    types = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit in b.to_pylist():
                read = pages(unit, fetch, size, floor)
                for rows in descending(read, time, since, most) if time else read:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in types.names} for r in rows], schema=types)

    return units.mapInArrow(run, out)
