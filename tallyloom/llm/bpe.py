"""Byte-level BPE encoding of a whole corpus with a public vocabulary.

Method: pair occurrence index. The distinct pre-tokens of a batch are laid out as
one linked list of byte symbols. An index maps every mergeable pair to all its
positions; the active ranks are taken in ascending order from a heap, each rank is
applied at all its positions at once and the neighbours' pairs are entered in the
index. Pre-tokens seen before come from a cache, so the work follows the number of
distinct pre-tokens, not the number of words.

Defined cases: null and empty texts give an empty list; blank text is encoded like
any other; strings that look like special tokens are ordinary text; a lone
surrogate can't occur in a Spark string. Columns beyond the two used are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pre-tokens kept between batches; above it the cache is emptied, which
#: costs time but never changes a result.
CACHE_WORDS = 300_000
#: Longer pre-tokens are encoded each time.
CACHE_LENGTH = 64


class PairIndexEncoder:
    """Encodes texts with a rank file (base64 token and rank on each line)."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN):
        with open(vocabulary, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.byte = [rank[bytes([i])] for i in range(256)]
        # a pair of symbols -> the symbol it merges to, whose id is also its rank
        self.merge = {}
        for token, r in rank.items():
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    self.merge[left << 20 | right] = r
        self.words = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def encode_words(self, words: Iterable[str]) -> list[list[int]]:
        """Ids of each of the given pre-tokens."""
        byte, merge = self.byte, self.merge
        symbol: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts = []
        for w in words:
            first = len(symbol)
            starts.append(first)
            symbol.extend(byte[b] for b in w.encode("utf-8"))
            end = len(symbol)
            before.extend(range(first - 1, end - 1))
            after.extend(range(first + 1, end + 1))
            if end > first:
                before[first] = -1
                after[end - 1] = -1
        index: dict[int, list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0 and (r := merge.get(symbol[i] << 20 | symbol[j])) is not None:
                index.setdefault(r, []).append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            positions = index.pop(r, None)
            if positions is None:
                continue
            positions.sort()
            for i in positions:
                j = after[i]
                # a position is stale when a merge nearby has taken one of its symbols
                if j < 0 or symbol[i] < 0 or merge.get(symbol[i] << 20 | symbol[j]) != r:
                    continue
                symbol[i] = r
                symbol[j] = -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (q := merge.get(r << 20 | symbol[k])) is not None:
                        if q not in index:
                            index[q] = []
                            heapq.heappush(active, q)
                        index[q].append(i)
                h = before[i]
                if h >= 0 and (q := merge.get(symbol[h] << 20 | r)) is not None:
                    if q not in index:
                        index[q] = []
                        heapq.heappush(active, q)
                    index[q].append(h)
        starts.append(len(symbol))
        return [[s for s in symbol[a:b] if s >= 0] for a, b in zip(starts, starts[1:], strict=False)]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        split = [self.words(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in cache})
        ids = dict(zip(new, self.encode_words(new), strict=True))
        long = {w: x for w, x in ids.items() if len(w) > CACHE_LENGTH}
        cache.update((w, x) for w, x in ids.items() if len(w) <= CACHE_LENGTH)
        if long:
            return [[i for w in ws for i in (cache[w] if w in cache else long[w])] for ws in split]
        return [[i for w in ws for i in cache[w]] for ws in split]


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str) -> PairIndexEncoder:
    """One encoder for each vocabulary and Python worker."""
    return PairIndexEncoder(vocabulary)


def encode_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, ids array<int>)`` for each row of ``docs``, without a shuffle.

    ``vocabulary`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = pa.array(e.encode_batch(part.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, ids array<int>")
