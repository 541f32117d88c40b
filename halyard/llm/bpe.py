"""Byte-level BPE of whole texts with a public rank file.

A word is held as the boundaries of its parts and, beside them, the rank of each adjacent pair. The least rank is looked
for by scanning the array, the boundary between the two parts is deleted, and the ranks of the two neighbours are
refreshed. Words of more than SHORT bytes, for which repeated scans would cost the square of the length, are merged in the
same order from a heap. Words repeat, so their ids are kept in a cache of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_RANKS = os.environ.get("HALYARD_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
SHORT = 128
NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Ids of texts. One object per worker process; see `shared`."""

    def __init__(self, path: str = DEFAULT_RANKS, cache: int = 200_000):
        self.ranks = read_ranks(path)
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.room = cache

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.cache.get(word)
        if ids is None:
            b = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            ids = (whole,) if whole is not None else self._scan(b) if len(b) <= SHORT else self._heap(b)
            if len(b) <= SHORT:
                if len(self.cache) >= self.room:
                    self.cache.clear()
                self.cache[word] = ids
        return ids

    def _scan(self, b: bytes) -> tuple[int, ...]:
        get = self.ranks.get
        at = list(range(len(b) + 1))
        pair = [get(b[i : i + 2], NONE) for i in range(len(b) - 1)]
        while pair:
            least = min(pair)
            if least == NONE:
                break
            i = pair.index(least)
            del at[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(b[at[i] : at[i + 2]], NONE)
            if i:
                pair[i - 1] = get(b[at[i - 1] : at[i + 1]], NONE)
        return tuple(self.ranks[b[x:y]] for x, y in zip(at, at[1:]))

    def _heap(self, b: bytes) -> tuple[int, ...]:
        """The same merges, least rank first and leftmost among equals, in n log n."""
        n, get = len(b), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := get(b[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := before[i]) >= 0 and (r := get(b[p:stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[b[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        get, slow = self.cache.get, self.word
        for w in self.words.findall(text):
            out += get(w) or slow(w)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get, slow = self.cache.get, self.word
        return sum([len(get(w) or slow(w)) for w in self.words.findall(text)])


_SHARED: dict[str, Bpe] = {}


def shared(path: str = DEFAULT_RANKS) -> Bpe:
    if path not in _SHARED:
        _SHARED[path] = Bpe(path)
    return _SHARED[path]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """id_col, ids (array of int): one row per row of df, without special tokens.

    Null and empty texts give the empty list; blank texts are encoded as they are. Strings that look like special tokens
    are ordinary text. Texts of any length are encoded whole. Extra columns are ignored; an empty table gives no rows.
    ranks is a path that every executor can read.
    """
    kept = spread(df.select(df[id_col], df[text_col].alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            step = 256  # rows handed on at once; keeps the list column of long texts small
            for k in range(0, len(texts), step):
                lists = [np.asarray(bpe.encode(t), dtype=np.int32) for t in texts[k : k + step]]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, step), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], names=[id_col, "ids"])

    kind = kept.schema[0].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def with_counts(df: DataFrame, text_col: str = "text", out_col: str = "n_tokens", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """df with the number of tokens of its text in place of the text: null and empty texts have 0."""
    names = [c for c in df.columns if c != text_col]
    kept = spread(df.select(*[df[c] for c in names], df[text_col].alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(ranks)
        for batch in batches:
            n = pa.array([bpe.count(t) for t in batch.column(len(names)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*names, out_col])

    schema = kept.drop("_text").schema.add(out_col, "long")
    return kept.mapInArrow(run, schema)
