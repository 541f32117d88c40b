"""Oversized texts into pieces under a limit of tokens.

Separators form a hierarchy: section, paragraph, line, sentence, word, character. A text is split at the highest level; a
part that is still over the limit is split at the next level, and so on. The parts are then packed greedily, in order,
each piece after the first beginning with the end of the piece before (the overlap), cut at a word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import spread

from .bpe import DEFAULT_RANKS, Bpe, shared

#: Where a text may be cut, from the highest level down; each match ends at a cut.
LEVELS = (
    ("section", regex.compile(r"\n(?=[^\S\n]*(?:#{1,6}[^\S\n]|-[^\S\n]+(?:Pre-anesthetic|Preoperative|Anesthetic)|VITAL\b|(?:[-=*_][^\S\n]?){3,}(?:\n|$)|\d{1,2}\.[^\S\n]+\p{Lu}))")),
    ("paragraph", regex.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*| ")),
    ("line", regex.compile(r"\r\n|[\n\r \x0b\x0c\x85]")),
    ("sentence", regex.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|[。！？]+\s*|(?<=[;；])\s+")),
)

class _Counted:
    """A text with the ends of its words and the sum of tokens up to each, so that any part is counted by two searches and
    the few words at its ends, exactly as it would be by itself."""

    def __init__(self, bpe: Bpe, text: str, words: list[str], sizes: list[int]):
        self.bpe, self.text, self.words = bpe, text, words
        self.ends = [0, *accumulate(map(len, words))]
        self.sums = [0, *accumulate(sizes)]

    def count(self, lo: int, hi: int) -> int:
        """Tokens of text[lo:hi] by itself.

        Words are matched from the left, and each depends on what follows it only if it is blank. So from the first place
        where the words of the part meet those of the text they are the same, up to the last that isn't blank and ends
        before hi; what is left over at either end is counted anew.
        """
        if lo >= hi:
            return 0
        ends, match = self.ends, self.bpe.words.match
        at, total = lo, 0
        i = bisect_left(ends, at)
        while at < hi and (i == len(ends) or ends[i] != at):
            m = match(self.text, at, hi)
            total += len(self.bpe.word(m[0]))
            at = m.end()
            i = bisect_left(ends, at, i)
        if at >= hi:
            return total
        j = bisect_right(ends, hi, i) - 1
        if j < len(ends) - 1 or ends[j] != hi:  # the part ends within the text: its last words may be others
            j = max(i, j - 1)
            while j > i and self.words[j - 1].isspace():
                j -= 1
            if j > i:
                j -= 1
        return total + self.sums[j] - self.sums[i] + self.bpe.count(self.text[ends[j] : hi])


class Splitter:
    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def units(self, t: _Counted, lo: int, hi: int, room: int, level: int = 0) -> Iterator[tuple[int, int, str]]:
        """Parts of lo..hi within room tokens each, with the level at which each one ends."""
        if t.count(lo, hi) <= room:
            yield lo, hi, "text"
        elif level < len(LEVELS):
            name, pattern = LEVELS[level]
            edges = [lo, *(m.end() for m in pattern.finditer(t.text, lo, hi) if lo < m.end() < hi), hi]
            for a, b in zip(edges, edges[1:]):
                for x, y, at in self.units(t, a, b, room, level + 1):
                    yield x, y, at if y < b else name if b < hi else "text"
        else:
            for k in range(bisect_right(t.ends, lo), bisect_left(t.ends, hi) + 1):
                stop = min(t.ends[k], hi) if k < len(t.ends) else hi
                if t.count(lo, stop) > room:
                    for end in self._chars(t, lo, stop, room):
                        yield lo, end, "word" if end == stop else "character"
                        lo = end
                elif lo < stop:
                    yield lo, stop, "word"
                    lo = stop

    def _chars(self, t: _Counted, lo: int, hi: int, room: int) -> Iterator[int]:
        """Ends of parts of one long word: as many characters as fit, found by growing steps."""
        while lo < hi:
            good, step = lo + 1, max(1, room)
            while step:
                if good + step <= hi and t.count(lo, good + step) <= room:
                    good += step
                else:
                    step //= 2
            yield good
            lo = good

    def tail(self, t: _Counted, lo: int, hi: int, most: int) -> int:
        """Start of the longest end of lo..hi of at most `most` tokens that starts at a word, or within one if
        whole words make less than half of it."""
        if most <= 0:
            return hi
        j = bisect_right(t.ends, hi) - 1
        k = bisect_left(t.sums, t.sums[j] - most)
        while (s := max(t.ends[k], lo + 1)) < hi and t.count(s, hi) > most:
            k += 1
        if s < hi and 2 * t.count(s, hi) >= most:
            return s
        s, step = min(s, hi), max(1, most)
        while step:
            if s - step > lo and t.count(s - step, hi) <= most:
                s -= step
            else:
                step //= 2
        return s

    def split(self, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str, int]]:
        """(start, stop, shared, cut, tokens) of each piece: text[start:stop] has at most limit tokens, and its first
        `shared` characters are the end of the piece before; cut is the level at which it ends. Without the shared characters
        the pieces are the text. A limit of fewer tokens than one character has is kept as far as a character allows."""
        get, slow = self.bpe.cache.get, self.bpe.word
        words = self.bpe.words.findall(text)
        sizes = [len(get(w) or slow(w)) for w in words]
        total = sum(sizes)
        if limit < 1 or total <= limit:
            return [(0, len(text), 0, "text", total)]
        t = _Counted(self.bpe, text, words, sizes)
        return [(a, b, n, cut, t.count(a, b)) for a, b, n, cut in self._pack(t, limit, max(0, min(overlap, limit // 2)))]

    def _pack(self, t: _Counted, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
        pieces: list[tuple[int, int, int, str]] = []
        start = fresh = stop = 0
        cut = "text"
        for _, hi, level in self.units(t, 0, len(t.text), max(1, limit - overlap)):
            if stop > fresh and t.count(start, hi) > limit:
                pieces.append((start, stop, fresh - start, cut))
                start, fresh = self.tail(t, start, stop, overlap), stop
                while start < fresh and t.count(start, hi) > limit:  # less overlap: on to the next word
                    start = min(fresh, t.ends[bisect_right(t.ends, start)])
            stop, cut = hi, level
        pieces.append((start, stop, fresh - start, "text"))
        return pieces


PIECES = "doc_id long, source string, piece_no int, n_pieces int, piece string, n_tokens int, start_char int, shared_chars int, shared_tokens int, cut string"


def split_oversized(documents: DataFrame, limits: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """The pieces of all documents (doc_id, text, source), limits being source, max_tokens, overlap_tokens.

    A text within its limit, or of a source without a limit (or null), comes out as one piece; null and empty texts give
    one piece with the text as it is and 0 tokens. piece_no counts from 0; start_char, shared_chars count code points, and
    piece without its first shared_chars follows the piece before without a gap. cut names the level at which the piece
    ends (`text` for the last). A limit below 1 is none; an overlap is at most half of the limit. Two limits for one
    source: the smaller. Limits are joined by source, which Spark broadcasts below its own threshold.
    """
    lim = limits.groupBy(F.col("source").alias("_source")).agg(F.min("max_tokens").alias("max_tokens"), F.min_by("overlap_tokens", "max_tokens").alias("overlap_tokens"))
    rows = spread(documents.select("doc_id", "text", "source")).join(lim, F.col("source") == F.col("_source"), "left").select("doc_id", "source", "text", "max_tokens", "overlap_tokens")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(shared(ranks))
        count = splitter.bpe.count
        for batch in batches:
            out = []
            for doc_id, source, text, limit, overlap in batch.itertuples(index=False, name=None):
                if not text:
                    out.append((doc_id, source, 0, 1, text, 0, 0, 0, 0, "text"))
                    continue
                pieces = splitter.split(text, 0 if pd.isna(limit) else int(limit), 0 if pd.isna(overlap) else int(overlap))
                for k, (lo, hi, both, cut, n) in enumerate(pieces):
                    out.append((doc_id, source, k, len(pieces), text[lo:hi], n, lo, both, count(text[lo : lo + both]), cut))
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in PIECES.split(", ")]
    return rows.mapInPandas(run, PIECES)
