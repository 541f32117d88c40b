"""Same and near-same records across splits, by a compressed full-text index of the evaluation texts.

The evaluation texts, in letters and digits only, are laid end to end in shards of bounded size. Of each shard an FM index
is made: the Burrows-Wheeler transform of the suffixes in order of their first DEPTH letters (which is all that patterns of
up to DEPTH letters need), rank counts over blocks of 64, and the text that each suffix belongs to. Letters are mapped to
31 symbols; a match of WINDOW symbols that is not one of letters is so rare that the exact check after it settles it.

Training texts stream through backward search: every run of SEED letters of a text is counted in the first shard, all different
runs of a batch at a time. If `share` of a text's letters lie in such runs that a partner has too, at most 1 - share of them do not; so of any
set of LOCATED of its letters, all but 1 - share of the text's are in runs that the partner has. The set is made of the letters
whose runs are rarest there, whatever shard is searched, and only those runs are located. The places of each text and owner are
counted first; of those that have enough of them, each owner's are merged into spans, and an owner whose
spans hold fewer letters of the set than that is none. This loses no near-same text, wherever its letters differ. Boilerplate that
occurs everywhere is thus counted but not located, and no cap is set on partners. The texts that are left are held against each
other letter by letter, where overlapping matches are merged into spans.

Copies of a text are one text until the end, when pairs of texts become pairs of records.
"""

from __future__ import annotations

import hashlib
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, run_dir, spread

DEPTH, SIGMA = 24, 32
LOCATED = 0.06  # share of a text's letters whose runs are located, beyond 1 - share
SHARD = 8_000_000  # letters of an index shard
SEED = 8  # letters of the least matches, which are joined to spans
BATCH = 1_000  # training texts that are searched at a time
HITS = 500_000  # located places that are merged at a time
CELLS = 8_000_000  # pairs of a text and an owner whose places are counted in a table
EPS = 1e-6


def letters(text: str | None) -> str:
    """The letters and digits of a text, without case, width and Unicode form."""
    if not text:
        return ""
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())))


_KEPT = np.zeros(0, bool)  # is each code point a letter or digit? Filled at first use


def letters_of(texts: list[str | None]) -> list[str]:
    """letters() of each text, some texts together put through one table."""
    global _KEPT
    if not len(_KEPT):
        _KEPT = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    out: list[str] = []
    for k in range(0, len(texts), 64):
        plain = [unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()) if t else "" for t in texts[k : k + 64]]
        points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        kept = np.flatnonzero(_KEPT[points])
        ends = np.searchsorted(kept, np.cumsum([0, *map(len, plain)])).tolist()
        joined = points[kept].tobytes().decode("utf-32-le", "surrogatepass")
        out += [joined[a:b] for a, b in zip(ends, ends[1:])]
    return out


def symbols(text: str) -> np.ndarray:
    """1..31 for each letter."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return ((points * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(SIGMA - 1)).astype(np.uint8) + np.uint8(1)


_LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)  # all bits under the one of a place


class Index:
    """An FM index over texts; `bwt` and `owner` are all that is stored."""

    def __init__(self, bwt: np.ndarray, owner: np.ndarray):
        n = len(bwt)
        self.owner = owner
        blocks = n // 64 + 1
        padded = np.zeros(blocks * 64, np.uint8)
        padded[:n] = bwt
        grid = padded.reshape(blocks, 64)
        self.masks = np.empty((SIGMA, blocks), np.uint64)
        self.counts = np.zeros((SIGMA, blocks), np.uint32)
        for c in range(SIGMA):
            self.masks[c] = np.packbits(grid == c, axis=1, bitorder="little").view(np.uint64).ravel()
            np.cumsum(np.bitwise_count(self.masks[c][:-1]), out=self.counts[c][1:])
        self.blocks, self.flat_masks, self.flat_counts = blocks, self.masks.ravel(), self.counts.ravel()
        self.first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=SIGMA))]).astype(np.int64)

    @staticmethod
    def build(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(bwt, owner) of texts of symbols; symbol 0 stands behind each text."""
        joined = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.uint8))])
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
        n, half = len(joined), DEPTH // 2
        padded = np.concatenate([joined, np.zeros(DEPTH, np.uint8)]).astype(np.int64)
        key = np.zeros(n, np.int64)
        for k in range(half):
            key = key * SIGMA + padded[k : k + n]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        after = np.concatenate([rank[half:], np.zeros(half, np.int64)])
        order = np.argsort(rank * (int(rank.max()) + 1) + after, kind="stable")
        return joined[order - 1], owner[order]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs in bwt before i."""
        at = c * self.blocks + (i >> 6)
        return self.flat_counts.take(at) + np.bitwise_count(self.flat_masks.take(at) & _LOW.take(i & 63)).astype(np.int64)

    def search(self, text: np.ndarray, stop: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the windows text[stop - length : stop]: each one's range of suffixes, lo = hi if it is nowhere."""
        lo, hi = np.zeros(len(stop), np.int64), np.full(len(stop), len(self.owner), np.int64)
        alive = np.arange(len(stop))
        for k in range(int(length.max()) if len(length) else 0):
            alive = alive[(length[alive] > k) & (lo[alive] < hi[alive])]
            if not len(alive):
                break
            c = text.take(stop.take(alive) - 1 - k).astype(np.int64)
            first = self.first.take(c)
            if k:
                lo[alive] = first + self.rank(c, lo.take(alive))
                hi[alive] = first + self.rank(c, hi.take(alive))
            else:
                lo[alive], hi[alive] = first, self.first.take(c + 1)
        return lo, np.maximum(lo, hi)


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... counts[1] - 1, and so on."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Runs:
    """The runs of `texts` that are located, the same for all shards; `index` says which runs are rare, and any choice loses nothing."""

    def __init__(self, index: Index, texts: list[str], share: float):
        self.n = n = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(n) - n
        width = np.clip(np.ceil(share * n - EPS).astype(np.int64) // 4, 1, SEED)  # the seed of covered() for the shortest partner
        runs = np.maximum(n - width + 1, 0)
        text, at = np.repeat(np.arange(len(texts)), runs), _steps(runs)
        size, place = width[text], begin[text] + at
        # each different run is searched once; its code has five bits for a symbol, the last one's highest, so that runs of one end
        # are searched beside each other and read the same counts
        self.joined = joined = symbols("".join(texts))
        padded = np.concatenate([joined, np.zeros(SEED, np.uint8)]).astype(np.int64)
        codes = np.zeros(len(joined), np.int64)
        for k in range(SEED):
            codes |= padded[k : k + len(joined)] << 5 * k
        code = codes[place] & ((1 << 5 * size) - 1)
        _, one, same = np.unique(code, return_index=True, return_inverse=True)
        lo, hi = index.search(joined, place[one] + size[one], size[one])
        times = (hi - lo)[same]
        # of each letter the most frequent run that it is in; the letters of each text whose runs are rarest. Whole runs by doubling:
        # none begins on the last letters of a text, so nothing goes over to the next
        cost = np.zeros(len(joined), np.int64)
        whole = size == SEED
        cost[place[whole]] = times[whole]
        for k in (1, 2, 4):
            cost[k:] = np.maximum(cost[k:], cost[:-k])
        part, p, t = size[~whole], place[~whole], times[~whole]
        for k in range(SEED if len(part) else 0):
            on = k < part
            np.maximum.at(cost, p[on] + k, t[on])
        of = np.repeat(np.arange(len(texts)), n)
        order = np.argsort(of * (int(cost.max(initial=0)) + 1) + cost, kind="stable")
        self.wanted = np.minimum(n, np.ceil((1 - share + LOCATED) * n).astype(np.int64))
        chosen = np.zeros(len(cost), bool)
        chosen[order[_steps(n) < self.wanted[of]]] = True
        self.before = np.concatenate([[0], np.cumsum(chosen)]).astype(np.int32)  # chosen letters before a place
        keep = np.flatnonzero(self.before[place + size] > self.before[place])
        self.text, self.place, self.size = text[keep].astype(np.int32), place[keep].astype(np.int32), size[keep].astype(np.int8)
        used = np.zeros(len(one), bool)
        used[same[keep]] = True
        self.same = (np.cumsum(used) - 1)[same[keep]].astype(np.int32)  # the number of each run's search
        self.stop, self.long = (place[one] + size[one])[used], size[one][used]


def candidates(index: Index, texts: list[str], share: float = 0.8, located: Runs | None = None) -> Iterator[tuple[int, int]]:
    """(number of text, owner in the index) of texts that may be near-same; all that are near-same are among them."""
    if not any(texts):
        return
    r = located or Runs(index, texts, share)
    n, before, wanted = r.n, r.before, r.wanted
    lo, hi = index.search(r.joined, r.stop, r.long)
    keep = np.flatnonzero((hi > lo)[r.same])
    if not len(keep):
        return
    length = np.bincount(index.owner) - 1
    owners, run_bits = len(length), int(len(keep)).bit_length()  # a pair is text * owners + owner; runs are put to it and taken off by shifts
    text, place, size, lo, times = r.text[keep].astype(np.int64), r.place[keep].astype(np.int64), r.size[keep].astype(np.int64), lo[r.same[keep]], (hi - lo)[r.same[keep]]
    # the runs in parts of HITS places or a run more; a text has more than one part only if it has more places than that
    total = np.concatenate([[0], np.cumsum(times)])
    edges = [0, *(np.flatnonzero(np.diff(text)) + 1).tolist(), len(text)]
    whole = set(edges)
    parts: list[tuple[int, int]] = []
    first = 0
    for a, b in zip(edges, edges[1:]):
        if a > first and total[b] - total[first] > HITS:
            parts.append((first, a))
            first = a
        while total[b] - total[first] > HITS and b - first > 1:
            cut = max(first + 1, int(np.searchsorted(total, total[first] + HITS, "right")) - 1)
            parts.append((first, cut))
            first = cut
    if first < len(text):
        parts.append((first, len(text)))
    least = np.maximum(1, -(-(wanted - n + np.ceil(share * n - EPS).astype(np.int64)) // SEED))  # runs that a text needs in a partner at least
    left: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # of the text that goes on
    for k, (first, last) in enumerate(parts):
        counts = times[first:last]
        owner = index.owner[np.arange(total[last] - total[first]) + np.repeat(lo[first:last] - (total[first:last] - total[first]), counts)]
        run = np.repeat(np.arange(first, last, dtype=np.int32), counts)
        base, here = int(text[first]), int(text[last - 1] - text[first]) + 1
        cell = np.repeat((text[first:last] - base) * owners, counts)
        cell += owner
        if first in whole and last in whole and here * owners <= max(CELLS, 2 * len(owner)):
            # whole texts: first the places of each pair are counted, as a place has SEED letters at most
            often = np.bincount(cell, minlength=here * owners).reshape(here, owners) >= least[base : base + here, None]
            at = np.flatnonzero(often.ravel()[cell])
            cell, run = cell[at], run[at]
        # an owner's runs in order: what each adds to its span
        key = np.sort(cell + base * owners << run_bits | run)
        key = key[np.diff(key, prepend=-1) > 0]
        pair, run = key >> run_bits, key & (1 << run_bits) - 1
        start = place[run]
        stop = start + size[run]
        start[1:] = np.where(pair[1:] == pair[:-1], np.maximum(start[1:], stop[:-1]), start[1:])
        adds = before[stop] - before[start]
        if len(left[0]):
            pairs, back = np.unique(np.concatenate([left[0], pair]), return_inverse=True)
            got = np.bincount(back, weights=np.concatenate([left[1], adds]), minlength=len(pairs)).astype(np.int64)
        else:
            at = np.flatnonzero(np.diff(pair, prepend=-1))
            pairs, got = pair[at], np.add.reduceat(adds, at, dtype=np.int64) if len(at) else adds.astype(np.int64)
        on = np.zeros(len(pairs), bool) if k + 1 == len(parts) else pairs // owners == text[parts[k + 1][0]]
        left = pairs[on], got[on]
        pairs, got = pairs[~on], got[~on]
        t, e = pairs // owners, pairs % owners
        longest = np.maximum(n[t], length[e])
        found = (np.minimum(n[t], length[e]) >= share * longest - EPS) & (got >= np.maximum(1, wanted[t] - (n[t] - share * longest) - EPS))
        yield from zip(t[found].tolist(), e[found].tolist())


def covered(a: str, b: str, seed: int = SEED) -> int:
    """Letters of a in matches with b of seed letters or more."""
    seed = min(seed, max(1, min(len(a), len(b)) // 4))
    there = {b[i : i + seed] for i in range(len(b) - seed + 1)}
    total = last = 0
    for i in range(len(a) - seed + 1):
        if a[i : i + seed] in there:
            total += i + seed - max(i, last)
            last = i + seed
    return total


def near_same(a: str, b: str, share: float) -> bool:
    """Is at least `share` of the longer text also in the other, in whatever order?"""
    longest = max(len(a), len(b))
    if min(len(a), len(b)) < share * longest or not longest:
        return False
    return a == b or min(covered(a, b), covered(b, a)) >= share * longest


def _texts(rows: DataFrame) -> DataFrame:
    """Of each row the key of its text in letters, the letters, and how many there are; null, null and 0 if it has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            norm = [t or None for t in letters_of(b["txt"].tolist())]
            b["key"] = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if t else None for t in norm]
            yield b.assign(norm=norm, n=[len(t or "") for t in norm]).drop(columns="txt")

    return rows.mapInPandas(run, "rec_id long, sid long, ev boolean, key string, norm string, n int")


def _build(shard: tuple, g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("key")
    bwt, owner = Index.build([symbols(t) for t in g["norm"]])
    return pd.DataFrame({"shard": [shard[0]], "keys": ["".join(g["key"])], "bwt": [bwt.tobytes()], "owner": [owner.tobytes()]})


def _read(uri: str) -> Iterator[tuple[Index, list[str]]]:
    """The shards in the shared folder, one at a time."""
    where, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    files = sorted(f.path for f in where.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet"))
    for file in files:
        with where.open_input_file(file) as f:
            for k in range((table := pq.ParquetFile(f)).num_row_groups):
                for row in table.read_row_group(k).to_pylist():
                    yield Index(np.frombuffer(row["bwt"], np.uint8), np.frombuffer(row["owner"], np.int32)), [row["keys"][i : i + 32] for i in range(0, len(row["keys"]), 32)]


def _chunks(batches: Iterator[pd.DataFrame], most: int = 10_000_000) -> Iterator[pd.DataFrame]:
    """The batches put together to chunks of `most` letters or a batch more."""
    kept, size = [], 0
    for b in batches:
        kept.append(b)
        size += int(b["norm"].str.len().sum())
        if size >= most:
            yield pd.concat(kept)
            kept, size = [], 0
    if size:
        yield pd.concat(kept)


def near_same_texts(training: DataFrame, evaluation: DataFrame, share: float = 0.8, shard: int = SHARD) -> DataFrame:
    """t, e: keys of the different training and evaluation texts (key, norm, n) that are near-same."""
    spark = training.sparkSession
    total = evaluation.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard))
    path = f"{run_dir(spark)}/fm-index-{uuid.uuid4().hex}"
    placed = evaluation.select("key", "norm", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    placed.groupBy("shard").applyInPandas(_build, "shard long, keys string, bwt binary, owner binary").write.parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # some texts are kept at a time, with the runs to be located in all shards, and each shard is read once for all of them
        for texts in _chunks(batches):
            keys, norm = list(texts["key"]), list(texts["norm"])
            parts = range(0, len(keys), BATCH)
            located: list[Runs] = []
            for index, owners in _read(path):
                located = located or [Runs(index, norm[k : k + BATCH], share) for k in parts]
                for k, runs in zip(parts, located):
                    found = [(keys[k + t], norm[k + t], owners[e]) for t, e in candidates(index, norm[k : k + BATCH], share, runs)]
                    for i in range(0, len(found), BATCH):
                        yield pd.DataFrame(found[i : i + BATCH], columns=["t", "a", "e"])

    pairs = training.select("key", "norm").mapInPandas(run, "t string, a string, e string")
    sides = pairs.join(evaluation.select(F.col("key").alias("e"), F.col("norm").alias("b")), "e")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[near_same(x, y, share) for x, y in zip(b["a"], b["b"])], ["t", "e"]]

    return sides.select("t", "e", "a", "b").mapInPandas(verify, "t string, e string")


def _near_keys(rows: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The records (rec_id, sid, ev, key of the text or null), and the pairs of keys (t, e) that are near-same, each once."""
    texts = materialize(_texts(spread(rows.select("rec_id", "sid", "ev", "txt"))), "overlap-texts")
    # one row for each different text: copies are dropped before and after the shuffle
    sides = (F.bool_or("ev").alias("ev"), F.bool_or(~F.col("ev")).alias("tr"))
    once = materialize(texts.where("key is not null").groupBy("key").agg(F.min("norm").alias("norm"), F.first("n").alias("n"), *sides), "overlap-once")
    return texts.select("rec_id", "sid", "ev", "key"), materialize(near_same_texts(once.where("tr"), once.where("ev"), share).distinct(), "overlap-keys")


def _records(bank: DataFrame, train: tuple[str, ...], evaluate: tuple[str, ...]) -> DataFrame:
    return bank.where(F.col("split").isin(*train, *evaluate)).select("rec_id", "sid", F.col("emr").alias("txt"), F.col("split").isin(*evaluate).alias("ev"))


def cross_split(bank: DataFrame, train: tuple[str, ...] = ("sft",), evaluate: tuple[str, ...] = ("dev", "gold"), share: float = 0.8, salts: int = 8) -> DataFrame:
    """train_id, eval_id, same_sid, near_emr: all pairs of a training and an evaluation record that are one case or near-same.

    Same case: equal sid, other than null and -1. Near-same: at least `share` of the longer emr, in letters and digits, is
    also in the other, whatever the order. Null, empty and blank texts, and texts without letters or digits, are near-same
    to none. Splits other than those given, and null, take no part. A pair comes out once, with both reasons if both hold;
    repeated rec_ids are one record. All pairs come out, also those within large groups of copies or of one sid: such
    groups are joined in salts. Empty tables give no rows. Extra columns are ignored.
    """
    records, keys = _near_keys(_records(bank, train, evaluate), share)
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    by_salt = F.pmod(F.xxhash64("train_id"), F.lit(salts))
    a = records.where("not ev").select("sid", F.col("rec_id").alias("train_id"), F.col("key").alias("t")).withColumn("salt", by_salt)
    b = records.where("ev").select(F.col("sid").alias("_sid"), F.col("rec_id").alias("eval_id"), F.col("key").alias("e"))
    case = F.col("sid") != -1
    one_case = F.coalesce(case & (F.col("sid") == F.col("_sid")), F.lit(False))
    near = a.where("t is not null").join(keys.withColumn("salt", salt), ["t", "salt"]).join(b.where("e is not null"), "e")
    near = near.select("train_id", "eval_id", one_case.alias("same_sid"), F.lit(True).alias("near_emr"))
    same = a.where(case).join(b.where("_sid <> -1").withColumnRenamed("_sid", "sid").withColumn("salt", salt), ["sid", "salt"])
    same = same.join(keys.withColumn("near", F.lit(True)), ["t", "e"], "left").select("train_id", "eval_id", F.lit(True).alias("same_sid"), F.coalesce("near", F.lit(False)).alias("near_emr"))
    if records.groupBy("rec_id").count().where("count > 1").isEmpty():
        # each record is one row, so each pair knows both its reasons: those of one case come from `same`, and none comes twice
        return near.where("not same_sid").unionByName(same)
    return near.unionByName(same).groupBy("train_id", "eval_id").agg(F.bool_or("same_sid").alias("same_sid"), F.bool_or("near_emr").alias("near_emr"))


def link_counts(bank: DataFrame, train: tuple[str, ...] = ("sft",), evaluate: tuple[str, ...] = ("dev", "gold"), share: float = 0.8) -> DataFrame:
    """rec_id, ev, class, copies, near_links, sid_links: how many records of the other side are near-same and of the same case.

    The same links as of cross_split, counted and not listed: class is the text's key, copies how many records of its own side
    have the text, and links are sums over classes, so that neither families of copies nor a hot sid is expanded into pairs.
    class is null and near_links 0 for records without text; sid_links is 0 without a sid.
    """
    rows = _records(bank, train, evaluate).dropDuplicates(["rec_id"])
    records, keys = _near_keys(rows, share)
    texts = records.where("key is not null")
    size = texts.groupBy("key", "ev").agg(F.count(F.lit(1)).alias("copies"))
    of = lambda ev, name: size.where(F.col("ev") == ev).select(F.col("key").alias(name), "copies")
    far = keys.join(of(True, "e"), "e").groupBy(F.col("t").alias("key")).agg(F.sum("copies").alias("near_links")).withColumn("ev", F.lit(False))
    near = far.unionByName(keys.join(of(False, "t"), "t").groupBy(F.col("e").alias("key")).agg(F.sum("copies").alias("near_links")).withColumn("ev", F.lit(True)))
    classes = size.join(near, ["key", "ev"], "left")
    sids = rows.where("sid is not null and sid <> -1").groupBy("sid", F.col("ev").alias("_other")).agg(F.count(F.lit(1)).alias("sid_links"))
    x = rows.select("rec_id", "sid", "ev").join(texts.select("rec_id", "key"), "rec_id", "left").join(classes, ["key", "ev"], "left")
    x = x.withColumn("_other", ~F.col("ev")).join(sids, ["sid", "_other"], "left")
    return x.select("rec_id", "ev", F.col("key").alias("class"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("near_links", F.lit(0)).alias("near_links"), F.coalesce("sid_links", F.lit(0)).alias("sid_links"))
