"""Implausible readings: physical bounds, stuck values and spikes, per source (sid, item).

Each source's different readings stream once, in order of time, through a rolling comparison: a run of one to three readings
is held against the rolling medians of the five readings before and after it, and runs of equal numbers are measured.
A Hampel filter by the median absolute deviation would veto some runs, since a run's own readings widen the deviation; so
the median change of the source takes its place. Rolling medians of runs of three lengths have no built-in counterpart that
does not make an array for each row; they run in numpy over whole Arrow batches, and only where the numbers around are far
enough apart. What that stage gives out is small: candidates with how far they leave their levels, counts of changes, and
the ends of spans. Everything before and after it is built in.

A source may hold any share of the rows: it is cut into spans of time. Readings near an end of a span, whose neighbours are
in another, are judged again with the neighbouring spans' ends beside them, if there are any. Copies of a reading are
counted before they are shuffled; a group of copies of any size is one row from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

KEY = ("sid", "item")
REACH = 9  # readings that a verdict may need on either side
LEVEL = 5  # readings that make the level on either side
RUNS = tuple((n, o) for n in (1, 2, 3) for o in range(n))  # lengths of runs, and the places that a reading may have in them
STUCK = 10
EPS = 1e-9
HOLD = 2 * REACH

MARKS = (
    "tag string, sid long, item string, span long, us long, v double, row_id long, copies long, min_jump double, stuck boolean, at_end boolean, judged boolean, leaves array<double>, strays array<double>"
)
_SCHEMA = pa.schema([
    ("tag", pa.string()), ("sid", pa.int64()), ("item", pa.string()), ("span", pa.int64()), ("us", pa.int64()), ("v", pa.float64()), ("row_id", pa.int64()), ("copies", pa.int64()), ("min_jump", pa.float64()),
    ("stuck", pa.bool_()), ("at_end", pa.bool_()), ("judged", pa.bool_()), ("leaves", pa.list_(pa.float64())), ("strays", pa.list_(pa.float64())),
])


def _rows(tag: str, table: pa.Table, at: np.ndarray, **given) -> pa.RecordBatch:
    """The rows of the table at some places, with columns given; the others of the schema are null."""
    part = table.take(pa.array(at))
    cols = []
    for f in _SCHEMA:
        if f.name == "tag":
            cols.append(pa.array([tag] * len(at), pa.string()) if len(at) < 64 else pa.DictionaryArray.from_arrays(np.zeros(len(at), np.int32), [tag]).cast(pa.string()))
        elif f.name in given:
            cols.append(pa.array(given[f.name], f.type) if isinstance(given[f.name], np.ndarray) else given[f.name])
        elif f.name in part.column_names:
            cols.append(part[f.name].combine_chunks().cast(f.type))
        else:
            cols.append(pa.nulls(len(at), f.type))
    return pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


def _spread(v: np.ndarray, take) -> np.ndarray:
    """Greatest (or least) number from seven places before to seven after, whatever the source."""
    n = len(v)
    padded = np.concatenate([np.full(7, v[0]), v, np.full(8, v[-1])])
    for k in (1, 2, 4):
        padded[: len(padded) - k] = take(padded[: len(padded) - k], padded[k:])
    return take(padded[:n], padded[7 : 7 + n])


def _median(parts: np.ndarray) -> np.ndarray:
    """Medians of rows in which NaN stands for no number; NaN where there is none at all."""
    s = np.sort(parts, axis=1)  # NaN last
    n = (~np.isnan(s)).sum(axis=1)
    at = np.arange(len(s))
    return (s[at, np.maximum(n - 1, 0) // 2] + s[at, np.minimum(n // 2, s.shape[1] - 1)]) / 2 if s.shape[1] else np.full(len(s), np.nan)


def _margins(v: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the readings at some places and each run that they may lie in: by how much all of the run leave the levels before
    and after it, to whatever side, and how far the readings beside the run are from these levels. NaN: no such run."""
    places = np.arange(-LEVEL - 2, LEVEL + 3)
    off = at[:, None] + places
    near = v[np.clip(off, 0, len(v) - 1)]
    near[(places < -left[at, None]) | (places > right[at, None])] = np.nan
    mid = LEVEL + 2
    leaves, strays = np.empty((len(at), len(RUNS))), np.empty((len(at), len(RUNS)))
    for k, (n, o) in enumerate(RUNS):
        s, e = mid - o, mid - o + n - 1
        before, after = _median(near[:, s - LEVEL : s]), _median(near[:, e + 1 : e + 1 + LEVEL])
        run = near[:, s : e + 1]
        top, low = np.maximum(before, after)[:, None], np.minimum(before, after)[:, None]
        leaves[:, k] = np.maximum(run - top, low - run).min(axis=1)
        strays[:, k] = np.maximum(np.abs(near[:, s - 1] - before), np.abs(near[:, e + 1] - after))
    return leaves, strays


def _lists(x: np.ndarray, keep: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)), pa.array(x[keep]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of readings that come in order of source, span and time. HOLD readings are held back until what follows them is
    known, and as many are kept before them, so that memory does not grow with a source."""
    kept: pa.Table | None = None
    done, base = 0, 0  # rows of kept that were given out before; place in its group of the first row kept

    def chunk(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal kept, done, base
        col = lambda c: table[c].to_numpy()
        g, v, size = col("grp"), col("v"), table.num_rows
        i = np.arange(size)
        starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
        lens = np.diff(np.append(starts, size))
        of = np.repeat(np.arange(len(starts)), lens)
        left, right = i - starts[of], (starts + lens)[of] - 1 - i
        place = left + np.where(of == 0, base, 0)  # in its group, from 0
        stop = size if last else max(starts[-1], size - HOLD)
        now = slice(done, stop)
        chg = np.abs(np.diff(v, prepend=v[:1]))
        follows = left > 0
        same = follows & (chg == 0)
        broken = np.maximum.accumulate(np.where(same, 0, i))
        ahead = np.minimum.accumulate(np.where(np.append(same[1:], False), size, i)[::-1])[::-1]
        stuck = ahead - broken + 1 >= STUCK
        jump = col("min_jump")
        with np.errstate(invalid="ignore"):
            wide = (_spread(v, np.maximum) - v >= jump - EPS) | (v - _spread(v, np.minimum) >= jump - EPS)
            held = np.flatnonzero((stuck | wide)[now]) + done
            leaves, strays = _margins(v, left, right, held)
            fits = leaves >= (jump[held] - EPS)[:, None]
        some = stuck[held] | fits.any(axis=1)
        held, leaves, strays, fits = held[some], leaves[some], strays[some], fits[some]
        at_end = (place < REACH) | (right < REACH)
        if len(held):
            yield _rows("held", table, held, stuck=stuck[held], at_end=at_end[held], leaves=_lists(leaves, fits), strays=_lists(strays, fits))
        ends = np.flatnonzero(((place < HOLD) | (right < HOLD))[now]) + done
        if len(ends):
            yield _rows("end", table, ends, at_end=at_end[ends])
        moved = np.flatnonzero((follows & (place > 0))[now]) + done
        if len(moved):
            size_of = np.round(chg[moved], 6)
            order = np.lexsort((size_of, of[moved]))
            a, b = of[moved][order], size_of[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            yield _rows("change", table, moved[order][first], v=b[first], copies=np.diff(np.append(first, len(a))))
        begin = max(starts[-1], stop - HOLD)
        kept, base, done = table.slice(begin), int(place[begin]) if begin < size else 0, stop - begin

    for batch in batches:
        if batch.num_rows:
            new = pa.Table.from_batches([batch])
            yield from chunk(pa.concat_tables([kept, new]).combine_chunks() if kept is not None and kept.num_rows else new, False)
    if kept is not None and kept.num_rows > done:
        yield from chunk(kept, True)


def _marks(readings: DataFrame, *part: str) -> DataFrame:
    """Marks of the different readings (sid, item, span, us, v, row_id, copies, min_jump, judged), windowed by part."""
    x = readings.withColumn("grp", F.xxhash64(*part)).repartition(*part).sortWithinPartitions(*part, "us", "v")
    return x.mapInArrow(_scan, MARKS)


def source_changes(changes: DataFrame, spans: DataFrame) -> DataFrame:
    """Of each source: how many spans it has, and its med (median change), changes, and changed, those other than 0.

    changes: sid, item, chg, c, counts of changes within spans; spans: sid, item, span, fv, lv, the first and last number.
    """
    by_source = W.partitionBy(*KEY)
    spans = spans.withColumn("chg", F.abs(F.col("fv") - F.lag("lv").over(by_source.orderBy("span"))))
    between = spans.where("chg is not null").select(*KEY, F.round("chg", 6).alias("chg"), F.lit(1).cast("long").alias("c"))
    counts = changes.unionByName(between).groupBy(*KEY, "chg").agg(F.sum("c").alias("c"))
    counts = counts.withColumns({"cum": F.sum("c").over(by_source.orderBy("chg")), "all": F.sum("c").over(by_source)})
    stats = counts.groupBy(*KEY).agg(
        ((F.min(F.when(F.col("cum") > F.floor((F.col("all") - 1) / 2), F.col("chg"))) + F.min(F.when(F.col("cum") > F.floor(F.col("all") / 2), F.col("chg")))) / 2).alias("med"),
        F.sum("c").alias("changes"), F.sum(F.when(F.col("chg") > 0, F.col("c")).otherwise(0)).alias("changed"),
    )
    return spans.groupBy(*KEY).agg(F.count(F.lit(1)).alias("spans")).join(stats, list(KEY), "left")


def _kind() -> Column:
    """The kind of a mark beside its source's numbers; null for none."""
    limit = F.greatest(F.col("min_jump"), 8 * F.col("med")) - EPS
    limit = F.when(F.col("min_jump").isNotNull() & F.col("med").isNotNull(), limit)
    spiking = F.exists(F.arrays_zip("leaves", "strays"), lambda r: (r["leaves"] >= limit) & (r["strays"] < limit))
    return F.when(F.col("stuck") & (2 * F.col("changed") > F.col("changes")), "stuck").when(spiking, "spike")


def implausible(rows: DataFrame, span_days: int = 28, salts: int = 8) -> DataFrame:
    """row_id, kind of each implausible row of rows (sid, item, us, v, row_id, lo, hi, min_jump).

    kind is `impossible` (outside lo..hi; a null bound is none), else, without those, `stuck` (one of ten or more
    successive readings of the same number in a source of which more than half of the successive readings differ), else
    `spike` (one to three successive readings that each leave the level of the five readings before and after them, to
    whatever side, by min_jump and by 8 times the source's median change at least; null min_jump: no spikes). Rows with the
    same source, time and number are one reading and share its kind. Readings of one time with several numbers are taken
    in order of the number. min_jump must be one per item. Empty tables give no rows.

    The rows are parsed once and written to the shared folder; from there they are counted by reading, and read again only
    for copies of readings that were found.
    """
    bad = F.coalesce(F.col("v") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("v") > F.col("hi"), F.lit(False))
    x = rows.where("sid is not null and item is not null and us is not null and v is not null")
    parsed = materialize(x.select(*KEY, "us", "v", "row_id", F.col("min_jump").cast("double").alias("min_jump"), bad.alias("bad")), "readings")
    width = F.lit(span_days * 86_400_000_000)
    span = ((F.col("us") - F.pmod("us", width)) / width).cast("long")
    sound = parsed.where("not bad")
    once = sound.groupBy(*KEY, "us", (F.col("v") + F.lit(0.0)).alias("v")).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copies"), F.max("min_jump").alias("min_jump"))
    once = once.select(*KEY, span.alias("span"), "us", "v", "row_id", "copies", "min_jump", F.lit(None).cast("boolean").alias("judged"))
    marks = materialize(_marks(once, *KEY, "span"), "marks")
    ends = marks.where("tag = 'end'")
    at = F.struct("us", "v")
    spans = ends.groupBy(*KEY, "span").agg(F.min(at)["v"].alias("fv"), F.max(at)["v"].alias("lv"))
    sources = materialize(source_changes(marks.where("tag = 'change'").select(*KEY, F.col("v").alias("chg"), F.col("copies").alias("c")), spans), "source-changes")
    outer = ends.join(sources.where("spans > 1").select(*KEY), list(KEY), "left_semi").select(*KEY, "span", "us", "v", "row_id", "copies", "min_jump", F.col("at_end").alias("judged"))
    outer = _marks(outer, *KEY).where("tag = 'held' and judged").withColumn("at_end", F.lit(None).cast("boolean"))
    held = marks.where("tag = 'held'").unionByName(outer).join(sources, list(KEY)).where("at_end is null or not at_end or spans = 1")
    found = materialize(held.withColumn("kind", _kind()).where("kind is not null").select(*KEY, "us", "v", "row_id", "copies", "kind"), "implausible")  # few rows, used twice
    # a group of copies may be of any size: its rows are spread over salts
    several = found.where("copies > 1").select(*KEY, "us", "v", F.col("row_id").alias("first"), "kind")
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    copied = sound.withColumn("salt", F.pmod("row_id", F.lit(salts))).join(several, [*KEY, "us", "v", "salt"]).where("row_id <> first").select("row_id", "kind")
    return parsed.where("bad").select("row_id", F.lit("impossible").alias("kind")).unionByName(found.select("row_id", "kind")).unionByName(copied)
