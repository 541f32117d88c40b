"""Irregular readings onto a regular grid.

Consecutive readings of a source are paired by lead; only the grid times between the two are exploded, and they are
interpolated or marked inline by the length of the gap. No calendar table is made and joined.

A source may hold any share of the rows: its readings are windowed by span of time, and a reading that lies in the first
`session_gap` of a span is given to the span before it too, as a successor only. With spans of 28 session gaps that
copies 1/28 of the rows, and no pair within a session is lost, since a successor further away ends the session anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

MIN_US = 60_000_000
SESSION_GAP_MIN = 360


def slot_of(us: Column, grid_min: Column) -> Column:
    """Start, in minutes since 1970, of the slot that a time lies in."""
    width = grid_min.cast("long") * MIN_US
    return ((us - F.pmod(us, width)) / MIN_US).cast("long")


def _span(us: Column, width: int) -> Column:
    return ((us - F.pmod(us, F.lit(width))) / width).cast("long")


def pairs(rows: DataFrame, session_gap_min: int = SESSION_GAP_MIN, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of a source (sid, item) with its successor's us and carried columns (next_*), if of the same session."""
    gap, span = session_gap_min * MIN_US, session_gap_min * MIN_US * 28
    own = _span(F.col("us"), span)
    early = F.col("us") - own * span <= gap
    at = F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own)))
    w = W.partitionBy("sid", "item", "_span").orderBy("us", *carry)
    x = rows.withColumn("_span", at)
    x = x.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("us", *carry)})
    return x.where(F.col("_span") == _span(F.col("us"), span)).where(F.col("next_us") - F.col("us") <= gap).drop("_span")


def gaps(rows: DataFrame, session_gap_min: int = SESSION_GAP_MIN) -> DataFrame:
    """sid, item, slot_min: the slots without a reading between successive readings of a session.

    rows: sid, item, us, grid_min. Null grid_min or one below 1 gives no slots. Ties and repeats lie in one slot and add
    nothing. A source with one reading, or an empty table, gives no rows.
    """
    x = rows.where("grid_min >= 1").select("sid", "item", "us", "grid_min")
    p = pairs(x, session_gap_min).withColumns({"a": slot_of(F.col("us"), F.col("grid_min")), "b": slot_of(F.col("next_us"), F.col("grid_min"))})
    p = p.where("b - a > grid_min")
    return p.select("sid", "item", F.explode(F.sequence(F.col("a") + F.col("grid_min"), F.col("b") - F.col("grid_min"), F.col("grid_min").cast("long"))).alias("slot_min"))


BLOCK = 1440  # slots that are listed at a time where bounds lie far away


def regular_grid(rows: DataFrame, session_gap_min: int = SESSION_GAP_MIN, interpolate_min: int = 30, bounds: DataFrame | None = None) -> DataFrame:
    """sid, item, slot_min, value, state: one row per slot of each session of each source.

    state is `observed` (mean of the slot's readings), `interpolated` (linear between the neighbouring slots, gaps up to
    interpolate_min between them), `missing` (value null, longer gaps) or, where bounds (sid, lo_us, hi_us) are given,
    `before` and `after`: slots from lo to the source's first slot and from its last to hi, value null. Bounds that are
    null or end before they start add nothing; bounds of a wrong year add all their slots, a block at a time. Rows with null
    grid_min are left out; an empty table gives no rows.

    Readings are summed up to slots once, which are written to the shared folder; one window pairs each with its successor,
    and one explode gives the slot and those up to the next.
    """
    g = F.col("grid_min").cast("long")
    slots = materialize(
        rows.where("grid_min >= 1").withColumn("slot_min", slot_of(F.col("us"), F.col("grid_min"))).groupBy("sid", "item", "slot_min", "grid_min").agg(F.avg("v").alias("value"), F.min("us").alias("first_us"), F.max("us").alias("us")),
        "grid-slots",
    )
    p = _slot_pairs(slots, session_gap_min)
    wide = F.col("next_slot_min") - F.col("slot_min")
    short = wide - g <= interpolate_min
    row = lambda at, value, state: F.struct(at.alias("slot_min"), value.cast("double").alias("value"), state.alias("state"))
    none = F.lit(None).cast("double")
    fill = F.transform(
        F.sequence(F.col("slot_min") + g, F.col("next_slot_min") - g, g),
        lambda at: row(at, F.when(short, F.col("value") + (at - F.col("slot_min")) / wide * (F.col("next_value") - F.col("value"))), F.when(short, "interpolated").otherwise("missing")),
    )
    own = F.array(row(F.col("slot_min"), F.col("value"), F.lit("observed")))
    out = p.select("sid", "item", F.inline(F.when(wide > g, F.concat(own, fill)).otherwise(own)))
    if bounds is None:
        return out
    ends = slots.groupBy("sid", "item", "grid_min").agg(F.min("slot_min").alias("a"), F.max("slot_min").alias("b"))
    x = ends.join(bounds.select("sid", "lo_us", "hi_us").where("lo_us <= hi_us"), "sid").withColumns({"lo": slot_of(F.col("lo_us"), F.col("grid_min")), "hi": slot_of(F.col("hi_us"), F.col("grid_min"))})
    part = lambda first, last, state: F.struct(first.alias("first"), last.alias("last"), F.lit(state).alias("state"))
    sides = F.filter(F.array(part(F.col("lo"), F.col("a") - g, "before"), part(F.col("b") + g, F.col("hi"), "after")), lambda r: r["first"] <= r["last"])
    x = x.select("sid", "item", g.alias("g"), F.inline(sides)).select("sid", "item", "g", "last", "state", F.explode(F.sequence("first", "last", F.col("g") * BLOCK)).alias("at"))
    slot = F.explode(F.sequence(F.col("at"), F.least(F.col("at") + F.col("g") * (BLOCK - 1), F.col("last")), F.col("g"))).alias("slot_min")
    return out.unionByName(x.select("sid", "item", slot, none.alias("value"), "state"))


def _slot_pairs(slots: DataFrame, session_gap_min: int) -> DataFrame:
    """Each slot with its successor in the session (next_*), null without one: the gap is measured from the slot's last to the
    next slot's first reading."""
    gap, span = session_gap_min * MIN_US, session_gap_min * MIN_US * 28
    own = _span(F.col("first_us"), span)
    early = F.col("first_us") - own * span <= gap + F.col("grid_min").cast("long") * MIN_US
    x = slots.withColumn("_span", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))))
    w = W.partitionBy("sid", "item", "_span").orderBy("slot_min")
    x = x.withColumns({f"_{c}": F.lead(c).over(w) for c in ("slot_min", "value", "first_us")}).where(F.col("_span") == _span(F.col("first_us"), span))
    goes_on = F.col("_first_us") - F.col("us") <= gap
    return x.withColumns({f"next_{c}": F.when(goes_on, F.col(f"_{c}")) for c in ("slot_min", "value")}).drop("_span", "_slot_min", "_value", "_first_us")
