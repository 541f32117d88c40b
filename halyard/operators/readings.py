"""Readings of a long table of raw measurements: item, time and number of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.normalize import epoch_us, first_number, narrow, no_blanks, once

#: Running totals, for which 0 is a reading.
TOTALS = ("EBL", "UO")
#: Fixed value: a value of UO that says that there is no catheter.
NO_FOLEY = r"NF|NO.?FOLEY"
ARROW = r"<|←|⇐|⟵|↤|⬅|◀|◄"


def item_key(c):
    """The item's name before the first arrow, without blanks, width and case."""
    plain = F.regexp_extract(c, r"^([A-Za-z0-9]+) ?<", 1)
    return F.upper(F.when(plain != "", plain).otherwise(no_blanks(F.split(narrow(c), ARROW, 2)[0])))


def timed(vital: DataFrame, item_ref: DataFrame, totals: tuple[str, ...] = TOTALS) -> DataFrame:
    """row_id, sid, us, item, v, lo, hi, min_jump, grid_min, no_foley of every row of vital with a sid other than null and -1.

    us, item and v are null where the row has no time, no item of item_ref or no number; 0 is a number for totals only.
    no_foley: the row says that urine is not measured. Repeated rows stay repeated; extra columns of either table are
    ignored. item_ref is joined by name; Spark broadcasts it below its own size threshold, else sorts.
    """
    ref = item_ref.select(
        F.upper(no_blanks(narrow(F.col("item")))).alias("_key"), F.col("item"), F.col("plausible_lo").alias("lo"), F.col("plausible_hi").alias("hi"), "min_jump", "grid_min"
    ).where("_key is not null")
    x = once(
        vital.where("sid is not null and sid <> -1"), "row_id", "sid", us=epoch_us(F.col("ts")), _key=item_key(F.col("item_raw")), _v=first_number(F.col("value_raw")),
        _nf=F.coalesce(F.upper("value_raw").rlike(NO_FOLEY), F.lit(False)),
    ).join(ref, "_key", "left")
    v = F.when(F.col("item").isNotNull() & ((F.col("_v") != 0) | F.col("item").isin(*totals)), F.col("_v"))
    return x.select("row_id", "sid", "us", "item", v.alias("v"), "lo", "hi", "min_jump", "grid_min", (F.col("_nf") & F.coalesce(F.col("item") == "UO", F.lit(False))).alias("no_foley"))


def readings(vital: DataFrame, item_ref: DataFrame, totals: tuple[str, ...] = TOTALS) -> DataFrame:
    """sid, item, us, v, row_id, lo, hi, min_jump, grid_min of each row of vital that is a reading.

    A reading has a sid other than null and -1, a time, an item of item_ref and a number; 0 counts for totals only.
    Rows that lack any of these come out nowhere; null bounds stay null. Repeated rows stay repeated. Extra columns of
    either table are ignored. item_ref is joined by name; Spark broadcasts it below its own size threshold, else sorts.
    Empty tables give no rows.
    """
    ref = item_ref.select(
        F.upper(no_blanks(narrow(F.col("item")))).alias("_key"), F.col("item"), F.col("plausible_lo").alias("lo"), F.col("plausible_hi").alias("hi"), "min_jump", "grid_min"
    ).where("_key is not null")
    raw = vital.where("sid is not null and sid <> -1 and ts is not null")
    raw = once(raw, "row_id", "sid", us=epoch_us(F.col("ts")), _key=item_key(F.col("item_raw")), v=first_number(F.col("value_raw"))).where("us is not null and v is not null")
    return raw.join(ref, "_key").where((F.col("v") != 0) | F.col("item").isin(*totals)).drop("_key")
