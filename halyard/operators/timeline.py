"""Interventions from the timeline of an anaesthetic record, and their match with events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .vitals import MIN_US, NEAR_MIN

# fixed values ---------------------------------------------------------------------------------------------------------
KEYWORDS = {
    "vasopressor": ("ephedrine", "epinephrine", "epi ", "norepi", "phenylephrine", "dopamine", "dobutamine", "vasopressin", "milrinone", "승압", "에페드린", "에피네프린"),
    "anticholinergic": ("atropine", "glycopyrrolate", "robinul", "아트로핀"),
    "transfusion": ("prbc", "p-rbc", "rbc", "ffp", "platelet", "plt ", "cryo", "transfus", "수혈", "혈액제제"),
    "fluid_bolus": ("bolus", "volume loading", "fluid challenge", "albumin", "볼루스", "수액부하", "volume expan"),
    "airway_rescue": ("reintubat", "re-intubat", "재삽관", "laryngospasm", "후두경련", "bronchospasm", "기관지경련", "croup", "mask ventilation", "cpap", "recruitment", "suction ", "desat"),
    "cpr": ("cpr", "chest compression", "compression started", "defibrillat", "cardioversion", "제세동", "심장마사지"),
    "antiarrhythmic": ("amiodarone", "lidocaine ivs", "esmolol", "adenosine", "digoxin"),
}
ADMITTED = {
    "hypotension": ("vasopressor", "fluid_bolus", "transfusion"), "bradycardia": ("anticholinergic", "cpr", "vasopressor"), "tachycardia": ("antiarrhythmic",), "hypertension": (),
    "desaturation": ("airway_rescue", "cpr"), "hypothermia": (), "fever": (), "qtc": ("antiarrhythmic", "cpr"), "blood_loss": ("transfusion",), "oliguria": ("fluid_bolus", "transfusion"),
}
LABELS = {"vasopressor": "승압제", "anticholinergic": "아트로핀/항콜린", "transfusion": "수혈", "fluid_bolus": "수액부하", "airway_rescue": "기도 처치", "cpr": "심폐소생/제세동", "antiarrhythmic": "항부정맥제"}
ENTRY = r"[▶▷►]?\s*(\d{1,2}):(\d{2})\s*([^\n▶▷►]*)"
# ----------------------------------------------------------------------------------------------------------------------


def parse(records: DataFrame, text: str = "record") -> DataFrame:
    """sid, minute (of the day), entry: the timed entries of each record; times out of range and null texts give none."""
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(ENTRY), k).alias(n) for k, n in ((1, "h"), (2, "m"), (3, "entry"))])
    x = records.select("sid", F.explode(parts).alias("p")).select("sid", F.col("p.h").cast("int").alias("h"), F.col("p.m").cast("int").alias("m"), F.trim("p.entry").alias("entry"))
    return x.where("h <= 23 and m <= 59").select("sid", (F.col("h") * 60 + F.col("m")).alias("minute"), "entry")


def categories(entry: Column) -> Column:
    """The categories whose words the entry holds."""
    low = F.lower(entry)
    return F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), name) for name, words in KEYWORDS.items()]))


def interventions(entries: DataFrame) -> DataFrame:
    return entries.withColumn("category", F.explode(categories(F.col("entry")))).select("sid", "minute", "category", F.substring("entry", 1, 60).alias("snippet"))


def circular(a: Column, b: Column) -> Column:
    """Minutes between two times of day, the shorter way round."""
    d = F.pmod(F.abs(a - b), F.lit(1440))
    return F.least(d, 1440 - d)


def clock(minute: Column) -> Column:
    """A minute of the day as HH:MM."""
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def render(hits: Column) -> Column:
    """Interventions (structs of minute and category) in words, in order of time; null for null."""
    order = F.array(*map(F.lit, KEYWORDS))
    names = F.array(*[F.lit(LABELS[c]) for c in KEYWORDS])
    placed = F.array_sort(F.transform(hits, lambda h: F.struct(h["minute"].alias("minute"), F.array_position(order, h["category"]).cast("int").alias("place"))))
    return F.array_join(F.transform(placed, lambda h: F.concat(F.element_at(names, h["place"]), F.lit(" "), clock(h["minute"]))), ", ")


def matches(episodes: DataFrame, given: DataFrame, within: int = NEAR_MIN) -> DataFrame:
    """sid, item, kind, tier2, category, minute: interventions near the start or end of an episode, once each.

    The join is by sid and category, and by blocks of `within` minutes of the day with their neighbours, so that pairs far
    apart are not made. Of an event each minute of the day counts once, whatever the number of its episodes.
    """
    blocks = -(-1440 // within)
    admitted = F.create_map(*[x for k, v in ADMITTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    minute = lambda us: F.pmod(F.floor(F.col(us) / MIN_US), F.lit(1440)).cast("int")
    e = episodes.select("sid", "item", "kind", "tier2", F.explode(F.array_distinct(F.array(minute("from_us"), minute("to_us")))).alias("at"), admitted[F.col("kind")].alias("c")).distinct()
    e = e.withColumn("category", F.explode("c")).drop("c")
    e = e.withColumn("block", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.pmod(F.floor(F.col("at") / within) + k, F.lit(blocks))))))
    g = given.select("sid", "minute", "category").distinct().withColumn("block", F.floor(F.col("minute") / within))
    near = e.join(g, ["sid", "category", "block"]).where(circular(F.col("at"), F.col("minute")) <= within)
    return near.select("sid", "item", "kind", "tier2", "category", "minute").distinct()
