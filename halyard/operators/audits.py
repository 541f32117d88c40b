"""Audits of what summaries flag: events of older texts, findings by category, precision by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values ---------------------------------------------------------------------------------------------------------
FINDING_WORDS = {
    "bradycardia": ("서맥", "brady", "심박수 저하", "hr 저하", "아트로핀", "atropine"), "tachycardia": ("빈맥", "tachy", "심박수 상승", "hr 상승"),
    "hypotension": ("저혈압", "hypotens", "혈압 저하", "bp 저하", "승압", "에페드린", "ephedrine", "페닐레프린", "phenylephrine", "노르에피네프린", "norepinephrine", "도파민", "dopamine", "볼루스", "bolus"),
    "hypertension": ("고혈압", "hypertens", "혈압 상승", "bp 상승"), "desaturation": ("탈포화", "desat", "산소포화도", "spo2", "저산소", "산소 요구", "o2", "산소 투여"),
    "hypothermia": ("저체온", "체온 저하", "hypotherm", "가온", "warming", "체온 유지"), "fever": ("발열", "fever", "고체온", "hypertherm"), "qtc": ("qtc", "qt 간격", "qt 연장"),
    "oliguria": ("핍뇨", "소변량", "oliguria", "urine", "uo"), "blood_loss": ("실혈", "출혈", "수혈", "transfus", "ebl", "bleed", "rbc", "ffp", "혈액제제", "prbc"),
}
#: The first word that a label holds says its category.
LABEL_CATEGORIES = (
    ("서맥", "bradycardia"), ("빈맥", "tachycardia"), ("저혈압", "hypotension"), ("고혈압", "hypertension"), ("고(>", "hypertension"), ("SpO2<", "desaturation"), ("탈포화", "desaturation"), ("목표미달", "desaturation"), ("저체온", "hypothermia"),
    ("안전범위 초과", "fever"), ("발열", "fever"), ("연장", "qtc"), ("핍뇨", "oliguria"), ("소변량", "oliguria"), ("실혈", "blood_loss"), ("정상하한 미만", "bradycardia"), ("정상상한 초과", "tachycardia"),
)
CRITICAL, EVENTS_AFTER, EVENT_SEP = "[유의]", ", 이벤트: ", " | "
EVENT = r"(\[유의\])?([^:|]+?):\s*(\d+)회\s*([^,]+?)\s*,\s*(최저|최고)\s*(-?[\d.]+)"
DURATION = r"(<1분)|([\d.]+)\s*(분|시간)"
MINUTES = ((1, "<1분"), (5, "1–5분"), (15, "5–15분"), (30, "15–30분"), (None, ">30분"))
TIMES = ((1, "1회"), (3, "2–3회"), (9, "4–9회"), (None, "10회+"))
UNKNOWN = "미상"
# ----------------------------------------------------------------------------------------------------------------------


def finding_categories(c: Column) -> Column:
    """The categories whose words a text holds; none for null."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w)), k) for k, ws in FINDING_WORDS.items()]))


def label_category(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, category in reversed(LABEL_CATEGORIES):
        out = F.when(F.contains(label, F.lit(word)), category).otherwise(out)
    return out


def minutes_of(text: Column) -> Column:
    """The first duration of a text in minutes: hours are sixty, under a minute is a half; null without one."""
    n = F.regexp_extract(text, DURATION, 2).try_cast("double")
    return F.when(F.regexp_extract(text, DURATION, 1) != "", 0.5).when(F.regexp_extract(text, DURATION, 3) == "시간", n * 60).otherwise(n)


def minutes_bucket(m: Column) -> Column:
    out = F.when(m.isNull(), UNKNOWN)
    for high, name in MINUTES:
        out = out.otherwise(name) if high is None else out.when(m < high, name)
    return out


def times_bucket(n: Column) -> Column:
    out = F.when(n.isNull(), UNKNOWN)
    for high, name in TIMES:
        out = out.otherwise(name) if high is None else out.when(n <= high, name)
    return out


def legacy_events(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, part, item, label, category, reportable, n, total_min, longest_min of the events in summaries of older form.

    Blank lines, the age line and headings hold none. A line has its events behind a mark, or is one itself; one that is
    marked critical but can't be read as an event is an event without numbers. Null texts have none.
    """
    x = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line", "t")).withColumn("t", F.trim("t"))
    x = x.where((F.col("t") != "") & ~F.startswith("t", F.lit("(연령군")) & ~F.startswith("t", F.lit("###")))
    listed = F.contains("t", F.lit(EVENTS_AFTER))
    parts = F.when(listed, F.split(F.substring_index("t", EVENTS_AFTER, -1), r" \| ")).otherwise(F.array("t"))
    marked = ~listed & F.contains("t", F.lit(CRITICAL)) & ~F.col("t").rlike(EVENT)
    strip = lambda c: F.regexp_replace(c, "^[ -]+|[ -]+$", "")
    x = x.select(key, "line", strip(F.substring_index("t", ":", 1)).alias("item"), marked.alias("marked"), F.posexplode(F.when(marked, F.filter(F.split("t", r"\[유의\]"), lambda p: F.trim(p) != "")).otherwise(parts)).alias("part", "p"))
    of = lambda k: F.regexp_extract("p", EVENT, k)
    x = x.withColumn("p", F.trim("p")).select(key, "line", "part", "item", "marked", of(1).alias("crit"), F.when(F.col("marked"), F.col("p")).otherwise(strip(of(2))).alias("label"), of(3).try_cast("int").alias("n"), of(4).alias("dur"))
    x = x.where("marked or n is not null")
    total = minutes_of(F.col("dur"))
    return x.select(
        key, "line", "part", "item", "label", label_category(F.col("label")).alias("category"), (F.col("marked") | (F.col("crit") != "")).alias("reportable"), "n", total.alias("total_min"),
        F.coalesce(minutes_of(F.regexp_extract("dur", r"최장[ ]*([^)]+)", 1)), total).alias("longest_min"),
    )


def ppv_table(events: DataFrame, keys: str, subset: str, hit: str) -> DataFrame:
    """key, subset, all_subsets, n, hits, ratio: an event counts under each of its keys (array), within its subset and over all."""
    x = events.select(F.explode(keys).alias("key"), F.col(subset).alias("subset"), F.col(hit).alias("hit"))
    return x.groupingSets([["key", "subset"], ["key"]], "key", "subset").agg(F.grouping("subset").cast("int").alias("all_subsets"), F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("ratio"))
