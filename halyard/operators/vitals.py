"""Vital signs: cleaned series, threshold episodes, events, their classification, and the summary of a case.

A reading violates one rule of its item at most (limits of one item don't cross), so a run of readings that violate the same
rule is a run of equal rule numbers: one window over (sid, item, span) in order of time marks runs, gaps and first times,
once, for all that follows. The marks are written to the shared folder; every operator below reads them.

A case may hold any share of the rows: sources are cut into spans of time, and runs that go over a border are put together
from the first and last run of each span, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import thresholds as T
from ..functions.normalize import fixed, shortest
from ..session import materialize

SERIES = ("sid", "item")
EVENT = ("sid", "item", "kind", "tier2")
MIN_US = 60_000_000
STEP_DEFAULT = 5.0
HANDOFF_MIN, BASELINE_MIN, BASELINE_LEAST, LONG_MIN, RUN_LEAST, NEAR_MIN = 15, 10, 3, 10.0, 2, 10
AGE_DEFAULT = 5.0
REASON_ORDER = ("R1", "R4", "R3", "R2")

# fixed values ---------------------------------------------------------------------------------------------------------
#: Items in the order in which their events are listed.
ITEMS = ("HR", "MBP", "DBP", "SBP", "IMBP1", "ISBP1", "IDBP1", "SpO2", "QTc", "T1")
#: kind, low side, tier 2, label before and after the threshold (or the whole label), unit, digits; rules count from 1.
RULES = (
    ("bradycardia", True, False, "서맥(<", ")", "bpm", 0), ("tachycardia", False, False, "빈맥(>", ")", "bpm", 0),
    ("bradycardia", True, True, "정상하한 미만(<", ")", "bpm", 0), ("tachycardia", False, True, "정상상한 초과(>", ")", "bpm", 0),
    ("hypotension", True, False, "저혈압(<", ")", "mmHg", 0), ("hypertension", False, True, "고혈압(>", ")", "mmHg", 0),
    ("hypotension", True, False, "저혈압(<", ")", "mmHg", 0), ("hypertension", False, True, "이완기 고혈압(>", ")", "mmHg", 0),
    ("desaturation", True, False, "탈포화(<90%)", None, "%", 0), ("desaturation", True, True, "목표미달(90–93%)", None, "%", 0),
    ("qtc", False, False, "QTc 연장(>480ms)", None, "ms", 0),
    ("hypothermia", True, False, "저체온(<35.5)", None, "°C", 1), ("hypothermia", True, True, "저체온(<36.0)", None, "°C", 1),
    ("fever", False, False, "발열(>38.0)", None, "°C", 1), ("fever", False, True, "안전범위 초과(>37.5)", None, "°C", 1),
)
AGE_LABELS = {"neonate": "신생아(<28일)", "infant": "영아(28일–1세)", "toddler": "유아(1–2세)", "preschool": "학령전(3–5세)", "school": "학령기(6–11세)", "adolescent": "청소년(≥12세)"}
REPORTABLE, HANDOFF, NOTHING = "### VITAL — REPORTABLE", "### VITAL — AT HANDOFF (last 15 min)", "- (인계 대상 바이탈 이상 없음)"
#: Items of the hand-off line with label, unit and digits.
AT_HANDOFF = (("HR", "HR", "", 0), ("SBP", "SBP", "", 0), ("ISBP1", "ISBP", "", 0), ("MBP", "MBP", "", 0), ("SpO2", "SpO2", "%", 0), ("T1", "T1", "°C", 1))
# ----------------------------------------------------------------------------------------------------------------------


def clean(readings: DataFrame) -> DataFrame:
    """Readings within their item's plausible range; null bounds keep all."""
    low, high = F.coalesce(F.col("v") < F.col("lo"), F.lit(False)), F.coalesce(F.col("v") > F.col("hi"), F.lit(False))
    return readings.where(~(low | high))


def drop_counts(readings: DataFrame) -> DataFrame:
    """Per item: readings, and those dropped below and above the plausible range."""
    return readings.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v") > F.col("hi")).alias("above"))


def with_age(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Adds age, five years where the case or its age is unknown."""
    return rows.join(cases.select("sid", "age"), "sid", "left").withColumn("age", F.coalesce("age", F.lit(AGE_DEFAULT)))


def rule_number(item: Column, v: Column, age: Column) -> Column:
    """The rule that a reading violates, from 1; null for none."""
    lo, hi = T.band(age, T.HR_NORMAL, 1), T.band(age, T.HR_NORMAL, 2)
    slow, fast = T.band(age, T.HR_CRITICAL, 1), T.band(age, T.HR_CRITICAL, 2)
    first = lambda *rules: F.coalesce(*[F.when(hit, n) for hit, n in rules])
    return (
        F.when(item == "HR", first((v < slow, 1), (v > fast, 2), (v < lo, 3), (v > hi, 4)))
        .when(item.isin("SBP", "ISBP1"), first((v < T.sbp_hypotension(age), 5), (v > T.sbp_p95(age), 6))).when(item.isin("MBP", "IMBP1"), first((v < T.map_hypotension(age), 7)))
        .when(item.isin("DBP", "IDBP1"), first((v > T.dbp_p95(age), 8))).when(item == "SpO2", first((v < T.SPO2_CRITICAL, 9), (v < T.SPO2_TARGET, 10)))
        .when(item == "QTc", first((v > T.QTC_LONG, 11))).when(item == "T1", first((v < T.TEMP_LOW, 12), (v < T.TEMP_HYPO, 13), (v > T.TEMP_FEVER, 14), (v > T.TEMP_HIGH, 15)))
    )


def rule_threshold(rule: Column, age: Column) -> Column:
    limits = (
        T.band(age, T.HR_CRITICAL, 1), T.band(age, T.HR_CRITICAL, 2), T.band(age, T.HR_NORMAL, 1), T.band(age, T.HR_NORMAL, 2), T.sbp_hypotension(age), T.sbp_p95(age), T.map_hypotension(age), T.dbp_p95(age),
        F.lit(T.SPO2_CRITICAL), F.lit(T.SPO2_TARGET), F.lit(T.QTC_LONG), F.lit(T.TEMP_LOW), F.lit(T.TEMP_HYPO), F.lit(T.TEMP_FEVER), F.lit(T.TEMP_HIGH),
    )
    out = F.when(rule == 1, limits[0])
    for k, limit in enumerate(limits[1:], 2):
        out = out.when(rule == k, limit)
    return out.cast("double")


def _of_rule(place: int) -> Column:
    return F.element_at(F.array(*[F.lit(r[place]) for r in RULES]), F.col("rule"))


def mark(timed: DataFrame, span_days: int = 28) -> DataFrame:
    """The rows (sid, item, us, v, row_id, lo, hi, age, and no_foley if there is one) with what the operators below need.

    ok: a reading with time, item and number within the plausible range. Of those: rule, prev_us (the reading before it in
    its span), first_us (the span's first) and run, the number of its run of equal rules in the span.
    """
    outside = F.coalesce(F.col("v") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("v") > F.col("hi"), F.lit(False))
    ok = F.col("item").isNotNull() & F.col("us").isNotNull() & F.col("v").isNotNull() & ~outside
    width = F.lit(span_days * 1440 * MIN_US)
    nf = F.col("no_foley") if "no_foley" in timed.columns else F.lit(False)
    x = timed.select(*SERIES, ((F.col("us") - F.pmod("us", width)) / width).cast("long").alias("span"), "us", "row_id", "v", "age", nf.alias("no_foley"), ok.alias("ok"))
    x = x.withColumn("rule", F.when(F.col("ok"), rule_number(F.col("item"), F.col("v"), F.col("age"))))
    w = W.partitionBy(*SERIES, "span", "ok").orderBy("us", "row_id")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({"prev_us": F.lag("us").over(w), "first_us": F.first("us").over(so_far), "turn": (~F.lag("rule").over(w).eqNullSafe(F.col("rule"))).cast("int")})
    return materialize(x.withColumn("run", F.sum("turn").over(so_far)).drop("turn"), "vital-marks")


def series(marks: DataFrame) -> DataFrame:
    return marks.where("ok").select("row_id", *SERIES, "us", "v", "age")


def _spans(marks: DataFrame) -> DataFrame:
    """Of each span of each source its first and last time, and prev_us, the last time of the span before."""
    x = marks.where("ok").groupBy(*SERIES, "span").agg(F.min("us").alias("us"), F.max("us").alias("last_us"))
    return x.withColumn("prev_us", F.lag("last_us").over(W.partitionBy(*SERIES).orderBy("span")))


def steps(marks: DataFrame) -> DataFrame:
    """sid, item, step_min: median of the positive gaps between successive readings, 5 minutes if there are none."""
    gap = (F.col("us") - F.col("prev_us")).alias("gap")
    gaps = marks.where("ok and prev_us is not null").select(*SERIES, gap).unionByName(_spans(marks).select(*SERIES, gap))
    return gaps.groupBy(*SERIES).agg((F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(STEP_DEFAULT * MIN_US)) / MIN_US).alias("step_min"))


def baselines(marks: DataFrame) -> DataFrame:
    """sid, item, baseline: median of the readings of the source's first ten minutes; null with fewer than three.

    They are among the readings of the first ten minutes of the spans, which are few.
    """
    early = marks.where(f"ok and us <= first_us + {BASELINE_MIN * MIN_US}").withColumn("first_us", F.min("us").over(W.partitionBy(*SERIES)))
    early = early.where(f"us <= first_us + {BASELINE_MIN * MIN_US}")
    return early.groupBy(*SERIES).agg(F.when(F.count(F.lit(1)) >= BASELINE_LEAST, F.median("v")).alias("baseline"))


def handoffs(marks: DataFrame) -> DataFrame:
    """sid, handoff_us: 15 minutes before the last row of the case that has a time, reading or not."""
    return marks.groupBy("sid").agg((F.max("us") - HANDOFF_MIN * MIN_US).alias("handoff_us"))


def episodes(marks: DataFrame) -> DataFrame:
    """One row per run of successive readings that violate one rule: the rule, from_us, to_us, n, ext, long_us.

    A gap in time does not end a run; a reading of the other tier does.
    """
    key = (*SERIES, "span")
    runs = marks.where("ok").groupBy(*key, "run").agg(
        F.first("rule").alias("rule"), F.first("age").alias("age"), F.min("us").alias("from_us"), F.max("us").alias("to_us"), F.count(F.lit(1)).alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax")
    )
    by_span = W.partitionBy(*key)
    runs = runs.withColumn("edge", (F.col("run") == F.min("run").over(by_span)) | (F.col("run") == F.max("run").over(by_span)))
    # the first and last run of each span: one with the last of the span before if both are of one rule
    w = W.partitionBy(*SERIES).orderBy("span", "run")
    goes_on = F.coalesce((F.lag("span").over(w) != F.col("span")) & (F.lag("rule").over(w) == F.col("rule")), F.lit(False))
    edges = runs.where("edge").withColumn("turn", (~goes_on).cast("int")).withColumn("chain", F.sum("turn").over(w.rowsBetween(W.unboundedPreceding, 0)))
    edges = edges.where("rule is not null").groupBy(*SERIES, "chain").agg(
        F.first("rule").alias("rule"), F.first("age").alias("age"), F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"), F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax")
    )
    cols = (*SERIES, "rule", "age", "from_us", "to_us", "n", "vmin", "vmax")
    x = runs.where("not edge and rule is not null").select(*cols).unionByName(edges.select(*cols)).join(steps(marks), list(SERIES))
    x = x.withColumns({"kind": _of_rule(0), "low": _of_rule(1), "tier2": _of_rule(2), "threshold": rule_threshold(F.col("rule"), F.col("age"))})
    return x.select(*SERIES, "kind", "low", "tier2", "rule", "threshold", "age", "from_us", "to_us", "n", F.when(F.col("low"), F.col("vmin")).otherwise(F.col("vmax")).alias("ext"), (F.col("to_us") - F.col("from_us") + F.col("step_min") * MIN_US).alias("long_us"))


def events(marks: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per (sid, item, kind, tier) with its episodes (runs, if they are there already) summed up, its baseline gate and
    whether it lasts to the hand-off. Minutes are rounded to one place, the depth under or over the threshold to two."""
    last = _spans(marks).groupBy(*SERIES).agg(F.max("last_us").alias("last_us"))
    e = (episodes(marks) if runs is None else runs).join(last, list(SERIES)).join(handoffs(marks), "sid")
    lasting = (F.col("to_us") >= F.col("handoff_us")) & ((F.col("n") >= 2) | ((F.col("from_us") <= F.col("last_us")) & (F.col("last_us") <= F.col("to_us"))))
    minutes = lambda c: fixed(c / MIN_US, 1).cast("double")
    ev = e.groupBy(*SERIES, "kind", "low", "tier2").agg(
        F.first("rule").alias("rule"), F.first("threshold").alias("threshold"), F.first("age").alias("age"), F.sum("n").alias("n"), minutes(F.sum("long_us")).alias("total_min"), minutes(F.max("long_us")).alias("longest_min"),
        F.max("n").alias("max_run"), F.count(F.lit(1)).alias("n_episodes"), F.when(F.first("low"), F.min("ext")).otherwise(F.max("ext")).alias("ext"), F.bool_or(lasting).alias("persists"),
    )
    ev = ev.join(baselines(marks), list(SERIES), "left")
    b, x = F.col("baseline"), F.col("ext")
    need = F.when(F.col("item").isin("SBP", "ISBP1", "MBP", "IMBP1"), b * 0.8).when(F.col("item") == "SpO2", b - 5.0).when(F.col("item") == "T1", b - 1.0)
    num = F.when(F.element_at(F.array(*[F.lit(r[4] is not None) for r in RULES]), F.col("rule")), F.concat(fixed(F.col("threshold")), F.lit(")")))
    return ev.withColumns({
        "delta": fixed(F.when(F.col("low"), F.col("threshold") - x).otherwise(x - F.col("threshold")), 2).cast("double"),
        "gate": F.coalesce(~F.col("low") | (x <= need), F.lit(True)),
        "label": F.concat(_of_rule(3), F.coalesce(num, F.lit(""))), "unit": _of_rule(5), "digits": _of_rule(6),
        "place": F.array_position(F.array(*map(F.lit, ITEMS)), F.col("item")) * 100 + F.col("rule"),
    })


def classify(ev: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Adds reasons (R1 to R4, sorted) and reportable. touched: sid, item, kind, tier2 of events with an intervention."""
    item, age, x = F.col("item"), F.col("age"), F.col("ext")
    least = F.create_map(*[F.lit(y) for k, v in T.MIN_DEVIATION.items() for y in (k, v)])
    if touched is None:
        ev = ev.withColumn("r1", F.lit(False))
    else:
        ev = ev.join(touched.select(*EVENT, F.lit(True).alias("r1")).distinct(), list(EVENT), "left")
    r4 = F.when(F.col("low"), x < T.hard_low(item, age)).otherwise(x > T.hard_high(item, age))
    r2 = ~F.col("tier2") & ((F.col("longest_min") >= LONG_MIN) | (F.col("max_run") >= RUN_LEAST)) & (F.col("delta") >= F.coalesce(least[item], F.lit(0.0)))
    hold = {"R1": F.coalesce("r1", F.lit(False)), "R2": F.col("gate") & r2, "R3": F.col("gate") & F.col("persists"), "R4": F.col("gate") & F.coalesce(r4, F.lit(False))}
    reasons = F.array_compact(F.array(*[F.when(c, name) for name, c in hold.items()]))
    return ev.withColumn("reasons", reasons).withColumn("reportable", F.size("reasons") > 0).drop("r1")


def first_reason(reasons: Column) -> Column:
    """Place of the most urgent reason: R1, R4, R3, R2; last if there is none."""
    out = F.lit(len(REASON_ORDER))
    for k in range(len(REASON_ORDER) - 1, -1, -1):
        out = F.when(F.array_contains(reasons, REASON_ORDER[k]), k).otherwise(out)
    return out


def duration(minutes: Column) -> Column:
    """Minutes in words: less than one, whole minutes, or hours from sixty."""
    return F.when(minutes < 1, "<1분").when(minutes < 60, F.concat(fixed(minutes), F.lit("분"))).otherwise(F.concat(fixed(minutes / 60, 1), F.lit("시간")))


def totals(marks: DataFrame, cases: DataFrame) -> DataFrame:
    """Blood loss and urine of each case: sid, ebl, ebl_percent, blood_text, blood_flag, uo, uo_rate, no_foley, urine_text, urine_flag.

    The greatest number of EBL and of UO, without plausible range; hours from the rows of UO, or of the case if those span
    none; "No Foley" anywhere switches the rate off. Over half (a tenth) of the blood volume is massive (significant) loss,
    under 0.5 mL/kg/h low urine. cases: sid, age, weight. Texts are null where there is no number.
    """
    of = lambda item, c: F.when(F.col("item") == item, F.col(c))
    t = marks.groupBy("sid").agg(
        F.max(of("EBL", "v")).alias("ebl"), F.max(of("UO", "v")).alias("uo"), F.bool_or("no_foley").alias("no_foley"), (F.max(of("UO", "us")) - F.min(of("UO", "us"))).alias("uo_us"), (F.max("us") - F.min("us")).alias("case_us")
    ).join(cases.select("sid", "age", "weight"), "sid", "left")
    hours = F.coalesce(F.nullif("uo_us", F.lit(0)), F.nullif("case_us", F.lit(0))) / (60 * MIN_US)
    t = t.withColumns({
        "ebl_percent": T.ebl_percent(F.col("ebl"), F.col("weight"), F.coalesce("age", F.lit(AGE_DEFAULT))), "uo": F.when(~F.col("no_foley"), F.col("uo")),
        "uo_rate": F.when((F.col("weight") > 0) & ~F.col("no_foley"), F.col("uo") / (F.col("weight") * hours)),
    })
    pct, rate = F.col("ebl_percent"), F.col("uo_rate")
    loss = F.when(pct > T.EBL_MASSIVE, f" — 대량 실혈(>{T.EBL_MASSIVE:.0f}% EBV)").when(pct > T.EBL_SIGNIFICANT, f" — 유의 실혈(>{T.EBL_SIGNIFICANT:.0f}% EBV)").otherwise("")
    blood = F.concat(F.lit("실혈 "), fixed(F.col("ebl")), F.lit(" mL"), F.coalesce(F.concat(F.lit(" (EBV의 "), fixed(pct), F.lit("%)"), loss), F.lit("")))
    low = F.when(rate < T.UO_LOW, f" — 핍뇨(<{T.UO_LOW} mL/kg/hr)").otherwise("")
    urine = F.concat(F.lit("소변량 "), fixed(F.col("uo")), F.lit(" mL"), F.coalesce(F.concat(F.lit(" ("), fixed(rate, 1), F.lit(" mL/kg/hr)"), low), F.lit("")))
    return t.select(
        "sid", "ebl", "ebl_percent", blood.alias("blood_text"), F.coalesce(pct > T.EBL_SIGNIFICANT, F.lit(False)).alias("blood_flag"), "uo", "uo_rate", "no_foley",
        F.when(F.col("no_foley"), "소변량: No Foley").otherwise(urine).alias("urine_text"), F.coalesce(rate < T.UO_LOW, F.lit(False)).alias("urine_flag"),
    )


def at_handoff(marks: DataFrame) -> DataFrame:
    """sid and the median of the last 15 minutes of each of six items."""
    x = marks.where("ok").join(handoffs(marks), "sid").where("us >= handoff_us")
    return x.groupBy("sid").agg(*[F.median(F.when(F.col("item") == i, F.col("v"))).alias(i.lower()) for i, *_ in AT_HANDOFF])


def handoff_lines(marks: DataFrame, given: DataFrame) -> DataFrame:
    """sid, line: the medians at hand-off and the interventions (sid, minute, category) from its minute of the day on."""
    from .timeline import render

    parts = F.array_compact(F.array(*[F.concat(F.lit(f"{label} "), fixed(F.col(i.lower()), d), F.lit(unit)) for i, label, unit, d in AT_HANDOFF]))
    x = at_handoff(marks).join(handoffs(marks), "sid").withColumn("parts", parts).where(F.size("parts") > 0)
    since = F.pmod(F.floor(F.col("handoff_us") / MIN_US), F.lit(1440))
    late = given.join(x.select("sid", since.alias("since")), "sid").where("minute >= since").groupBy("sid").agg(F.collect_set(F.struct("minute", "category")).alias("hits"))
    tail = F.coalesce(F.concat(F.lit(" — 종료 15분 내 처치: "), render(F.col("hits"))), F.lit(""))
    return x.join(late, "sid", "left").select("sid", F.concat(F.lit("- "), F.array_join("parts", " · "), tail).alias("line"))


def planned_lines(marks: DataFrame, planned: DataFrame) -> DataFrame:
    """sid, line of the planned cases (sid) with a temperature under 36: lowest, and the median at hand-off or else the last."""
    t = marks.where("ok and item = 'T1'").join(planned.select("sid").distinct(), "sid", "left_semi").join(handoffs(marks), "sid")
    g = t.groupBy("sid").agg(F.min("v").alias("lowest"), F.median(F.when(F.col("us") >= F.col("handoff_us"), F.col("v"))).alias("end"), F.max(F.struct("us", "row_id", "v"))["v"].alias("last"))
    line = F.concat(F.lit("- 계획된 저체온(체외순환): 최저 "), fixed(F.col("lowest"), 1), F.lit("°C, 종료 시 "), fixed(F.coalesce("end", "last"), 1), F.lit("°C"))
    return g.where(f"lowest < {T.TEMP_HYPO}").select("sid", line.alias("line"))


def without_planned(ev: DataFrame, planned: DataFrame) -> DataFrame:
    """Events without the hypothermia of cases (sid) in which it was planned."""
    p = planned.select("sid", F.lit("hypothermia").alias("kind")).distinct()
    return ev.join(p, ["sid", "kind"], "left_anti")


def _number(c: str) -> Column:
    return F.when(F.col("digits") == 1, fixed(F.col(c), 1)).otherwise(fixed(F.col(c)))


def event_line(hits: Column) -> Column:
    """An event in words; hits: its interventions as structs of minute and category, null for none."""
    from .timeline import render

    b, x, low = F.col("baseline"), F.col("ext"), F.col("low")
    spread = F.when(F.col("n_episodes") > 1, F.concat(F.lit(" / 총 "), duration(F.col("total_min")), F.lit("("), F.col("n_episodes").cast("string"), F.lit("회)"))).otherwise("")
    share = F.concat(F.lit(", baseline "), fixed(b), F.lit(" 대비 -"), fixed(F.coalesce(F.try_divide((b - x), b), F.lit(0.0)) * 100), F.lit("%"))
    apart = F.concat(F.lit(", baseline "), shortest(b), F.lit(" 대비 -"), fixed(b - x, 1), F.when(F.col("item") == "SpO2", "%p").otherwise("°C"))
    beside = F.when(low & F.col("item").isin("SBP", "ISBP1", "MBP", "IMBP1"), share).when(low & F.col("item").isin("SpO2", "T1"), apart)
    return F.concat(
        F.lit("- "), F.col("label"), F.lit(": 최장 "), duration(F.col("longest_min")), spread, F.when(low, ", 최저 ").otherwise(", 최고 "), _number("ext"), F.col("unit"), F.when(low, " (기준-").otherwise(" (기준+"), _number("delta"),
        F.coalesce(beside, F.lit("")), F.lit(")"), F.coalesce(F.concat(F.lit(" — 개입: "), render(hits)), F.lit("")),
    )


def minor_line() -> Column:
    return F.concat(F.col("label"), F.lit(" "), F.col("n").cast("string"), F.lit("회/"), duration(F.col("longest_min")), F.when(F.col("low"), " (최저 ").otherwise(" (최고 "), _number("ext"), F.col("unit"), F.lit(")"))


AUDIT = (
    "sid", "place", "item", "kind", "label", "threshold", "low", "unit", "digits", "tier2", "n", "total_min", "longest_min", "max_run", "ext", "delta", "baseline", "gate", "persists", "n_episodes", "reportable", "reasons", "hits",
)


def audit(marks: DataFrame, cases: DataFrame, given: DataFrame, planned: DataFrame, matches) -> DataFrame:
    """Every event of every case as a record, totals among them, each with reasons and interventions (hits).

    given: sid, minute, category of the interventions; planned: sid of cases with planned hypothermia, whose hypothermia is
    no event; matches: the function of timeline that brings episodes and interventions together.
    """
    runs = materialize(episodes(marks), "episodes")
    ev = without_planned(events(marks, runs), planned)
    hits = materialize(matches(runs, given), "interventions").groupBy(*EVENT).agg(F.collect_set(F.struct("minute", "category")).alias("hits"))
    ev = classify(ev, hits).join(hits, list(EVENT), "left").select(*AUDIT)
    t = totals(marks, cases)
    one = lambda kind, place, text, flag: F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"), F.col(text).alias("label"), F.col(flag).alias("flag"))
    t = t.select("sid", F.inline(F.array(one("blood_loss", 2001, "blood_text", "blood_flag"), one("oliguria", 2002, "urine_text", "urine_flag")))).where("label is not null")
    given_of = {
        "item": F.col("kind"), "low": F.lit(True), "unit": F.lit(""), "digits": F.lit(0), "tier2": ~F.col("flag"), "longest_min": F.lit(0.0), "max_run": F.lit(0), "gate": F.lit(True), "persists": F.col("flag"), "n_episodes": F.lit(0),
        "reportable": F.col("flag"), "reasons": F.when(F.col("flag"), F.array(F.lit("R3"))).otherwise(F.array().cast("array<string>")),
    }
    kinds = dict(ev.dtypes)
    cols = [F.col(c) if c in ("sid", "kind", "place", "label") else given_of.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in AUDIT]
    return ev.unionByName(t.select(*cols))


def summaries(marks: DataFrame, records: DataFrame, planned_line: DataFrame, handoff_line: DataFrame, cases: DataFrame) -> DataFrame:
    """sid, summary, n_reportable, n_minor, minor_text of each case; records: its audit.

    A line for the age, the reportable events in order of urgency (those of planned hypothermia as one line before them,
    totals after them) or a line that there are none, and the state at hand-off.
    """
    events_of = F.col("kind").isin("blood_loss", "oliguria")
    x = records.withColumn("line", F.when(events_of, F.concat(F.lit("- "), F.col("label"))).otherwise(event_line(F.col("hits"))))
    told = F.when(F.col("reportable"), F.struct(events_of.alias("total"), first_reason(F.col("reasons")).alias("urgency"), "place", "line"))
    small = F.when(~F.col("reportable") & F.col("n").isNotNull(), F.struct("place", minor_line().alias("line")))
    g = x.groupBy("sid").agg(F.sort_array(F.collect_list(told)).alias("told"), F.count_if("reportable").alias("n_reportable"), F.count_if(~F.col("reportable")).alias("n_minor"), F.sort_array(F.collect_list(small)).alias("small"))
    all_cases = marks.select("sid").distinct()
    x = all_cases.join(cases.select("sid", "age"), "sid", "left").join(g, "sid", "left").join(planned_line.withColumnRenamed("line", "planned"), "sid", "left").join(handoff_line, "sid", "left")
    labels = F.create_map(*[F.lit(y) for k, v in AGE_LABELS.items() for y in (k, v)])
    body = F.array_compact(F.concat(F.array("planned"), F.transform(F.coalesce("told", F.expr("array()")), lambda r: r["line"])))
    lines = F.concat(
        F.array(F.concat(F.lit("(연령군: "), labels[T.age_group(F.coalesce("age", F.lit(AGE_DEFAULT)))], F.lit(")")), F.lit(REPORTABLE)),
        F.when(F.size(body) > 0, body).otherwise(F.array(F.lit(NOTHING))), F.when(F.col("line").isNotNull(), F.array(F.lit(HANDOFF), F.col("line"))).otherwise(F.array().cast("array<string>")),
    )
    return x.select("sid", F.array_join(lines, "\n").alias("summary"), F.coalesce("n_reportable", F.lit(0)).alias("n_reportable"), F.coalesce("n_minor", F.lit(0)).alias("n_minor"), F.coalesce(F.array_join(F.transform("small", lambda r: r["line"]), " · "), F.lit("")).alias("minor_text"))
