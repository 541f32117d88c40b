"""Vital signs of vital_df: cleaned, summed up to events, classified and put into words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import thresholds as T
from ..functions.normalize import first_number
from ..operators import emr, timeline, vitals
from ..session import load, materialize
from .grid_queries import READINGS_SQL, _readings, _timed
from .query import Query


def cases(spark: SparkSession, d: str) -> DataFrame:
    """sid, age, weight of each case; a weight outside 0.4..150 kg is unknown."""
    w = first_number(F.col("weight_raw"))
    return load(spark, d, "emr_case").select("sid", F.col("age_years").alias("age"), F.when(w.between(0.4, 150), w).alias("weight"))


def marks(spark: SparkSession, d: str) -> DataFrame:
    """The rows of vital_df parsed, marked and written once for a query."""
    return vitals.mark(vitals.with_age(_timed(spark, d), cases(spark, d)))


def records(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "fewshot_bank").where("sid <> -1 and emr is not null").select("sid", F.col("emr").alias("record"))


def _case(bands, place=1, col="age"):
    quote = lambda x: f"'{x}'" if isinstance(x, str) else f"{float(x)!r}"
    whens = " ".join(f"WHEN {col} < {b[0]!r} THEN {quote(b[place])}" for b in bands if b[0] is not None)
    return f"(CASE WHEN {col} IS NULL THEN NULL {whens} ELSE {quote(bands[-1][place])} END)"


def _p95(young, old, table, col="age"):
    whens = " ".join(f"WHEN floor({col}) = {k} THEN {float(v)}" for k, v in table.items())
    return f"(CASE WHEN {col} < 1 THEN {young} WHEN {col} >= 13 THEN {old} {whens} END)"


SBP_SQL = f"(CASE WHEN age < {T.NEONATE!r} THEN 60.0 WHEN age < 1 THEN 70.0 WHEN age <= 10 THEN 70 + 2 * age WHEN age IS NOT NULL THEN 90.0 END)"
MAP_SQL = "(CASE WHEN age IS NOT NULL THEN least(1.5 * age + 40, 65.0) END)"
WEIGHT_SQL = "try_cast(nullif(regexp_extract(replace(weight_raw, ',', '.'), '[0-9]+(\\.[0-9]+)?', 0), '') AS DOUBLE)"
CASES_SQL = f"cases AS (SELECT sid, age_years AS age, CASE WHEN {WEIGHT_SQL} BETWEEN 0.4 AND 150 THEN {WEIGHT_SQL} END AS weight FROM emr_case)"
SERIES_SQL = f"""{READINGS_SQL}, {CASES_SQL},
series AS (SELECT r.*, coalesce(c.age, 5.0) AS age FROM readings r LEFT JOIN cases c USING (sid) WHERE NOT (coalesce(v < lo, false) OR coalesce(v > hi, false))),
step AS (SELECT sid, item, coalesce(median(gap) FILTER (WHERE gap > 0), 300000000.0) AS step_us
         FROM (SELECT sid, item, us - lag(us) OVER (PARTITION BY sid, item ORDER BY us, row_id) AS gap FROM series) GROUP BY sid, item),
base AS (SELECT sid, item, CASE WHEN count(*) FILTER (WHERE us <= f + 600000000) >= 3 THEN median(v) FILTER (WHERE us <= f + 600000000) END AS baseline
         FROM (SELECT *, min(us) OVER (PARTITION BY sid, item) AS f FROM series) GROUP BY sid, item),
hand AS (SELECT sid, max(us) - 900000000 AS handoff_us FROM raw_rows GROUP BY sid)"""


def _rule_sql(where, kind, low, tier2, threshold, hit):
    return f"SELECT sid, item, age, us, row_id, v, '{kind}' AS kind, {low} AS low, {tier2} AS tier2, CAST({threshold} AS DOUBLE) AS threshold, coalesce({hit}, false) AS hit FROM lim WHERE {where}"


EPISODES_SQL = f"""{SERIES_SQL},
lim AS (SELECT *, {_case(T.HR_NORMAL)} AS hlo, {_case(T.HR_NORMAL, 2)} AS hhi, {_case(T.HR_CRITICAL)} AS slow, {_case(T.HR_CRITICAL, 2)} AS fast,
          {SBP_SQL} AS sbp, {MAP_SQL} AS mapl, {_p95(100.0, 130.0, T.SBP_P95)} AS p95, {_p95(65.0, 80.0, T.DBP_P95)} AS d95 FROM series),
ruled AS ({" UNION ALL ".join([
    _rule_sql("item = 'HR'", "bradycardia", "true", "false", "slow", "v < slow"), _rule_sql("item = 'HR'", "tachycardia", "false", "false", "fast", "v > fast"),
    _rule_sql("item = 'HR'", "bradycardia", "true", "true", "hlo", "v < hlo AND v >= slow"), _rule_sql("item = 'HR'", "tachycardia", "false", "true", "hhi", "v > hhi AND v <= fast"),
    _rule_sql("item IN ('SBP', 'ISBP1')", "hypotension", "true", "false", "sbp", "v < sbp"), _rule_sql("item IN ('SBP', 'ISBP1')", "hypertension", "false", "true", "p95", "v > p95"),
    _rule_sql("item IN ('MBP', 'IMBP1')", "hypotension", "true", "false", "mapl", "v < mapl"), _rule_sql("item IN ('DBP', 'IDBP1')", "hypertension", "false", "true", "d95", "v > d95"),
    _rule_sql("item = 'SpO2'", "desaturation", "true", "false", "90.0", "v < 90"), _rule_sql("item = 'SpO2'", "desaturation", "true", "true", "94.0", "v < 94 AND v >= 90"),
    _rule_sql("item = 'T1'", "hypothermia", "true", "false", "35.5", "v < 35.5"), _rule_sql("item = 'T1'", "hypothermia", "true", "true", "36.0", "v < 36 AND v >= 35.5"),
    _rule_sql("item = 'T1'", "fever", "false", "false", "38.0", "v > 38"), _rule_sql("item = 'T1'", "fever", "false", "true", "37.5", "v > 37.5 AND v <= 38"),
    _rule_sql("item = 'QTc'", "qtc", "false", "false", "480.0", "v > 480")])}),
island AS (SELECT *, row_number() OVER (PARTITION BY sid, item, kind, tier2 ORDER BY us, row_id) - row_number() OVER (PARTITION BY sid, item, kind, tier2, hit ORDER BY us, row_id) AS grp FROM ruled),
episodes AS (SELECT sid, item, kind, low, tier2, any_value(threshold) AS threshold, any_value(age) AS age, min(us) AS from_us, max(us) AS to_us, count(*) AS n,
               CASE WHEN low THEN min(v) ELSE max(v) END AS ext, max(us) - min(us) + any_value(step_us) AS long_us
             FROM island JOIN step USING (sid, item) WHERE hit GROUP BY sid, item, kind, low, tier2, grp)"""

EVENTS_SQL = f"""{EPISODES_SQL},
last AS (SELECT sid, item, max(us) AS last_us FROM series GROUP BY sid, item),
ev0 AS (SELECT e.sid, e.item, kind, low, tier2, any_value(threshold) AS threshold, any_value(age) AS age, CAST(sum(n) AS BIGINT) AS n, CAST(printf('%.1f', sum(long_us) / 60000000) AS DOUBLE) AS total_min, CAST(printf('%.1f', max(long_us) / 60000000) AS DOUBLE) AS longest_min,
          max(n) AS max_run, count(*) AS n_episodes, CASE WHEN low THEN min(ext) ELSE max(ext) END AS ext,
          bool_or(to_us >= handoff_us AND (n >= 2 OR last_us BETWEEN from_us AND to_us)) AS persists
        FROM episodes e JOIN last USING (sid, item) JOIN hand USING (sid) GROUP BY e.sid, e.item, kind, low, tier2),
ev AS (SELECT ev0.*, baseline, CAST(printf('%.2f', CASE WHEN low THEN threshold - ext ELSE ext - threshold END) AS DOUBLE) AS delta,
         coalesce(NOT low OR ext <= CASE WHEN item IN ('SBP', 'ISBP1', 'MBP', 'IMBP1') THEN baseline * 0.8 WHEN item = 'SpO2' THEN baseline - 5.0 WHEN item = 'T1' THEN baseline - 1.0 END, true) AS gate
       FROM ev0 LEFT JOIN base USING (sid, item))"""

HARD_LOW_SQL = f"CASE WHEN item = 'HR' THEN 50.0 WHEN item IN ('SBP', 'ISBP1') THEN 0.7 * {SBP_SQL} WHEN item IN ('MBP', 'IMBP1') THEN 0.7 * {MAP_SQL} WHEN item = 'SpO2' THEN 80.0 WHEN item = 'T1' THEN 34.0 END"
HARD_HIGH_SQL = f"CASE WHEN item = 'HR' THEN {_case(T.HR_CRITICAL, 2)} + 30 WHEN item = 'T1' THEN 39.0 WHEN item = 'QTc' THEN 500.0 END"
_LEAST_SQL = "CASE " + " ".join(f"WHEN item = '{k}' THEN {v}" for k, v in T.MIN_DEVIATION.items()) + " ELSE 0.0 END"

_WORDS_SQL = ", ".join(f"('{c}', '{w}')" for c, ws in timeline.KEYWORDS.items() for w in ws)
_ADMITTED_SQL = ", ".join(f"('{k}', '{c}')" for k, cs in timeline.ADMITTED.items() for c in cs)
TIMELINE_SQL = """records AS (SELECT sid, emr AS record FROM fewshot_bank WHERE sid <> -1 AND emr IS NOT NULL),
found AS (SELECT sid, unnest(regexp_extract_all(record, '[▶▷►]?\\s*(\\d{1,2}):(\\d{2})\\s*([^\\n▶▷►]*)', 1)) AS h, unnest(regexp_extract_all(record, '[▶▷►]?\\s*(\\d{1,2}):(\\d{2})\\s*([^\\n▶▷►]*)', 2)) AS m,
            unnest(regexp_extract_all(record, '[▶▷►]?\\s*(\\d{1,2}):(\\d{2})\\s*([^\\n▶▷►]*)', 3)) AS e FROM records),
entries AS (SELECT sid, CAST(h AS INT) * 60 + CAST(m AS INT) AS minute, trim(e, ' ') AS entry FROM found WHERE CAST(h AS INT) <= 23 AND CAST(m AS INT) <= 59)"""
GIVEN_SQL = f"""{TIMELINE_SQL},
words(category, word) AS (VALUES {_WORDS_SQL}),
given AS (SELECT sid, minute, category, substr(entry, 1, 60) AS snippet FROM entries, (SELECT category, list(word) AS ws FROM words GROUP BY category) WHERE len(list_filter(ws, lambda w: contains(lower(entry), w))) > 0)"""
MATCH_SQL = f"""{EVENTS_SQL}, {GIVEN_SQL},
admitted(kind, category) AS (VALUES {_ADMITTED_SQL}),
ends AS (SELECT sid, item, kind, tier2, (from_us // 60000000) % 1440 AS at FROM episodes UNION SELECT sid, item, kind, tier2, (to_us // 60000000) % 1440 FROM episodes),
matched AS (SELECT DISTINCT e.sid, e.item, e.kind, e.tier2, g.category, g.minute FROM ends e JOIN admitted a USING (kind) JOIN given g ON g.sid = e.sid AND g.category = a.category
            AND least(abs(e.at - g.minute), 1440 - abs(e.at - g.minute)) <= 10)"""
CLASSIFIED_SQL = f"""{MATCH_SQL},
touched AS (SELECT DISTINCT sid, item, kind, tier2, true AS r1 FROM matched),
flags AS (SELECT ev.*, coalesce(r1, false) AS r1,
            gate AND coalesce(CASE WHEN low THEN ext < {HARD_LOW_SQL} ELSE ext > {HARD_HIGH_SQL} END, false) AS r4, gate AND persists AS r3,
            gate AND NOT tier2 AND (longest_min >= 10 OR max_run >= 2) AND delta >= {_LEAST_SQL} AS r2
          FROM ev LEFT JOIN touched USING (sid, item, kind, tier2)),
classified AS (SELECT *, list_filter([CASE WHEN r1 THEN 'R1' END, CASE WHEN r2 THEN 'R2' END, CASE WHEN r3 THEN 'R3' END, CASE WHEN r4 THEN 'R4' END], lambda x: x IS NOT NULL) AS reasons,
                 CASE WHEN r1 THEN 0 WHEN r4 THEN 1 WHEN r3 THEN 2 WHEN r2 THEN 3 ELSE 4 END AS urgency FROM flags)"""

_R = lambda c: F.round(c, 6).alias(c)
_EVENT = ("sid", "item", "kind", "low", "tier2", "threshold", "n", "max_run", "n_episodes", "ext", "persists", "baseline", "gate", "total_min", "longest_min", "delta")
_EVENT_SQL = ", ".join(_EVENT)


def _given(spark, d):
    return timeline.interventions(timeline.parse(records(spark, d))).select("sid", "minute", "category").distinct()


def _planned(spark, d):
    return records(spark, d).where(T.planned_hypothermia(F.col("record"))).select("sid").distinct()


def vital_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the interventions of the record, their reasons and whether they are to be reported."""
    m = marks(spark, d)
    runs = materialize(vitals.episodes(m), "episodes")
    ev = vitals.classify(vitals.events(m, runs), timeline.matches(runs, _given(spark, d)))
    return ev.select(*_EVENT, F.array_join("reasons", ",").alias("reasons"), "reportable", vitals.first_reason(F.col("reasons")).alias("urgency"))


def _audit(spark, d, m):
    return vitals.audit(m, cases(spark, d), _given(spark, d), _planned(spark, d), timeline.matches)


def vital_audit(spark: SparkSession, d: str) -> DataFrame:
    """Each case's record of its events, nested, as it is kept for audits."""
    x = _audit(spark, d, marks(spark, d))
    rec = F.struct(*[c for c in vitals.AUDIT if c not in ("sid", "hits")], F.transform("hits", lambda h: F.concat(h["category"], F.lit("@"), timeline.clock(h["minute"]))).alias("interventions"))
    return x.groupBy("sid").agg(F.sort_array(F.collect_list(F.when(F.col("reportable"), rec))).alias("reportable"), F.sort_array(F.collect_list(F.when(~F.col("reportable"), rec))).alias("minor"))


_FLAT = ("item", "kind", "label", "tier2", "n", "total_min", "longest_min", "ext", "delta")


def audit_flatten(spark: SparkSession, d: str) -> DataFrame:
    """The events of the nested records, one row each, with the list that they come from."""
    x = vital_audit(spark, d)
    part = lambda c, told: x.select("sid", F.explode(c).alias("e")).select("sid", F.lit(told).alias("reportable"), *[F.col(f"e.{k}") for k in _FLAT], F.array_join("e.reasons", ",").alias("reasons"), F.coalesce(F.array_join(F.array_sort("e.interventions"), ","), F.lit("")).alias("interventions"))
    return part("reportable", True).unionByName(part("minor", False))


def vital_summary(spark: SparkSession, d: str) -> DataFrame:
    """One text per case: age line, reportable events, state at hand-off; and how many events are minor."""
    m = marks(spark, d)
    given, planned = _given(spark, d), _planned(spark, d)
    return vitals.summaries(m, materialize(_audit(spark, d, m), "audit"), vitals.planned_lines(m, planned), vitals.handoff_lines(m, given), cases(spark, d))


def rule_counters(spark: SparkSession, d: str) -> DataFrame:
    """name, n: events, those reported and minor, each reason, totals that are flagged, and cases with planned hypothermia."""
    x = _audit(spark, d, marks(spark, d))
    event = F.col("n").isNotNull()
    names = F.array_compact(F.concat(
        F.array(F.when(event, "events_total"), F.when(event & F.col("reportable"), "events_reportable"), F.when(event & ~F.col("reportable"), "events_minor"), F.when(~event & F.col("reportable"), F.concat(F.lit("flagged_"), F.col("kind")))),
        F.when(event, F.transform("reasons", lambda r: F.concat(F.lit("reason_"), r))).otherwise(F.array().cast("array<string>")),
    ))
    return x.select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).unionByName(_planned(spark, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("cases_planned").alias("name"), "n"))


def summary_markers(spark: SparkSession, d: str) -> DataFrame:
    """How many summaries hold each of the marks that a rebuilt map is checked by."""
    t = vital_summary(spark, d)
    has = lambda word: F.count_if(F.contains("summary", F.lit(word)))
    return t.agg(F.count(F.lit(1)).alias("cases"), has(vitals.HANDOFF).alias("at_handoff"), has(vitals.NOTHING).alias("nothing"), has("개입:").alias("linked"), has("계획된 저체온").alias("planned"), F.count_if(~F.startswith("summary", F.lit("(연령군"))).alias("without_age"))


# the same in SQL, rule by rule
_RULED = [f"('{i}', {n})" for n, items in enumerate((("HR",), ("HR",), ("HR",), ("HR",), ("SBP", "ISBP1"), ("SBP", "ISBP1"), ("MBP", "IMBP1"), ("DBP", "IDBP1"), ("SpO2",), ("SpO2",), ("QTc",), ("T1",), ("T1",), ("T1",), ("T1",)), 1) for i in items]
_RULES_SQL = ", ".join(f"({n}, '{k}', {str(t2).lower()}, '{a}', {'NULL' if z is None else repr(z)}, '{u}', {dg})" for n, (k, _, t2, a, z, u, dg) in enumerate(vitals.RULES, 1))
_DUR_SQL = lambda m: f"CASE WHEN {m} < 1 THEN '<1분' WHEN {m} < 60 THEN printf('%.0f', {m}) || '분' ELSE printf('%.1f', {m} / 60) || '시간' END"
_NUM_SQL = lambda c: f"CASE WHEN digits = 1 THEN printf('%.1f', {c}) ELSE printf('%.0f', {c}) END"
_CLOCK_SQL = "printf('%02d:%02d', CAST(minute // 60 AS INT), CAST(minute % 60 AS INT))"
_LABELS_SQL = ", ".join(f"('{c}', '{w}', {k})" for k, (c, w) in enumerate(timeline.LABELS.items()))
_PLANNED_SQL = "SELECT DISTINCT sid FROM fewshot_bank WHERE sid <> -1 AND emr IS NOT NULL AND (" + " OR ".join(f"contains(lower(emr), '{w}')" for w in T.PLANNED_HYPOTHERMIA) + ")"
TOTALS_SQL = f"""
tot AS (SELECT n.sid, max(v) FILTER (WHERE k = 'EBL') AS ebl, max(v) FILTER (WHERE k = 'UO') AS uo1, coalesce(bool_or(regexp_matches(upper(value_raw), 'NF|NO.?FOLEY')) FILTER (WHERE k = 'UO'), false) AS no_foley,
          max(us) FILTER (WHERE k = 'UO') - min(us) FILTER (WHERE k = 'UO') AS us1, max(us) - min(us) AS us2 FROM numbers n GROUP BY 1),
tot2 AS (SELECT tot.*, CASE WHEN NOT no_foley THEN uo1 END AS uo, CASE WHEN weight > 0 THEN ebl / (weight * {_case(T.EBV, 1, "coalesce(age, 5.0)")}) * 100 END AS ebl_percent,
           CASE WHEN weight > 0 AND NOT no_foley THEN uo1 / (weight * (coalesce(nullif(us1, 0), nullif(us2, 0)) / 3600000000)) END AS uo_rate FROM tot LEFT JOIN cases USING (sid)),
totals AS (SELECT sid, ebl, ebl_percent, '실혈 ' || printf('%.0f', ebl) || ' mL' || coalesce(' (EBV의 ' || printf('%.0f', ebl_percent) || '%)' || CASE WHEN ebl_percent > 50 THEN ' — 대량 실혈(>50% EBV)' WHEN ebl_percent > 10 THEN ' — 유의 실혈(>10% EBV)' ELSE '' END, '') AS blood_text,
             coalesce(ebl_percent > 10, false) AS blood_flag, uo, uo_rate, no_foley,
             CASE WHEN no_foley THEN '소변량: No Foley' ELSE '소변량 ' || printf('%.0f', uo) || ' mL' || coalesce(' (' || printf('%.1f', uo_rate) || ' mL/kg/hr)' || CASE WHEN uo_rate < 0.5 THEN ' — 핍뇨(<0.5 mL/kg/hr)' ELSE '' END, '') END AS urine_text,
             coalesce(uo_rate < 0.5, false) AS urine_flag FROM tot2)"""
AUDIT_SQL = f"""{CLASSIFIED_SQL}, {TOTALS_SQL},
planned AS ({_PLANNED_SQL}),
ruledim AS (SELECT * FROM (VALUES {_RULES_SQL}) r(rule, kind, tier2, a, z, unit, digits) JOIN (VALUES {", ".join(_RULED)}) i(item, rule) USING (rule)),
labels(category, label, k) AS (VALUES {_LABELS_SQL}),
hits AS (SELECT sid, item, kind, tier2, string_agg(l.label || ' ' || {_CLOCK_SQL}, ', ' ORDER BY minute, k) AS told, string_agg(category || '@' || {_CLOCK_SQL}, ',' ORDER BY category || '@' || {_CLOCK_SQL}) AS hit FROM matched JOIN labels l USING (category) GROUP BY ALL),
aud AS (SELECT c.*, list_position([{", ".join(repr(i) for i in vitals.ITEMS)}], c.item) * 100 + rule AS place, a || coalesce(printf('%.0f', threshold) || z, '') AS label, unit, digits, told, coalesce(hit, '') AS hit
        FROM classified c JOIN ruledim USING (item, kind, tier2) LEFT JOIN hits USING (sid, item, kind, tier2) WHERE NOT (kind = 'hypothermia' AND c.sid IN (SELECT sid FROM planned)))"""
_TOTAL_ROWS = lambda kind, text, flag: f"SELECT sid, {flag} AS reportable, '{kind}' AS item, '{kind}' AS kind, {text} AS label, NOT {flag} AS tier2, NULL AS n, NULL AS total_min, 0.0 AS longest_min, NULL AS ext, NULL AS delta, CASE WHEN {flag} THEN 'R3' ELSE '' END AS reasons, '' AS interventions FROM totals WHERE {text} IS NOT NULL"
FLAT_SQL = f"""WITH {AUDIT_SQL}
SELECT sid, len(reasons) > 0 AS reportable, item, kind, label, tier2, n, total_min, longest_min, ext, delta, array_to_string(reasons, ',') AS reasons, hit AS interventions FROM aud
UNION ALL {_TOTAL_ROWS("blood_loss", "blood_text", "blood_flag")} UNION ALL {_TOTAL_ROWS("oliguria", "urine_text", "urine_flag")}"""
_SPEC = vitals.AT_HANDOFF
LINES_SQL = f"""
med AS (SELECT sid, {", ".join(f"median(v) FILTER (WHERE item = '{i}') AS {i.lower()}" for i, *_ in _SPEC)} FROM series JOIN hand USING (sid) WHERE us >= handoff_us GROUP BY sid),
late AS (SELECT sid, string_agg(l.label || ' ' || {_CLOCK_SQL}, ', ' ORDER BY minute, k) AS told FROM (SELECT DISTINCT sid, minute, category FROM given) JOIN hand USING (sid) JOIN labels l USING (category) WHERE minute >= (handoff_us // 60000000) % 1440 GROUP BY sid),
handoff_line AS (SELECT sid, '- ' || concat_ws(' · ', {", ".join(f"'{label} ' || printf('%.{d}f', {i.lower()}) || '{u}'" for i, label, u, d in _SPEC)}) || coalesce(' — 종료 15분 내 처치: ' || told, '') AS line FROM med LEFT JOIN late USING (sid) WHERE coalesce({", ".join(i.lower() for i, *_ in _SPEC)}) IS NOT NULL),
planned_line AS (SELECT sid, '- 계획된 저체온(체외순환): 최저 ' || printf('%.1f', min(v)) || '°C, 종료 시 ' || printf('%.1f', coalesce(median(v) FILTER (WHERE us >= handoff_us), arg_max(v, (us, row_id)))) || '°C' AS line
                 FROM series JOIN hand USING (sid) WHERE item = 'T1' AND sid IN (SELECT sid FROM planned) GROUP BY sid HAVING min(v) < 36)"""
SUMMARY_SQL = f"""{AUDIT_SQL}, {LINES_SQL},
base_txt AS (SELECT aud.*, CASE WHEN low AND item IN ('SBP', 'ISBP1', 'MBP', 'IMBP1') THEN ', baseline ' || printf('%.0f', baseline) || ' 대비 -' || printf('%.0f', coalesce((baseline - ext) / nullif(baseline, 0), 0.0) * 100) || '%'
               WHEN low AND item IN ('SpO2', 'T1') THEN ', baseline ' || regexp_replace(CAST(baseline AS VARCHAR), '[.]0$', '') || ' 대비 -' || printf('%.1f', baseline - ext) || CASE WHEN item = 'SpO2' THEN '%p' ELSE '°C' END END AS b FROM aud),
told AS (SELECT sid, false AS total, urgency, place, '- ' || label || ': 최장 ' || {_DUR_SQL("longest_min")} || CASE WHEN n_episodes > 1 THEN ' / 총 ' || {_DUR_SQL("total_min")} || '(' || n_episodes || '회)' ELSE '' END
             || CASE WHEN low THEN ', 최저 ' ELSE ', 최고 ' END || {_NUM_SQL("ext")} || unit || CASE WHEN low THEN ' (기준-' ELSE ' (기준+' END || {_NUM_SQL("delta")} || coalesce(b, '') || ')' || coalesce(' — 개입: ' || told, '') AS line FROM base_txt WHERE len(reasons) > 0
         UNION ALL SELECT sid, true, 2, 2001, '- ' || blood_text FROM totals WHERE blood_flag AND blood_text IS NOT NULL UNION ALL SELECT sid, true, 2, 2002, '- ' || urine_text FROM totals WHERE urine_flag AND urine_text IS NOT NULL),
body AS (SELECT sid, string_agg(line, chr(10) ORDER BY total, urgency, place) AS body, count(*) AS n_reportable FROM told GROUP BY sid),
small AS (SELECT sid, string_agg(label || ' ' || n || '회/' || {_DUR_SQL("longest_min")} || CASE WHEN low THEN ' (최저 ' ELSE ' (최고 ' END || {_NUM_SQL("ext")} || unit || ')', ' · ' ORDER BY place) AS minor_text, count(*) AS c FROM aud WHERE len(reasons) = 0 GROUP BY sid),
summary AS (SELECT s.sid, '(연령군: ' || CASE {_case(T.AGE_GROUPS, 1, "coalesce(age, 5.0)")} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vitals.AGE_LABELS.items())} END || ')' || chr(10) || '{vitals.REPORTABLE}' || chr(10)
              || coalesce(nullif(concat_ws(chr(10), p.line, body), ''), '{vitals.NOTHING}') || coalesce(chr(10) || '{vitals.HANDOFF}' || chr(10) || h.line, '') AS summary, coalesce(n_reportable, 0) AS n_reportable,
              coalesce(c, 0) + (blood_text IS NOT NULL AND NOT blood_flag)::INT + (urine_text IS NOT NULL AND NOT urine_flag)::INT AS n_minor, coalesce(minor_text, '') AS minor_text
            FROM (SELECT DISTINCT sid FROM raw_rows) s LEFT JOIN cases USING (sid) LEFT JOIN body USING (sid) LEFT JOIN small USING (sid) LEFT JOIN totals USING (sid) LEFT JOIN planned_line p USING (sid) LEFT JOIN handoff_line h USING (sid))"""


def _ages(spark, d):
    return load(spark, d, "emr_case").where("age_years is not null").select(F.col("age_years").alias("age")).distinct()


_AGES_SQL = "(SELECT DISTINCT age_years AS a FROM emr_case WHERE age_years IS NOT NULL) t"


def threshold_matrix(spark, d):
    a = F.col("age")
    return _ages(spark, d).select("age", T.age_group(a).alias("age_group"), T.band(a, T.HR_NORMAL, 1).alias("hr_lo"), T.band(a, T.HR_NORMAL, 2).alias("hr_hi"), T.band(a, T.HR_CRITICAL, 1).alias("hr_slow"), T.band(a, T.HR_CRITICAL, 2).alias("hr_fast"), T.sbp_hypotension(a).alias("sbp_low"), T.sbp_p95(a).alias("sbp_high"), T.dbp_p95(a).alias("dbp_high"), T.map_hypotension(a).alias("map_low"), F.round(T.map_relative(T.map_hypotension(a)), 6).alias("map_drop"), T.qtc_upper(a).alias("qtc"), T.band(a, T.EBV).alias("ebv"))


def hard_lines(spark, d):
    i = spark.createDataFrame([(x,) for x in ("HR", "SBP", "MBP", "SpO2", "T1", "QTc", "Ppeak")], "item string")
    return _ages(spark, d).join(F.broadcast(i)).select("age", "item", F.round(T.hard_low(F.col("item"), F.col("age")), 6).alias("low"), T.hard_high(F.col("item"), F.col("age")).alias("high"))


QUERIES = {
    "vital_events": Query(
        vital_events,
        f"WITH {CLASSIFIED_SQL} SELECT {_EVENT_SQL}, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS reportable, urgency FROM classified",
    ),
    "vital_clean": Query(
        lambda s, d: vitals.series(marks(s, d)).select("row_id", "sid", "item", "us", "v", "age"),
        f"WITH {SERIES_SQL} SELECT row_id, sid, item, us, v, age FROM series",
    ),
    "vital_item_value_parse": Query(
        lambda s, d: _readings(s, d).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")),
        f"WITH {READINGS_SQL} SELECT item, count(*) AS n, min(v) AS lo, max(v) AS hi FROM readings GROUP BY item",
    ),
    "vital_drop_counts": Query(
        lambda s, d: vitals.drop_counts(_readings(s, d)),
        f"WITH {READINGS_SQL} SELECT item, count(*) AS n, count(*) FILTER (WHERE v < lo) AS below, count(*) FILTER (WHERE v > hi) AS above FROM readings GROUP BY item",
    ),
    "sampling_step": Query(
        lambda s, d: vitals.steps(marks(s, d)).select("sid", "item", _R("step_min")),
        f"WITH {SERIES_SQL} SELECT sid, item, round(step_us / 60000000, 6) AS step_min FROM step",
    ),
    "baseline": Query(lambda s, d: vitals.baselines(marks(s, d)), f"WITH {SERIES_SQL} SELECT sid, item, baseline FROM base"),
    "handoff_window": Query(lambda s, d: vitals.handoffs(marks(s, d)), f"WITH {SERIES_SQL} SELECT sid, handoff_us FROM hand"),
    "episodes": Query(
        lambda s, d: vitals.episodes(marks(s, d)).select("sid", "item", "kind", "low", "tier2", "threshold", "from_us", "to_us", "n", "ext", F.round(F.col("long_us") / 60000000, 6).alias("minutes")),
        f"WITH {EPISODES_SQL} SELECT sid, item, kind, low, tier2, threshold, from_us, to_us, n, ext, round(long_us / 60000000, 6) AS minutes FROM episodes",
    ),
    "event_aggregate": Query(lambda s, d: vitals.events(marks(s, d)).select(*_EVENT), f"WITH {EVENTS_SQL} SELECT {_EVENT_SQL} FROM ev"),
    "persistence_census": Query(
        lambda s, d: vitals.events(marks(s, d)).groupBy("item", "kind", "tier2").agg(F.count_if("persists").alias("lasting"), F.count_if("gate").alias("gated"), F.count(F.lit(1)).alias("n")),
        f"WITH {EVENTS_SQL} SELECT item, kind, tier2, count(*) FILTER (WHERE persists) AS lasting, count(*) FILTER (WHERE gate) AS gated, count(*) AS n "
        "FROM ev GROUP BY ALL",
    ),
    "totals_and_rate": Query(
        lambda s, d: vitals.totals(marks(s, d), cases(s, d)).select("sid", "ebl", _R("ebl_percent"), "blood_text", "blood_flag", "uo", _R("uo_rate"), "no_foley", "urine_text", "urine_flag"),
        f"WITH {SERIES_SQL}, {TOTALS_SQL} SELECT sid, ebl, round(ebl_percent, 6) AS ebl_percent, blood_text, blood_flag, uo, round(uo_rate, 6) AS uo_rate, "
        "no_foley, urine_text, urine_flag FROM totals",
    ),
    "no_foley": Query(
        lambda s, d: vitals.totals(marks(s, d), cases(s, d)).select("sid", "no_foley"),
        f"WITH {SERIES_SQL}, {TOTALS_SQL} SELECT sid, no_foley FROM totals",
    ),
    "blood_loss_events": Query(
        lambda s, d: vitals.totals(marks(s, d), cases(s, d)).where("blood_flag or urine_flag").select("sid", "blood_text", "blood_flag", "urine_text", "urine_flag"),
        f"WITH {SERIES_SQL}, {TOTALS_SQL} SELECT sid, blood_text, blood_flag, urine_text, urine_flag FROM totals WHERE blood_flag OR urine_flag",
    ),
    "planned_hypothermia_line": Query(
        lambda s, d: vitals.planned_lines(marks(s, d), _planned(s, d)),
        f"WITH {AUDIT_SQL}, {LINES_SQL} SELECT sid, line FROM planned_line",
    ),
    "handoff_line": Query(lambda s, d: vitals.handoff_lines(marks(s, d), _given(s, d)), f"WITH {AUDIT_SQL}, {LINES_SQL} SELECT sid, line FROM handoff_line"),
    "audit_flatten": Query(audit_flatten, FLAT_SQL),
    "vital_audit": Query(
        lambda s, d: vital_audit(s, d).select("sid", F.size("reportable").alias("n_reportable"), F.size("minor").alias("n_minor"), F.to_json("reportable").isNotNull().alias("kept")),
        f"WITH {AUDIT_SQL}, f AS (SELECT sid, len(reasons) > 0 AS r FROM aud UNION ALL SELECT sid, blood_flag FROM totals WHERE blood_text IS NOT NULL "
        "UNION ALL SELECT sid, urine_flag FROM totals WHERE urine_text IS NOT NULL) SELECT sid, CAST(count(*) FILTER (WHERE r) AS INT) AS n_reportable, "
        "CAST(count(*) FILTER (WHERE NOT r) AS INT) AS n_minor, true AS kept FROM f GROUP BY sid",
    ),
    "rule_counters": Query(
        rule_counters,
        f"""WITH {AUDIT_SQL}, c AS (SELECT unnest(list_concat(['events_total', CASE WHEN len(reasons) > 0 THEN 'events_reportable' ELSE 'events_minor' END], list_transform(reasons, lambda r: 'reason_' || r))) AS name FROM aud
UNION ALL SELECT 'flagged_blood_loss' FROM totals WHERE blood_flag AND blood_text IS NOT NULL UNION ALL SELECT 'flagged_oliguria' FROM totals WHERE urine_flag AND urine_text IS NOT NULL)
SELECT name, count(*) AS n FROM c GROUP BY name UNION ALL SELECT 'cases_planned', count(*) FROM planned""",
    ),
    "summary_markers": Query(
        summary_markers,
        f"WITH {SUMMARY_SQL} SELECT count(*) AS cases, count(*) FILTER (WHERE contains(summary, '{vitals.HANDOFF}')) AS at_handoff, "
        f"count(*) FILTER (WHERE contains(summary, '{vitals.NOTHING}')) AS nothing, count(*) FILTER (WHERE contains(summary, '개입:')) AS linked, "
        "count(*) FILTER (WHERE contains(summary, '계획된 저체온')) AS planned, count(*) FILTER (WHERE NOT starts_with(summary, '(연령군')) AS without_age "
        "FROM summary",
    ),
    "render_interventions": Query(
        lambda s, d: _given(s, d).groupBy("sid").agg(timeline.render(F.collect_set(F.struct("minute", "category"))).alias("told")),
        f"WITH {GIVEN_SQL}, labels(category, label, k) AS (VALUES {_LABELS_SQL}) SELECT sid, string_agg(l.label || ' ' || {_CLOCK_SQL}, ', ' ORDER BY minute, "
        "k) AS told FROM (SELECT DISTINCT sid, minute, category FROM given) JOIN labels l USING (category) GROUP BY sid",
    ),
    "duration_format": Query(
        lambda s, d: vitals.episodes(marks(s, d)).select("sid", "item", "kind", "tier2", "from_us", vitals.duration(F.col("long_us") / 60000000).alias("told")),
        f"WITH {EPISODES_SQL} SELECT sid, item, kind, tier2, from_us, {_DUR_SQL('(long_us / 60000000)')} AS told FROM episodes",
    ),
    "handoff_snapshot": Query(
        lambda s, d: vitals.at_handoff(marks(s, d)),
        f"WITH {SERIES_SQL} SELECT sid, " + ", ".join(f"median(v) FILTER (WHERE item = '{i}') AS {i.lower()}" for i in ("HR", "SBP", "ISBP1", "MBP", "SpO2", "T1")) + " FROM series JOIN hand USING (sid) WHERE us >= handoff_us GROUP BY sid",
    ),
    "age_group_census": Query(
        lambda s, d: cases(s, d).groupBy(T.age_group(F.col("age")).alias("age_group")).agg(F.count(F.lit(1)).alias("n")),
        f"SELECT {_case(T.AGE_GROUPS, 1, 'age_years')} AS age_group, count(*) AS n FROM emr_case GROUP BY 1",
    ),
    "threshold_matrix": Query(
        threshold_matrix,
        f"SELECT CAST(a AS DOUBLE) AS age, {_case(T.AGE_GROUPS, 1, 'a')} AS age_group, {_case(T.HR_NORMAL, 1, 'a')} AS hr_lo, {_case(T.HR_NORMAL, 2, 'a')} AS hr_hi, {_case(T.HR_CRITICAL, 1, 'a')} AS hr_slow, {_case(T.HR_CRITICAL, 2, 'a')} AS hr_fast, {SBP_SQL.replace('age', 'a')} AS sbp_low, {_p95(100.0, 130.0, T.SBP_P95, 'a')} AS sbp_high, {_p95(65.0, 80.0, T.DBP_P95, 'a')} AS dbp_high, {MAP_SQL.replace('age', 'a')} AS map_low, "
        f"round({MAP_SQL.replace('age', 'a')} * 0.8, 6) AS map_drop, CASE "
        f"WHEN a < {T.NEONATE!r} THEN 470.0 ELSE 440.0 END AS qtc, {_case(T.EBV, 1, 'a')} AS ebv FROM {_AGES_SQL}",
    ),
    "hard_lines": Query(
        hard_lines,
        f"SELECT age, item, round({HARD_LOW_SQL}, 6) AS low, {HARD_HIGH_SQL} AS high FROM (SELECT CAST(a AS DOUBLE) AS age FROM {_AGES_SQL}), (VALUES ('HR'), "
        "('SBP'), ('MBP'), ('SpO2'), ('T1'), ('QTc'), ('Ppeak')) i(item)",
    ),
    "planned_hypothermia": Query(
        lambda s, d: records(s, d).groupBy("sid").agg(F.bool_or(T.planned_hypothermia(F.col("record"))).alias("planned")),
        "SELECT sid, bool_or(" + " OR ".join(f"contains(lower(emr), '{w}')" for w in T.PLANNED_HYPOTHERMIA) + ") AS planned FROM fewshot_bank WHERE sid <> -1 AND emr IS NOT NULL GROUP BY sid",
    ),
    "timeline_parse": Query(lambda s, d: timeline.parse(records(s, d)), f"WITH {TIMELINE_SQL} SELECT * FROM entries"),
    "keyword_categories": Query(lambda s, d: timeline.interventions(timeline.parse(records(s, d))), f"WITH {GIVEN_SQL} SELECT * FROM given"),
    "intervention_match_circular": Query(lambda s, d: timeline.matches(vitals.episodes(marks(s, d)), _given(s, d)), f"WITH {MATCH_SQL} SELECT * FROM matched"),
    "weight_discovery": Query(
        lambda s, d: cases(s, d).drop("weight").join(emr.weights(load(s, d, "emr_case"), "sid"), "sid"),
        f"WITH {CASES_SQL} SELECT * FROM cases",
    ),
    "vital_summary_text": Query(vital_summary, f"WITH {SUMMARY_SQL} SELECT sid, summary, n_reportable, n_minor, minor_text FROM summary"),
    "minute_formats": Query(
        lambda s, d: _readings(s, d).select("row_id", F.pmod(F.floor(F.col("us") / 60000000), F.lit(1440)).cast("int").alias("m")).select("row_id", F.col("m").alias("minute"), F.format_string("%02d:%02d", F.floor(F.col("m") / 60).cast("int"), (F.col("m") % 60).cast("int")).alias("hhmm")),
        f"WITH {READINGS_SQL} SELECT row_id, CAST((us // 60000000) % 1440 AS INT) AS minute, printf('%02d:%02d', "
        "CAST(((us // 60000000) % 1440) // 60 AS INT), CAST((us // 60000000) % 60 AS INT)) AS hhmm FROM readings",
    ),
}
