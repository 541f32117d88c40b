"""Audits: findings by category, events of older summaries, precision and recall of what is flagged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits
from ..session import load
from .query import Query

_R = lambda c, name=None: F.round(c, 6).alias(name or c)
_bank = lambda s, d: load(s, d, "fewshot_bank")
_gold = lambda s, d: load(s, d, "gold_checklist")
_inf = lambda s, d: load(s, d, "inference_records")
_n = lambda: F.count(F.lit(1)).alias("n")
finding_categories = audits.finding_categories

_FINDINGS_SQL = "(VALUES " + ", ".join(f"('{c}', '{w}')" for c, ws in audits.FINDING_WORDS.items() for w in ws) + ") f(category, word)"


def gt_categories(s, d):
    return _gold(s, d).select("sid", F.explode(finding_categories(F.col("gold_text"))).alias("category"))


_GT_CAT_SQL = f"SELECT DISTINCT sid, category FROM gold_checklist, {_FINDINGS_SQL} WHERE contains(lower(gold_text), word)"


def recall_missed(s, d):
    """Per finding category of the gold texts: cases, and cases whose answers name it."""
    said = _inf(s, d).where("sid <> -1 and generated is not null").select("sid", F.explode(finding_categories(F.col("generated"))).alias("category")).distinct().withColumn("hit", F.lit(1))
    return gt_categories(s, d).join(said, ["sid", "category"], "left").groupBy("category").agg(F.count(F.lit(1)).alias("gold"), F.count("hit").alias("found"), _R(F.count("hit") / F.count(F.lit(1)), "recall"))


_RECALL_SQL = f"WITH g AS ({_GT_CAT_SQL}), s AS (SELECT DISTINCT sid, category FROM inference_records, {_FINDINGS_SQL} WHERE sid <> -1 AND contains(lower(generated), word)) SELECT g.category, count(*) AS gold, count(s.sid) AS found, round(count(s.sid) / count(*), 6) AS recall FROM g LEFT JOIN s USING (sid, category) GROUP BY 1"


def legacy(s, d):
    return audits.legacy_events(_bank(s, d).select("rec_id", "vital"), "rec_id", "vital")


def legacy_summary(s, d):
    return legacy(s, d).select("rec_id", "line", "part", "item", "label", "category", "reportable", "n", "total_min", "longest_min")


_LABEL_SQL = lambda c: "CASE " + " ".join(f"WHEN contains({c}, '{k}') THEN '{v}'" for k, v in audits.LABEL_CATEGORIES) + " END"
_DUR_SQL = lambda c: f"(CASE WHEN regexp_extract({c}, '{audits.DURATION}', 0) = '<1분' THEN 0.5 WHEN regexp_extract({c}, '{audits.DURATION}', 3) = '시간' THEN 60 * TRY_CAST(regexp_extract({c}, '{audits.DURATION}', 2) AS DOUBLE) ELSE TRY_CAST(nullif(regexp_extract({c}, '{audits.DURATION}', 2), '') AS DOUBLE) END)"
LEGACY_SQL = f"""ln AS (SELECT rec_id, unnest(range(0, len(l))) AS line, l FROM (SELECT rec_id, string_split(vital, chr(10)) AS l FROM fewshot_bank WHERE vital IS NOT NULL)),
l2 AS (SELECT rec_id, line, trim(l[line + 1], ' ') AS t FROM ln), l3 AS (SELECT rec_id, line, trim(split_part(t, ':', 1), ' -') AS item, CASE WHEN contains(t, ', 이벤트: ') THEN string_split(split_part(t, ', 이벤트: ', 2), ' | ') ELSE [t] END AS parts FROM l2 WHERE t <> '' AND NOT starts_with(t, '(연령군') AND NOT starts_with(t, '###')),
l4 AS (SELECT rec_id, line, item, unnest(range(0, len(parts))) AS part, parts FROM l3), l5 AS (SELECT rec_id, line, part, item, trim(parts[part + 1], ' ') AS p FROM l4),
l6 AS (SELECT *, regexp_extract(p, '{audits.EVENT}', 1) <> '' AS crit, trim(regexp_extract(p, '{audits.EVENT}', 2), ' -') AS label, TRY_CAST(nullif(regexp_extract(p, '{audits.EVENT}', 3), '') AS INT) AS n, regexp_extract(p, '{audits.EVENT}', 4) AS dur FROM l5),
leg AS (SELECT rec_id, CAST(line AS INT) AS line, CAST(part AS INT) AS part, item, label, {_LABEL_SQL('label')} AS category, crit AS reportable, n, {_DUR_SQL('dur')} AS total_min, coalesce({_DUR_SQL("regexp_extract(dur, '최장[ ]*([^)]+)', 1)")}, {_DUR_SQL('dur')}) AS longest_min FROM l6 WHERE n IS NOT NULL)"""
_BUCKET_SQL = "CASE WHEN total_min IS NULL THEN '미상' WHEN total_min < 1 THEN '<1분' WHEN total_min < 5 THEN '1–5분' WHEN total_min < 15 THEN '5–15분' WHEN total_min < 30 THEN '15–30분' ELSE '>30분' END"
_TIMES_SQL = "CASE WHEN n IS NULL THEN '미상' WHEN n = 1 THEN '1회' WHEN n <= 3 THEN '2–3회' WHEN n <= 9 THEN '4–9회' ELSE '10회+' END"


def duration_buckets(s, d):
    return legacy(s, d).groupBy(audits.minutes_bucket(F.col("total_min")).alias("bucket"), audits.times_bucket(F.col("n")).alias("times")).agg(_n())


def ppv(s, d):
    """Of the events of older summaries, how many the record's hand-off confirms by category: per bucket of duration, of times
    and of category, within each split and over all."""
    told = _bank(s, d).select("rec_id", "split", finding_categories(F.col("handoff")).alias("told"))
    x = legacy(s, d).join(told, "rec_id").withColumn("hit", F.coalesce(F.array_contains("told", F.col("category")), F.lit(False)))
    keys = F.array(F.concat(F.lit("dur:"), audits.minutes_bucket(F.col("total_min"))), F.concat(F.lit("n:"), audits.times_bucket(F.col("n"))), F.concat(F.lit("cat:"), F.coalesce("category", F.lit("?"))))
    return audits.ppv_table(x.withColumn("keys", keys), "keys", "split", "hit")


_PPV_SQL = f"""WITH {LEGACY_SQL}, g AS (SELECT DISTINCT rec_id, category FROM fewshot_bank, {_FINDINGS_SQL} WHERE contains(lower(handoff), word)),
x AS (SELECT leg.*, b.split, g.rec_id IS NOT NULL AS hit FROM leg JOIN fewshot_bank b USING (rec_id) LEFT JOIN g ON g.rec_id = leg.rec_id AND g.category = leg.category),
k AS (SELECT unnest(['dur:' || {_BUCKET_SQL}, 'n:' || {_TIMES_SQL}, 'cat:' || coalesce(category, '?')]) AS key, split, hit FROM x)
SELECT key, split AS subset, CAST(grouping(split) AS INT) AS all_subsets, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, round(avg(CAST(hit AS DOUBLE)), 6) AS ratio FROM k GROUP BY GROUPING SETS ((key, split), (key))"""


QUERIES = {
    "gt_categories": Query(gt_categories, _GT_CAT_SQL),
    "legacy_summary_parse": Query(
        legacy_summary,
        f"WITH {LEGACY_SQL} SELECT rec_id, line, part, item, label, category, reportable, n, total_min, longest_min FROM leg",
    ),
    "duration_buckets": Query(
        duration_buckets,
        f"WITH {LEGACY_SQL} SELECT {_BUCKET_SQL} AS bucket, {_TIMES_SQL} AS times, count(*) AS n FROM leg GROUP BY ALL",
    ),
    "ppv_grouping_sets": Query(ppv, _PPV_SQL),
    "recall_missed": Query(recall_missed, _RECALL_SQL),
    "category_membership": Query(
        lambda s, d: _gold(s, d).select("sid", F.explode("check_items").alias("i")).select("sid", F.col("i.id").alias("id"), F.explode(finding_categories(F.col("i.finding"))).alias("category")).join(gt_categories(s, d).withColumn("in_gold", F.lit(True)), ["sid", "category"], "left").select("sid", "id", "category", F.coalesce("in_gold", F.lit(False)).alias("in_gold")),
        f"WITH g AS ({_GT_CAT_SQL}), i AS (SELECT sid, i.id AS id, i.finding AS finding FROM (SELECT sid, unnest(check_items) AS i FROM gold_checklist)), "
        f"c AS (SELECT DISTINCT sid, id, category FROM i, {_FINDINGS_SQL} WHERE contains(lower(finding), word)) SELECT c.sid, id, c.category, "
        "g.sid IS NOT NULL AS in_gold FROM c LEFT JOIN g USING (sid, category)",
    ),
    "case_burden": Query(
        lambda s, d: _gold(s, d).select("sid", F.explode("check_items").alias("i")).groupBy("sid").agg(_n(), F.count_if(F.col("i.severity") == "critical").alias("critical"), F.countDistinct("i.category").alias("categories")),
        "SELECT sid, count(*) AS n, count(*) FILTER (WHERE i.severity = 'critical') AS critical, count(DISTINCT i.category) AS categories FROM (SELECT sid, "
        "unnest(check_items) AS i FROM gold_checklist) GROUP BY sid",
    ),
    "prioritized_coalesce": Query(
        lambda s, d: load(s, d, "emr_case").select("sid").join(_gold(s, d).select("sid", F.col("gold_text").alias("a")), "sid", "left").join(_bank(s, d).where("handoff is not null and trim(handoff) <> '' and sid <> -1").groupBy("sid").agg(F.min_by("handoff", "rec_id").alias("b")), "sid", "left").select("sid", F.coalesce(F.nullif(F.trim("a"), F.lit("")), "b").alias("reference")),
        "WITH b AS (SELECT sid, arg_min(handoff, rec_id) AS b FROM fewshot_bank WHERE trim(handoff, ' ') <> '' AND sid <> -1 GROUP BY sid) SELECT e.sid, "
        "coalesce(nullif(trim(gold_text, ' '), ''), b) AS reference FROM emr_case e LEFT JOIN gold_checklist g USING (sid) LEFT JOIN b USING (sid)",
    ),
    "common_keys_vs_baseline": Query(
        lambda s, d: _inf(s, d).where("sid <> -1").select("sid", F.lower("engine").alias("e")).distinct().groupBy("sid").agg(F.count_if(F.col("e") == "vllm").alias("a"), F.count_if(F.col("e") == "hf").alias("b")).where("a > 0 and b > 0").select("sid"),
        "SELECT sid FROM inference_records WHERE lower(engine) = 'vllm' AND sid <> -1 INTERSECT SELECT sid FROM inference_records "
        "WHERE lower(engine) = 'hf' AND sid <> -1",
    ),
    "top_n": Query(
        lambda s, d: load(s, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "p_retailprice"),
        "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25",
    ),
    "case_order_by_mean": Query(
        lambda s, d: load(s, d, "orders").groupBy("o_custkey").agg(_R(F.avg("o_totalprice"), "mean"), _n()).orderBy(F.desc("mean"), "o_custkey").limit(100),
        "SELECT o_custkey, round(avg(o_totalprice), 6) AS mean, count(*) AS n FROM orders GROUP BY 1 ORDER BY mean DESC, o_custkey LIMIT 100",
    ),
    "provisional_accept": Query(
        lambda s, d: _gold(s, d).select("sid", "reviewed", (F.col("accepted_without_review") | ~F.col("reviewed")).alias("accepted")),
        "SELECT sid, reviewed, accepted_without_review OR NOT reviewed AS accepted FROM gold_checklist",
    ),
}
