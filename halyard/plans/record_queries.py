"""Records: splits, leak checks, joins, sets, order and ranks."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import hygiene as H
from ..operators import prompts, splits
from ..session import load
from .query import Query

_R = lambda c, name=None: F.round(c, 6).alias(name or c)
_bank = lambda s, d: load(s, d, "fewshot_bank")
_gold = lambda s, d: load(s, d, "gold_checklist")
_inf = lambda s, d: load(s, d, "inference_records")
_n = lambda: F.count(F.lit(1)).alias("n")


def _split(s, d, *names):
    return _bank(s, d).where(F.col("split").isin(*names) & (F.col("sid") != -1))


def fewshot_topk(s, d):
    """For each evaluation record two few-shot records of the whole bank, in an order of its own."""
    bank = _split(s, d, "fewshot").select(F.col("rec_id").alias("shot"))
    return splits.draw(_split(s, d, "dev").select("rec_id"), bank, "rec_id", "shot", 2)


def fewshot_block(s, d):
    """The same as the examples of a prompt, each record's first 700 characters with its hand-off."""
    bank = _split(s, d, "fewshot").select(F.col("rec_id").alias("shot"), "emr", "handoff")
    shots = fewshot_topk(s, d).join(bank, "shot").groupBy("rec_id").agg(F.collect_list(F.struct("k", "emr", "handoff")).alias("shots"))
    return shots.select("rec_id", prompts.shot_block(F.col("shots")).alias("block"))


def scale(s, d):
    """By idx the greatest share of an answer's words that its prompt has too, over the parts that a scorer takes."""
    x = _inf(s, d).where("generated is not null and idx is not null").select("idx", H.tokens(F.col("prompt_text")).alias("p"), prompts.chunks(F.col("generated")).alias("c"))
    share = F.array_max(F.transform("c", lambda c: F.size(F.filter(c, lambda w: F.array_contains("p", w))) / F.greatest(F.size(c), F.lit(1))))
    return x.groupBy("idx").agg(F.max(share).alias("scale"))


def scores_with_scale(s, d):
    return _inf(s, d).select("gen_id", "idx").join(scale(s, d), "idx", "left").select("gen_id", "idx", _R("scale"))


def positional_zip(s, d):
    """The answers of two engines side by side by their place in the order of their ids, as many as the smaller has."""
    x = _inf(s, d).where("generated is not null").select("gen_id", F.length("generated").alias("n"), F.lower("engine").alias("e"))
    a, b = x.where("e = 'vllm'").drop("e"), x.where("e = 'hf'").drop("e")
    least = min(a.count(), b.count())
    first = lambda df: df.orderBy("gen_id").limit(least)  # noqa: E731  the operator asks for equal numbers
    return splits.zip_by_position(first(a), first(b), "gen_id").select("position", "gen_id_a", "gen_id_b", "n_a", "n_b")


def manifest_of(s, d, split):
    """Each file of a model as a document of a source: its digest in one half of the documents."""
    return load(s, d, "documents").where(F.pmod("doc_id", F.lit(5)) != split).select(F.coalesce("source", F.lit("?")).alias("model"), F.floor(F.col("doc_id") / 2).alias("file"), "text", "doc_id").groupBy("model", "file").agg(F.sha1(F.coalesce(F.min_by("text", "doc_id"), F.lit(""))).alias("hash"))


def checksum_diff(s, d):
    a, b = manifest_of(s, d, 0).withColumnRenamed("hash", "a"), manifest_of(s, d, 1).withColumnRenamed("hash", "b")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "mismatch").otherwise("same")
    return a.join(b, ["model", "file"], "full").select("model", "file", state.alias("state"))


_FEW_SQL = "SELECT DISTINCT sid FROM fewshot_bank WHERE sid <> -1"
_KEY_SQL = lambda k: f"sha1('42:' || CAST({k} AS VARCHAR))"
_NUM_SQL = lambda k: f"CAST('0x' || substr(sha1('42:' || rec_id || ':{k}'), 1, 15) AS BIGINT)"
_DRAW_SQL = f"""bank AS (SELECT rec_id AS shot, emr, handoff, row_number() OVER (ORDER BY {_KEY_SQL('rec_id')}, rec_id) - 1 AS pos FROM fewshot_bank WHERE split = 'fewshot' AND sid <> -1), n AS (SELECT count(*) AS n FROM bank),
a AS (SELECT rec_id, n, {_NUM_SQL(0)} % greatest(n, 1) AS a0, {_NUM_SQL(1)} % greatest(n - 1, 1) AS a1 FROM fewshot_bank, n WHERE split = 'dev' AND sid <> -1),
drawn AS (SELECT rec_id, 1 AS k, a0 AS pos FROM a WHERE n > 0 UNION ALL SELECT rec_id, 2, a1 + CASE WHEN a1 >= a0 THEN 1 ELSE 0 END FROM a WHERE n > 1)"""
_MANIFEST_SQL = lambda k: f"SELECT coalesce(source, '?') AS model, doc_id // 2 AS file, sha1(coalesce(first(text ORDER BY doc_id), '')) AS h FROM documents WHERE doc_id % 5 <> {k} GROUP BY ALL"
_SP = "[ \\t\\n\\r\\f\u00a0\u3000]"
_WORDS_SQL = lambda c: f"list_filter(regexp_split_to_array({c}, '{_SP}+'), lambda t: t <> '')"

_SCALE_SQL = f"""x AS (SELECT idx, {_WORDS_SQL('prompt_text')} AS p, {_WORDS_SQL('generated')}[1:512] AS t, generated FROM inference_records WHERE generated IS NOT NULL AND idx IS NOT NULL),
c AS (SELECT idx, p, CASE WHEN len(t) > 0 THEN list_transform(range(0, (len(t) - 1) // 100 + 1), lambda k: t[k * 100 + 1 : k * 100 + 100]) ELSE [[generated]] END AS c FROM x),
m AS (SELECT idx, max(list_max(list_transform(c, lambda y: len(list_filter(y, lambda w: list_contains(p, w))) / len(y)))) AS scale FROM c GROUP BY idx)"""

QUERIES = {
    "split_in_two": Query(
        lambda s, d: splits.split_in_two(_bank(s, d).where("sid <> -1"), "sid", 40),
        f"WITH k AS ({_FEW_SQL}) SELECT sid, CASE WHEN row_number() OVER (ORDER BY {_KEY_SQL('sid')}, sid) <= 40 THEN 'few' ELSE 'rest' END AS part FROM k",
    ),
    "leak_overlap": Query(
        lambda s, d: splits.overlap(_split(s, d, "sft"), _split(s, d, "dev", "gold"), "sid"),
        "SELECT DISTINCT sid FROM fewshot_bank WHERE split = 'sft' AND sid <> -1 AND sid IN (SELECT sid FROM fewshot_bank WHERE split IN ('dev', 'gold'))",
    ),
    "key_census": Query(
        lambda s, d: load(s, d, "emr_case").select("sid", F.lit(1).alias("l")).join(load(s, d, "vital_df").where("sid <> -1").select("sid").distinct().withColumn("r", F.lit(1)), "sid", "full").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("emr_only"), F.count_if(F.col("l").isNull()).alias("vital_only")),
        "SELECT count(*) FILTER (WHERE e.sid IS NOT NULL AND v.sid IS NOT NULL) AS both, count(*) FILTER (WHERE v.sid IS NULL) AS emr_only, "
        "count(*) FILTER (WHERE e.sid IS NULL) AS vital_only FROM emr_case e FULL JOIN (SELECT DISTINCT sid FROM vital_df WHERE sid <> -1) v ON e.sid = v.sid",
    ),
    "split_manifest": Query(
        lambda s, d: _bank(s, d).groupBy("split").agg(_n(), F.countDistinct("sid").alias("sids"), F.count_if(F.col("sid") == -1).alias("unread"), F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi")),
        "SELECT split, count(*) AS n, count(DISTINCT sid) AS sids, count(*) FILTER (WHERE sid = -1) AS unread, min(rec_id) AS lo, max(rec_id) AS hi "
        "FROM fewshot_bank GROUP BY split",
    ),
    "identical_output_groups": Query(
        lambda s, d: _inf(s, d).where("generated is not null").groupBy(F.sha1("generated").alias("h")).agg(_n(), F.min("gen_id").alias("first")).where("n > 1"),
        "SELECT sha1(generated) AS h, count(*) AS n, min(gen_id) AS first FROM inference_records WHERE generated IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    ),
    "subsample_hash": Query(
        lambda s, d: load(s, d, "documents").select("doc_id").orderBy(splits.order_key(F.col("doc_id")), "doc_id").limit(100),
        f"SELECT doc_id FROM documents ORDER BY {_KEY_SQL('doc_id')}, doc_id LIMIT 100",
    ),
    "left_default": Query(
        lambda s, d: load(s, d, "emr_case").select("sid").join(_gold(s, d).select("sid", "gold_text"), "sid", "left").select("sid", F.coalesce("gold_text", F.lit("")).alias("gold")),
        "SELECT sid, coalesce(gold_text, '') AS gold FROM emr_case LEFT JOIN gold_checklist USING (sid)",
    ),
    "union_first_wins": Query(
        lambda s, d: _bank(s, d).where("sid <> -1").withColumn("k", F.row_number().over(W.partitionBy("sid").orderBy(F.when(F.col("split") == "gold", 0).when(F.col("split") == "dev", 1).when(F.col("split") == "fewshot", 2).otherwise(3), "rec_id"))).where("k = 1").select("sid", "split", "rec_id"),
        "SELECT sid, split, rec_id FROM fewshot_bank WHERE sid <> -1 QUALIFY row_number() OVER (PARTITION BY sid ORDER BY CASE split WHEN 'gold' THEN 0 "
        "WHEN 'dev' THEN 1 WHEN 'fewshot' THEN 2 ELSE 3 END, rec_id) = 1",
    ),
    "intersect": Query(
        lambda s, d: _split(s, d, "dev").select("sid").intersect(_split(s, d, "fewshot").select("sid")),
        "SELECT sid FROM fewshot_bank WHERE split = 'dev' AND sid <> -1 INTERSECT SELECT sid FROM fewshot_bank WHERE split = 'fewshot' AND sid <> -1",
    ),
    "except": Query(
        lambda s, d: _split(s, d, "gold").select("sid").subtract(_split(s, d, "sft").select("sid")),
        "SELECT sid FROM fewshot_bank WHERE split = 'gold' AND sid <> -1 EXCEPT SELECT sid FROM fewshot_bank WHERE split = 'sft' AND sid <> -1",
    ),
    "distinct_policies": Query(
        lambda s, d: _inf(s, d).select(F.lower("engine").alias("engine"), F.lower("gen_status").alias("status")).distinct(),
        "SELECT DISTINCT lower(engine) AS engine, lower(gen_status) AS status FROM inference_records",
    ),
    "review_counts": Query(
        lambda s, d: _gold(s, d).agg(F.count_if("reviewed").alias("reviewed"), F.count_if(~F.col("reviewed") & F.col("accepted_without_review")).alias("accepted"), F.count_if(~F.col("reviewed") & ~F.col("accepted_without_review")).alias("provisional")),
        "SELECT count(*) FILTER (WHERE reviewed) AS reviewed, count(*) FILTER (WHERE NOT reviewed AND accepted_without_review) AS accepted, "
        "count(*) FILTER (WHERE NOT reviewed AND NOT accepted_without_review) AS provisional FROM gold_checklist",
    ),
    "gold_note": Query(
        lambda s, d: _gold(s, d).select("sid", F.explode("check_items").alias("i")).groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("i.severity") == "critical", 0).when(F.col("i.severity") == "major", 1).otherwise(2).alias("o"), F.col("i.id").alias("id"), F.col("i.finding").alias("f")))), lambda x: x["f"]), "\n").alias("note")),
        "SELECT sid, string_agg(i.finding, chr(10) ORDER BY CASE i.severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, i.id) AS note "
        "FROM (SELECT sid, unnest(check_items) AS i FROM gold_checklist) GROUP BY sid",
    ),
    "top1_per_group": Query(
        lambda s, d: load(s, d, "orders").withColumn("k", F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("k = 1").select("o_orderpriority", "o_orderkey", "o_totalprice"),
        "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, "
        "o_orderkey) = 1",
    ),
    "rank_two_key": Query(
        lambda s, d: load(s, d, "customer").orderBy(F.coalesce("c_acctbal", F.lit(0)).desc(), "c_custkey").limit(50).select("c_custkey", "c_acctbal"),
        "SELECT c_custkey, c_acctbal FROM customer ORDER BY coalesce(c_acctbal, 0) DESC, c_custkey LIMIT 50",
    ),
    "stratified_quota": Query(
        lambda s, d: splits.stratified(_gold(s, d), "sid", "is_normal_case", 12),
        f"""WITH g AS (SELECT sid, coalesce(is_normal_case, false) AS is_normal_case FROM gold_checklist), q AS (SELECT least(round_even(12 * count(*) FILTER (WHERE is_normal_case) / count(*), 0), count(*) FILTER (WHERE is_normal_case)) AS q FROM g)
SELECT sid, is_normal_case, row_number() OVER (PARTITION BY is_normal_case ORDER BY {_KEY_SQL('sid')}, sid) <= CASE WHEN is_normal_case THEN q ELSE 12 - q END AS picked FROM g, q""",
    ),
    "fewshot_topk_per_row": Query(fewshot_topk, f"WITH {_DRAW_SQL} SELECT rec_id, shot, k FROM drawn JOIN bank USING (pos)"),
    "fewshot_block": Query(
        fewshot_block,
        f"WITH {_DRAW_SQL} SELECT rec_id, '### EXAMPLES' || chr(10) || string_agg(chr(10) || 'Example ' || k || chr(10) || substr(coalesce(emr, ''), 1, "
        "700) || chr(10) || 'Handoff' || chr(10) || coalesce(handoff, '') || chr(10) || '--', chr(10) ORDER BY k) AS block FROM drawn JOIN bank USING (pos) "
        "GROUP BY rec_id",
    ),
    "split_fingerprint": Query(
        lambda s, d: splits.fingerprint(_bank(s, d).where("sid <> -1"), "split", "sid"),
        "WITH k AS (SELECT DISTINCT split, sid FROM fewshot_bank WHERE sid <> -1), b AS (SELECT split, sid % 1024 AS b, count(*) AS n, "
        "sha1(string_agg(CAST(sid AS VARCHAR), ',' ORDER BY sid)) AS h FROM k GROUP BY ALL) SELECT split, CAST(sum(n) AS BIGINT) AS n, "
        "substr(sha1(string_agg(h, ',' ORDER BY b)), 1, 16) AS digest FROM b GROUP BY split",
    ),
    "strict_inner_with_miss_count": Query(
        lambda s, d: splits.strict_join(_inf(s, d).where("sid <> -1").select("sid", "gen_id"), load(s, d, "emr_case").select("sid", "idx"), "sid", "records").groupBy((F.col("idx") % 10).alias("part")).agg(_n(), F.countDistinct("sid").alias("sids")),
        "SELECT c.idx % 10 AS part, count(*) AS n, count(DISTINCT r.sid) AS sids FROM inference_records r JOIN emr_case c USING (sid) WHERE r.sid <> -1 GROUP BY 1",
    ),
    "sid_set": Query(
        lambda s, d: splits.require_sids(_split(s, d, "dev", "gold"), "evaluation"),
        "SELECT DISTINCT sid FROM fewshot_bank WHERE split IN ('dev', 'gold') AND sid <> -1",
    ),
    "scores_with_scale": Query(
        scores_with_scale,
        f"""WITH {_SCALE_SQL} SELECT gen_id, idx, round(scale, 6) AS scale FROM inference_records LEFT JOIN m USING (idx)""",
    ),
    "chunk_max": Query(lambda s, d: scale(s, d).select("idx", _R("scale")), f"WITH {_SCALE_SQL} SELECT idx, round(scale, 6) AS scale FROM m"),
    "positional_zip": Query(
        positional_zip,
        """WITH x AS (SELECT gen_id, length(generated) AS n, lower(engine) AS e, row_number() OVER (PARTITION BY lower(engine) ORDER BY gen_id) - 1 AS position FROM inference_records WHERE generated IS NOT NULL)
SELECT position, a.gen_id AS gen_id_a, b.gen_id AS gen_id_b, a.n AS n_a, b.n AS n_b FROM x a JOIN x b USING (position) WHERE a.e = 'vllm' AND b.e = 'hf'""",
    ),
    "checksum_diff": Query(
        checksum_diff,
        f"WITH a AS ({_MANIFEST_SQL(0)}), b AS ({_MANIFEST_SQL(1)}) SELECT coalesce(a.model, b.model) AS model, coalesce(a.file, b.file) AS file, CASE "
        "WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' WHEN a.h <> b.h THEN 'mismatch' ELSE 'same' END AS state FROM a FULL "
        "JOIN b ON a.model = b.model AND a.file = b.file",
    ),
    "ffill_merged_cells": Query(
        lambda s, d: load(s, d, "documents").select("sid", "doc_id", F.last("source", True).over(W.partitionBy("sid").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0)).alias("source")),
        "SELECT sid, doc_id, last_value(source IGNORE NULLS) OVER (PARTITION BY sid ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS source FROM documents",
    ),
    "avg_ignore_null": Query(
        lambda s, d: load(s, d, "emr_case").groupBy("dept").agg(_R(F.avg("age_years"), "age"), F.count("age_years").alias("n")),
        "SELECT dept, round(avg(age_years), 6) AS age, count(age_years) AS n FROM emr_case GROUP BY dept",
    ),
    "first_last_metric": Query(
        lambda s, d: load(s, d, "events").withColumn("v", F.when(F.col("value") >= 1, F.col("value"))).groupBy("user_id", "event_type").agg(F.min_by("v", F.struct("ts", "event_id")).alias("first"), F.max_by("v", F.struct("ts", "event_id")).alias("last"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_or(F.col("v").isNull()).alias("gaps")),
        "WITH e AS (SELECT *, CASE WHEN value >= 1 THEN value END AS v FROM events) SELECT user_id, event_type, first(v ORDER BY ts, event_id) AS first, "
        "last(v ORDER BY ts, event_id) AS last, min(v) AS lo, max(v) AS hi, bool_or(v IS NULL) AS gaps FROM e GROUP BY ALL",
    ),
    "model_score_order": Query(
        lambda s, d: load(s, d, "orders").orderBy(F.asc_nulls_last("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderpriority", "o_totalprice", "o_orderkey"),
        "SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 200",
    ),
}
