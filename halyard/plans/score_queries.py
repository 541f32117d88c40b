"""Scores, pairs, review of gold texts, roles and statistics, over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hygiene as H
from ..operators import pairs, review, roles, scoring, statistics as S
from ..session import load
from .query import Query
from .sqltext import BOTH_SIDES_T, CATEGORY_SQL, GOLD_SQL, NO_ISSUE_SQL, RANKED, SQUEEZE_SQL, STRIP_SQL, TAIL_Z

_R = lambda c, name=None: F.round(c, 6).alias(name or c)


def _gold(s: SparkSession, d: str) -> DataFrame:
    """Each case's gold as a judge needs it: source, has_items, normal."""
    g = load(s, d, "gold_checklist")
    text = H.strip(F.coalesce("gold_text", F.lit("")))
    items = F.coalesce(F.size("check_items") > 0, F.lit(False))
    normal = F.coalesce("is_normal_case", F.lit(False))
    source = F.when(text == "", "no_gold").when(H.no_issue(text), "gold_normal").when(~items & ~normal, "gold_failed").otherwise("gold_llm")
    return g.select("sid", source.alias("source"), items.alias("has_items"), normal.alias("normal"))


def fast(s: SparkSession, d: str) -> DataFrame:
    """The score of each record that needs no judge; the others have nulls."""
    x = load(s, d, "inference_records").where("sid <> -1").join(_gold(s, d), "sid", "left")
    source = F.coalesce("source", F.lit("no_gold"))
    f = scoring.fast_score(F.col("gen_status"), source, F.coalesce("has_items", F.lit(False)), F.coalesce("normal", F.lit(False)), H.no_issue(F.col("generated")))
    return x.select("gen_id", "idx", "sid", "engine", "generated", f.alias("f")).select("gen_id", "idx", "sid", "engine", "generated", "f.*")


_NI = NO_ISSUE_SQL("generated")
FAST_SQL = f"""{GOLD_SQL},
cases_of AS (SELECT r.gen_id, r.idx, r.sid, r.engine, r.generated, CASE WHEN coalesce(lower(gen_status), '') <> 'ok' THEN 1 WHEN coalesce(source, 'no_gold') = 'no_gold' THEN 2 WHEN source = 'gold_failed' THEN 3
    WHEN normal AND {_NI} THEN 4 WHEN has_items AND NOT normal AND {_NI} THEN 5 END AS k FROM inference_records r LEFT JOIN gold USING (sid) WHERE r.sid <> -1),
fast AS (SELECT gen_id, idx, sid, engine, generated, CAST(CASE k WHEN 1 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 0 END AS DOUBLE) AS coverage, CAST(CASE k WHEN 1 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 0 END AS DOUBLE) AS faithfulness,
    CAST(CASE k WHEN 1 THEN 0 WHEN 4 THEN 1 END AS DOUBLE) AS brevity, CAST(CASE k WHEN 1 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 0 END AS DOUBLE) AS composite, CASE k WHEN 1 THEN 'degenerate' WHEN 5 THEN 'missed_abnormal' WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN '' END AS gate,
    CASE WHEN k IN (2, 3) THEN true WHEN k IS NOT NULL THEN false END AS excluded, CASE k WHEN 2 THEN 'no_gold' WHEN 3 THEN 'checklist_extract_failed' END AS exclude_reason FROM cases_of)"""
_FIELDS = ("coverage", "faithfulness", "brevity", "composite", "gate", "excluded", "exclude_reason")
_FIELDS_SQL = ", ".join(_FIELDS)


def fast_dev(s, d):
    x = load(s, d, "inference_records").select("gen_id", scoring.fast_score_dev(F.col("gen_status"), H.no_issue(F.col("generated"))).alias("f"))
    return x.select("gen_id", "f.*")


def judged(s, d):
    """Line items as claims and verdicts: scores of two judges (by line status) of each order."""
    x = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("case"), F.col("l_linestatus").alias("judge")).agg(
        F.avg(scoring.points(F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "partial").otherwise("no"))).alias("cov"),
        F.collect_list(F.when(F.col("l_discount") > 0.05, "supported").when(F.col("l_discount") > 0.03, "unsupported")).alias("claims"), F.max("l_tax").alias("tax"), F.min("l_linenumber").alias("ord"),
    )
    raw = F.when(F.col("tax") < 0.07, (F.round(F.col("tax") * 100) + 1).cast("string")).otherwise("unclear")
    x = x.select("case", "judge", "ord", scoring.judged(F.when(F.col("cov") < 0.9, F.col("cov")), scoring.faithfulness(F.col("claims")), scoring.brevity(raw), F.col("cov") > 0).alias("f"))
    return x.select("case", "judge", "ord", "f.*")


_JUDGED_SQL = """j0 AS (SELECT l_orderkey AS "case", l_linestatus AS judge, min(l_linenumber) AS ord, avg(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 ELSE 0.0 END) AS cov0, count(*) FILTER (WHERE l_discount > 0.05) AS sup,
  count(*) FILTER (WHERE l_discount > 0.03) AS claims, max(l_tax) AS tax FROM lineitem GROUP BY ALL),
j1 AS (SELECT *, cov0 > 0 AS has, CASE WHEN cov0 < 0.9 THEN cov0 END AS c, CASE WHEN claims > 0 THEN sup / claims END AS f, CASE WHEN tax < 0.07 THEN (least(round(tax * 100) + 1, 5) - 1) / 4 END AS b FROM j0),
judged AS (SELECT "case", judge, ord, CASE WHEN has THEN c END AS coverage, f AS faithfulness, b AS brevity, round(CASE WHEN has THEN 0.5 * c + 0.3 * f + 0.2 * b ELSE (0.3 * f + 0.2 * b) / 0.5 END, 4) AS composite, '' AS gate,
  (has AND c IS NULL) OR f IS NULL OR b IS NULL AS excluded,
  CASE WHEN (has AND c IS NULL) OR f IS NULL OR b IS NULL THEN 'judge_failed(' || concat_ws('; ', CASE WHEN has AND c IS NULL THEN 'coverage' END, CASE WHEN f IS NULL THEN 'faithfulness' END, CASE WHEN b IS NULL THEN 'brevity' END) || ')' END AS exclude_reason FROM j1)"""


def variant_summary(s, d):
    """Per engine: records, those excluded, the means of the axes, gates, and how often an answer says that there is nothing."""
    x = fast(s, d).withColumn("variant", F.coalesce(F.lower("engine"), F.lit("?")))
    known = F.coalesce(F.col("excluded"), F.lit(False))
    return x.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~known).alias("n_valid"), F.count_if(known).alias("n_excluded"), *[_R(F.avg(a), a) for a in ("coverage", "faithfulness", "brevity", "composite")],
        F.count_if(F.col("gate") == "degenerate").alias("degenerate"), F.count_if(F.col("gate") == "missed_abnormal").alias("missed_abnormal"), _R(F.avg(H.no_issue(F.col("generated")).cast("double")), "no_issue_rate"),
    )


def variant_intervals(s, d):
    """The mean of each engine's scores with its bootstrap interval."""
    x = fast(s, d).where("not coalesce(excluded, false)").select(F.coalesce(F.lower("engine"), F.lit("?")).alias("variant"), "composite", F.lit(0.0).alias("zero"))
    return S.resample(x, "variant", "composite", "zero").select("variant", "n", "mean", "lo", "hi")


_CATS = H.CATEGORIES


def verdicts(s, d):
    """Line items as verdicts on the items of a checklist: returned A is yes, R partial, N no; the supplier says the category."""
    cat = F.element_at(F.array(*map(F.lit, _CATS)), (F.pmod("l_suppkey", F.lit(len(_CATS))) + 1).cast("int"))
    status = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "partial").otherwise("no")
    return load(s, d, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("item"), cat.alias("category"), status.alias("status"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_returnflag").alias("ord"))


_VERDICT_SQL = f"v AS (SELECT l_orderkey AS \"case\", l_linenumber AS item, [{', '.join(repr(c) for c in _CATS)}][l_suppkey % {len(_CATS)} + 1] AS category, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 ELSE 0.0 END AS p FROM lineitem)"


def candidates(s, d):
    """Line items as candidates of an order, each scored by two rubrics in text, of which some can't be read."""
    x = load(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_tax")])
    x = x.select(F.col("l_orderkey").alias("row_idx"), (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("ord"), F.concat("l_returnflag", F.lit("  "), F.lower("l_linestatus")).alias("txt"), "l_quantity", "l_tax")
    said = lambda n: F.concat(F.lit("feedback [RESULT] ("), n.cast("string"), F.lit(")"))
    both = F.array(F.struct(F.lit("cov").alias("rubric"), said(F.pmod(F.col("l_quantity").cast("int"), F.lit(7))).alias("answer")), F.struct(F.lit("fid").alias("rubric"), said(F.floor(F.col("l_tax") * 50) + 1).alias("answer")))
    return x.select("row_idx", "ord", "txt", F.explode(both).alias("r")).select("row_idx", "ord", "txt", "r.rubric", H.result_score(F.col("r.answer")).alias("score"))


_CAND_SQL = """cand AS (SELECT l_orderkey AS row_idx, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS ord, min(l_returnflag) || '  ' || lower(min(l_linestatus)) AS txt, CAST(min(l_quantity) AS INT) % 7 AS c, floor(min(l_tax) * 50) + 1 AS f FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
tot AS (SELECT row_idx, ord, txt, CAST(c AS DOUBLE) AS cov, CAST(f AS DOUBLE) AS fid, 2.0 * c + f AS total FROM cand WHERE c BETWEEN 1 AND 5 AND f BETWEEN 1 AND 5)"""


def _totalled(s, d):
    x = candidates(s, d)
    return pairs.totals(x).join(x.select("row_idx", "ord", "txt").distinct(), ["row_idx", "ord"])


def gt_merge(s, d):
    """Gold texts beside the first hand-off that the bank has for the case, as a review would put them."""
    new = load(s, d, "fewshot_bank").where("sid <> -1").groupBy("sid").agg(F.min_by("handoff", "rec_id").alias("new_gt"))
    old = load(s, d, "gold_checklist").select("sid", F.when(F.pmod("sid", F.lit(4)) == 0, "특이사항 없음").when(F.pmod("sid", F.lit(4)) == 1, F.col("gold_text")).when(F.pmod("sid", F.lit(4)) == 2, F.substring("gold_text", 1, 30)).otherwise("").alias("old_gt"))
    cut = F.when(F.pmod("sid", F.lit(3)) == 0, "특이사항 없었음").when(F.pmod("sid", F.lit(3)) == 1, F.col("new_gt")).otherwise(F.concat(F.lit("상기 내용 외 "), F.coalesce(F.substring("new_gt", 1, 40), F.lit(""))))
    return review.merge_gold(old.join(new, "sid", "left").withColumn("new_gt", cut)).select("sid", "merge_type", "final_gt")


_BARE = lambda c: f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"
_HOLLOW = lambda c: f"length(regexp_replace(regexp_replace({c}, '{review.CLAIMS_NONE}', '', 'g'), '[\\s*#:·\\-–—.,()]+', '', 'g')) < 15"
_GT_SQL = f"""WITH n AS (SELECT sid, arg_min(handoff, rec_id) AS w FROM fewshot_bank WHERE sid <> -1 AND handoff IS NOT NULL GROUP BY sid),
n0 AS (SELECT sid, first(handoff ORDER BY rec_id) AS w FROM fewshot_bank WHERE sid <> -1 GROUP BY sid),
x AS (SELECT g.sid, coalesce(CASE g.sid % 4 WHEN 0 THEN '특이사항 없음' WHEN 1 THEN gold_text WHEN 2 THEN substr(gold_text, 1, 30) ELSE '' END, '') AS o,
  coalesce(CASE g.sid % 3 WHEN 0 THEN '특이사항 없었음' WHEN 1 THEN w ELSE '상기 내용 외 ' || coalesce(substr(w, 1, 40), '') END, '') AS w FROM gold_checklist g LEFT JOIN n0 USING (sid)),
k AS (SELECT sid, o, w, CASE WHEN w = '' AND o <> '' THEN 'kept' WHEN w = '' THEN 'empty' WHEN o = '' THEN 'replaced' WHEN length({_BARE('o')}) > 0 AND starts_with({_BARE('w')}, substr({_BARE('o')}, 1, 12)) THEN 'replaced'
  WHEN length(w) >= 100 AND NOT regexp_matches(w, '{review.REFERS_BACK}') THEN 'replaced' WHEN {_HOLLOW('o')} AND NOT {_HOLLOW('w')} THEN 'replaced' WHEN regexp_matches(w, '{review.REFERS_BACK}') THEN 'merged'
  WHEN regexp_matches(w, '{review.CLAIMS_NONE}') AND regexp_matches(o, '{review.SUBSTANCE}') THEN 'merged_conflict' ELSE 'merged' END AS merge_type FROM x)
SELECT sid, merge_type, CASE WHEN merge_type IN ('kept', 'empty') THEN o WHEN merge_type = 'replaced' THEN w ELSE rtrim(o, ' ') || chr(10) || ltrim(w, ' ') END AS final_gt FROM k"""


def remap_override(s, d):
    """Gold texts with every fifth sid read as the next, and the bank's gold hand-offs of every third sid in place of the rest."""
    gold = load(s, d, "gold_checklist").select("sid", F.col("gold_text").alias("text"))
    remap = gold.where("sid % 5 = 0").select("sid", (F.col("sid") + 1).alias("real"))
    over = load(s, d, "fewshot_bank").where("split = 'gold' and sid <> -1 and sid % 3 = 0 and handoff is not null").groupBy("sid").agg(F.min_by("handoff", "rec_id").alias("text"))
    return review.remap_and_override(gold, remap, over)


_REMAP_SQL = """WITH o AS (SELECT sid AS "real", arg_min(handoff, rec_id) AS t FROM fewshot_bank WHERE split = 'gold' AND sid <> -1 AND sid % 3 = 0 AND handoff IS NOT NULL GROUP BY sid),
g AS (SELECT sid, CASE WHEN sid % 5 = 0 THEN sid + 1 ELSE sid END AS "real", gold_text FROM gold_checklist)
SELECT g.sid, g."real", coalesce(o.t, gold_text) AS text, CASE WHEN o.t IS NOT NULL THEN 'override' ELSE 'gold' END AS state FROM g LEFT JOIN o USING ("real")
UNION ALL SELECT NULL, o."real", NULL, 'unknown' FROM o WHERE o."real" NOT IN (SELECT "real" FROM g)"""


def checklist_state(s, d):
    """The checklists with every third item's id lost, as they come from a judge's answer."""
    item = lambda i: F.struct(F.when(i["id"] % 3 != 0, i["id"].cast("string")).alias("id"), F.when(i["id"] % 7 != 0, i["finding"]).otherwise(" ").alias("finding"), i["category"].alias("category"), i["severity"].alias("severity"), i["source"].alias("source"))
    parsed = F.when(F.col("check_items").isNotNull(), F.struct(F.col("is_normal_case"), F.transform("check_items", item).alias("items")))
    x = review.checklist(load(s, d, "gold_checklist").select("sid", "gold_text", parsed.alias("parsed")))
    shown = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["id"], i["category"], i["severity"])), ",")
    return x.select("sid", "source", "is_normal_case", F.size("items").alias("n"), shown.alias("items"))


_STATE_SQL = f"""WITH i AS (SELECT sid, gold_text, is_normal_case, check_items, list_filter(list_transform(coalesce(check_items, []), lambda i, k: {{'id': CASE WHEN i.id % 3 <> 0 THEN CAST(i.id AS VARCHAR) ELSE 'c' || k END,
  'f': CASE WHEN i.id % 7 <> 0 THEN {STRIP_SQL("coalesce(i.finding, '')")} ELSE '' END, 'c': {CATEGORY_SQL("i.category")}, 's': coalesce(i.severity, 'medium')}}), lambda i: i.f <> '') AS its FROM gold_checklist),
k AS (SELECT *, CASE WHEN {STRIP_SQL("coalesce(gold_text, '')")} = '' THEN 'no_gold' WHEN {NO_ISSUE_SQL('gold_text')} THEN 'gold_normal' END AS t, coalesce(is_normal_case AND check_items IS NOT NULL, false) AND len(its) = 0 AS nrm FROM i)
SELECT sid, coalesce(t, CASE WHEN check_items IS NULL OR (len(its) = 0 AND NOT nrm) THEN 'gold_failed' ELSE 'gold_llm' END) AS source, CASE WHEN t IS NULL THEN nrm ELSE t = 'gold_normal' END AS is_normal_case,
  CASE WHEN t IS NULL THEN CAST(len(its) AS INT) ELSE 0 END AS n, CASE WHEN t IS NULL THEN array_to_string(list_transform(its, lambda i: i.id || ':' || i.c || ':' || i.s), ',') ELSE '' END AS items FROM k"""


def _roles(s, d):
    """Nations as models, their regions as families; some have two roles."""
    n = load(s, d, "nation").join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("model"), F.col("r_name").alias("family"))
    names = F.array(*map(F.lit, ("teacher", "pair_judge", "judge", "trained", "extractor")))
    more = F.when(F.pmod("k", F.lit(10)) == 0, F.array(F.lit("judge"))).when(F.pmod("k", F.lit(11)) == 3, F.array(F.lit("judge"))).otherwise(F.array().cast("array<string>"))
    return n.select("model", "family", F.explode(F.concat(F.array(F.element_at(names, (F.pmod("k", F.lit(5)) + 1).cast("int"))), more)).alias("role"))


_ROLES_SQL = """n AS (SELECT n_nationkey AS k, n_name AS model, r_name AS family FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT model, family, ['teacher', 'pair_judge', 'judge', 'trained', 'extractor'][k % 5 + 1] AS role FROM n UNION ALL SELECT model, family, 'judge' FROM n WHERE k % 10 = 0 OR k % 11 = 3)"""


def eligible(s, d):
    r = _roles(s, d)
    return roles.eligible(r.where("role = 'trained'").select("model", "family"), r.where("role = 'judge'").select(F.col("model").alias("judge"), "family"))


def experiment_dag(s, d):
    """Parts as a tree: each hangs on the part of a third of its key."""
    p = load(s, d, "part").select(F.col("p_partkey").alias("k"))
    x = p.select(F.col("k").alias("name"), F.when(F.floor(F.col("k") / 3) > 0, F.floor(F.col("k") / 3)).alias("parent"))
    return roles.levels(x)


_PAIRED = lambda s, d: load(s, d, "lineitem").select(F.pmod("l_suppkey", F.lit(20)).alias("grp"), F.col("l_quantity").alias("a"), (F.col("l_tax") * 500 + 4).alias("b"))
_PAIRED_SQL = "(SELECT l_suppkey % 20 AS grp, l_quantity AS a, l_tax * 500 + 4 AS b FROM lineitem)"
_T_SQL = f"""t0 AS (SELECT grp, count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS sd FROM {_PAIRED_SQL} GROUP BY 1), t1 AS (SELECT *, m / (sd / sqrt(n)) AS t FROM t0)"""
_W_SQL = f"""w0 AS (SELECT grp, a - b AS d, {RANKED('abs(a - b)', 'grp')} AS r, count(*) OVER (PARTITION BY grp, abs(a - b)) AS c FROM {_PAIRED_SQL} WHERE a <> b),
w1 AS (SELECT grp, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0.0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0.0 END) AS w_minus, CAST(sum(c * c - 1) AS DOUBLE) AS ties FROM w0 GROUP BY 1),
w2 AS (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w1)"""
_SIGN_SQL = f"""s0 AS (SELECT grp, count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a < b) AS losses, count(*) FILTER (WHERE a = b) AS ties FROM {_PAIRED_SQL} GROUP BY 1),
s1 AS (SELECT *, (wins - losses) / (wins + losses) AS rb, least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) AS p FROM s0)"""


def _scores(s, d):
    """Line items as scores of variants: status is the model, return flag the variant, the part the case."""
    name = F.when(F.col("l_returnflag") == "N", "raw").when(F.col("l_returnflag") == "A", "sft_1ep").otherwise("rlaif_dpo")
    x = load(s, d, "lineitem").select(F.pmod("l_suppkey", F.lit(4)).cast("string").alias("model"), name.alias("variant"), F.col("l_partkey").alias("sid"), F.col("l_discount").alias("v"))
    return x.groupBy("model", "variant", "sid").agg(F.avg("v").alias("composite"), (F.count(F.lit(1)) > 8).alias("excluded"))


def against_raw(s, d):
    return S.against_raw(_scores(s, d), test="t").select("model", "name", "n_common", _R("mean_diff"), _R("p"), _R("p_holm"), "significant")


_RAW_SQL = f"""WITH x AS (SELECT CAST(l_suppkey % 4 AS VARCHAR) AS model, CASE l_returnflag WHEN 'N' THEN 'raw' WHEN 'A' THEN 'sft_1ep' ELSE 'rlaif_dpo' END AS variant, l_partkey AS sid, avg(l_discount) AS c, count(*) > 8 AS e FROM lineitem GROUP BY ALL),
b AS (SELECT v.model, v.variant AS name, v.c - r.c AS d FROM x v JOIN x r USING (model, sid) WHERE v.variant <> 'raw' AND r.variant = 'raw' AND NOT v.e AND NOT r.e),
g AS (SELECT model, name, count(*) AS n, avg(d) AS m, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM b GROUP BY ALL), p AS (SELECT *, CASE WHEN n >= 5 THEN {BOTH_SIDES_T('t', 'n - 1')} END AS p FROM g),
r AS (SELECT *, count(p) OVER (PARTITION BY model) AS k, row_number() OVER (PARTITION BY model, p IS NULL ORDER BY p, name) AS i FROM p),
h AS (SELECT *, CASE WHEN p IS NOT NULL THEN max(least(1.0, (k - i + 1) * p)) OVER (PARTITION BY model, p IS NULL ORDER BY i) END AS h FROM r)
SELECT model, name, n AS n_common, round(m, 6) AS mean_diff, round(p, 6) AS p, round(h, 6) AS p_holm, h < 0.05 AS significant FROM h"""

# fixed values: axis of the judge, axis of the expert, expected sign
CALIBRATION = (("coverage", "h_critical", 1), ("coverage", "h_under", -1), ("faithfulness", "h_err", -1), ("brevity", "h_brevity", 1), ("brevity", "h_over", -1), ("composite", "h_critical", 1))
_AXES = {"coverage": "l_discount", "faithfulness": "l_tax", "brevity": "l_quantity", "composite": "l_discount + l_tax", "h_critical": "l_extendedprice", "h_under": "l_linenumber", "h_err": "l_suppkey", "h_brevity": "l_partkey", "h_over": "l_linenumber + l_tax"}


def calibration_grid(s, d):
    """Rank correlation of each judge's axes (line status) with an expert's, over all and by family (return flag), and whether
    its sign is the expected one."""
    x = load(s, d, "lineitem").withColumns({name: F.expr(f"cast({e} as double)") for name, e in _AXES.items()})
    one = lambda a, h, e: F.struct(F.lit(a).alias("axis"), F.lit(h).alias("expert"), F.lit(e).alias("sign"), F.col(a).alias("a"), F.col(h).alias("b"))
    x = x.select("l_linestatus", F.explode(F.array(F.lit("all"), F.col("l_returnflag"))).alias("scope"), F.array(*[one(*c) for c in CALIBRATION]).alias("c")).select("l_linestatus", "scope", F.explode("c").alias("c"))
    x = x.select(F.concat_ws("|", "l_linestatus", "scope", "c.axis", "c.expert", F.col("c.sign").cast("string")).alias("g"), "c.a", "c.b")
    g = S.spearman(x, "g", "a", "b", 10).withColumn("k", F.split("g", "\\|"))
    return g.where("n >= 10").select(*[F.get("k", F.lit(i)).alias(c) for i, c in enumerate(("judge", "scope", "axis", "expert"))], "n", _R("rho"), (F.signum("rho") == F.get("k", F.lit(4)).cast("double")).alias("as_expected"))


_CAL_SQL = f"""WITH c AS ({" UNION ALL ".join(f"SELECT l_linestatus AS judge, unnest(['all', l_returnflag]) AS scope, '{a}' AS axis, '{h}' AS expert, {e} AS sign, CAST({_AXES[a]} AS DOUBLE) AS a, CAST({_AXES[h]} AS DOUBLE) AS b FROM lineitem" for a, h, e in CALIBRATION)}),
r AS (SELECT *, {RANKED('a', 'judge, scope, axis, expert')} AS ra, {RANKED('b', 'judge, scope, axis, expert')} AS rb FROM c)
SELECT judge, scope, axis, expert, count(*) AS n, round(corr(ra, rb), 6) AS rho, sign(corr(ra, rb)) = any_value(sign) AS as_expected FROM r GROUP BY ALL HAVING count(*) >= 10"""


def latest(df):
    return df.groupBy("sid").agg(F.max_by("generated", "gen_id").alias("generated"), F.max("gen_id").alias("gen_id"))


def with_scores(s, d):
    """Each generation beside the score of its case's last record."""
    last = fast(s, d).groupBy("sid").agg(F.max_by("composite", "gen_id").alias("composite"), F.max_by("gate", "gen_id").alias("gate"))
    return load(s, d, "inference_records").select("gen_id", "sid").join(last, "sid", "left")


def beside_earlier(s, d):
    """Outputs of one engine beside the earlier study's (the other engine's) by case."""
    x = load(s, d, "inference_records").where("sid <> -1 and generated is not null")
    of = lambda e: latest(x.where(F.lower("engine") == e))
    return of("vllm").select("sid", "gen_id", F.length("generated").alias("n")).join(of("hf").select("sid", F.col("gen_id").alias("earlier"), F.length("generated").alias("n_earlier")), "sid", "left")


QUERIES = {
    "fast_path": Query(lambda s, d: fast(s, d).select("gen_id", *_FIELDS), f"WITH {FAST_SQL} SELECT gen_id, {_FIELDS_SQL} FROM fast"),
    "fast_path_dev": Query(
        fast_dev,
        f"""WITH k AS (SELECT gen_id, CASE WHEN coalesce(lower(gen_status), '') <> 'ok' THEN 1 WHEN {_NI} THEN 2 END AS k FROM inference_records)
SELECT gen_id, CAST(NULL AS DOUBLE) AS coverage, CAST(CASE k WHEN 1 THEN 0 END AS DOUBLE) AS faithfulness, CAST(CASE k WHEN 1 THEN 0 END AS DOUBLE) AS brevity, CAST(CASE k WHEN 1 THEN 0 END AS DOUBLE) AS composite, CASE k WHEN 1 THEN 'degenerate' WHEN 2 THEN '' END AS gate, k = 2 AS excluded, CASE k WHEN 2 THEN 'dev_no_issue' END AS exclude_reason FROM k""",
    ),
    "exclusion_histogram": Query(
        lambda s, d: judged(s, d).where("excluded").groupBy(F.substring_index("exclude_reason", "(", 1).alias("reason"), "judge").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {_JUDGED_SQL} SELECT split_part(exclude_reason, '(', 1) AS reason, judge, count(*) AS n FROM judged WHERE excluded GROUP BY ALL",
    ),
    "valid_ratio": Query(
        lambda s, d: judged(s, d).groupBy("judge").agg(_R(F.avg((~F.col("excluded")).cast("double")), "ratio")).withColumn("enough", F.col("ratio") >= 0.8),
        f"WITH {_JUDGED_SQL} SELECT judge, round(avg(CAST(NOT excluded AS DOUBLE)), 6) AS ratio, round(avg(CAST(NOT excluded AS DOUBLE)), 6) >= 0.8 AS enough "
        "FROM judged GROUP BY 1",
    ),
    "composite": Query(
        lambda s, d: judged(s, d).select("case", "judge", _R("coverage"), _R("faithfulness"), "brevity", "composite", "excluded", "exclude_reason"),
        f'WITH {_JUDGED_SQL} SELECT "case", judge, round(coverage, 6) AS coverage, round(faithfulness, 6) AS faithfulness, brevity, CASE WHEN NOT excluded THEN composite END AS composite, excluded, exclude_reason FROM judged',
    ),
    "official_merge": Query(
        lambda s, d: scoring.official(judged(s, d), places=6),
        f"""WITH {_JUDGED_SQL}, g AS (SELECT "case", bool_or(excluded) AS excluded, coalesce(string_agg(judge || '=' || exclude_reason, ',' ORDER BY judge) FILTER (WHERE excluded), '') AS reasons, avg(coverage) AS c, avg(faithfulness) AS f, avg(brevity) AS b, avg(composite) AS k, count(*) AS judges FROM judged GROUP BY 1)
SELECT "case", excluded, reasons, CASE WHEN NOT excluded THEN round(c, 6) END AS coverage, CASE WHEN NOT excluded THEN round(f, 6) END AS faithfulness, CASE WHEN NOT excluded THEN round(b, 6) END AS brevity, CASE WHEN NOT excluded THEN round(k, 6) END AS composite, CASE WHEN NOT excluded THEN '' END AS gate, judges FROM g""",
    ),
    "variant_summary": Query(
        variant_summary,
        f"""WITH {FAST_SQL} SELECT coalesce(lower(engine), '?') AS variant, count(*) AS n_total, count(*) FILTER (WHERE NOT coalesce(excluded, false)) AS n_valid, count(*) FILTER (WHERE excluded) AS n_excluded, round(avg(coverage), 6) AS coverage, round(avg(faithfulness), 6) AS faithfulness,
round(avg(brevity), 6) AS brevity, round(avg(composite), 6) AS composite, count(*) FILTER (WHERE gate = 'degenerate') AS degenerate, count(*) FILTER (WHERE gate = 'missed_abnormal') AS missed_abnormal, round(avg(CAST({_NI} AS DOUBLE)), 6) AS no_issue_rate FROM fast GROUP BY 1""",
    ),
    "variant_intervals": Query(variant_intervals),
    "coverage": Query(
        lambda s, d: scoring.coverage(verdicts(s, d).select("case", "item"), verdicts(s, d).select("case", "item", "status", "ord")).select("case", _R("coverage"), "failed"),
        "WITH v AS (SELECT l_orderkey AS k, l_linenumber, arg_max(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 ELSE 0.0 END, (l_shipdate, "
        "l_partkey, l_suppkey, l_returnflag)) AS p FROM lineitem GROUP BY ALL) SELECT k AS \"case\", round(sum(p) / count(*), 6) AS coverage, "
        "false AS failed FROM v GROUP BY 1",
    ),
    "coverage_v2": Query(
        lambda s, d: scoring.coverage_v2(verdicts(s, d).select("case", "item"), verdicts(s, d).where("category <> 'other'").select("case", "item", "status", "ord")).select("case", _R("coverage")),
        f"""WITH i AS (SELECT DISTINCT l_orderkey AS "case", l_linenumber AS item FROM lineitem), w AS (SELECT l_orderkey AS "case", l_linenumber AS item, arg_max(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 ELSE 0.0 END, (l_shipdate, l_partkey, l_suppkey, l_returnflag)) AS p FROM lineitem WHERE l_suppkey % {len(_CATS)} <> {len(_CATS) - 1} GROUP BY ALL)
SELECT "case", round(avg(coalesce(p, 0.0)), 6) AS coverage FROM i LEFT JOIN w USING ("case", item) GROUP BY 1""",
    ),
    "coverage_macro_micro": Query(
        lambda s, d: verdicts(s, d).withColumn("p", scoring.points(F.col("status"))).groupBy("case").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")).agg(_R(F.avg(F.col("p") / F.col("n")), "macro"), _R(F.sum("p") / F.sum("n"), "micro")),
        f'WITH {_VERDICT_SQL}, c AS (SELECT "case", sum(p) AS p, count(*) AS n FROM v GROUP BY 1) SELECT round(avg(p / n), 6) AS macro, round(sum(p) / sum(n), 6) AS micro FROM c',
    ),
    "category_coverage": Query(
        lambda s, d: scoring.category_coverage(verdicts(s, d).withColumn("p", scoring.points(F.col("status")))).select("case", "category", "n", _R("score"), F.array_join("missed", ",").alias("missed"), (F.col("score") == 0).alias("all_missed")),
        f"WITH {_VERDICT_SQL} SELECT \"case\", category, count(*) AS n, round(avg(p), 6) AS score, coalesce(string_agg(CAST(item AS VARCHAR), ',' "
        "ORDER BY item) FILTER (WHERE p = 0), '') AS missed, avg(p) = 0 AS all_missed FROM v WHERE category <> 'other' GROUP BY ALL",
    ),
    "score_v2": Query(
        lambda s, d: judged(s, d).join(load(s, d, "orders").select(F.col("o_orderkey").alias("case"), "o_orderstatus"), "case").select("case", "judge", scoring.score_v2(F.lit("ok"), F.col("o_orderstatus") != "O", F.lit(False), F.lit(False), F.col("coverage"), F.col("faithfulness"), F.col("brevity")).alias("score")),
        f"""WITH {_JUDGED_SQL} SELECT "case", judge, round(CASE WHEN o_orderstatus = 'O' THEN (0.3 * coalesce(faithfulness, 0.5) + 0.2 * coalesce(brevity, 0.5)) / 0.5 ELSE 0.5 * coalesce(coverage, 0.0) + 0.3 * coalesce(faithfulness, 0.5) + 0.2 * coalesce(brevity, 0.5) END, 4) AS score FROM judged JOIN orders ON o_orderkey = "case\"""",
    ),
    "score_v1": Query(
        lambda s, d: load(s, d, "inference_records").where("generated_raw is not null").select("gen_id", scoring.sum_v1(H.clean_v1(F.col("generated_raw"), "특이사항 없음"), F.col("generated_raw"), F.pmod("gen_id", F.lit(5)) + 1.0, F.pmod("idx", F.lit(5)) + 1.0, H.FAILED_V1).alias("score")),
        "WITH x AS (SELECT gen_id, idx, generated_raw AS r FROM inference_records WHERE generated_raw IS NOT NULL) SELECT gen_id, CAST(CASE "
        "WHEN length(r) < 5 THEN 2 ELSE gen_id % 5 + idx % 5 + 2 END AS DOUBLE) AS score FROM x",
    ),
    "logit_expectation": Query(
        lambda s, d: load(s, d, "embeddings").select("vec_id", scoring.expectation(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 10)).alias("score")),
        "WITH x AS (SELECT vec_id, list_transform(embedding[1:5], lambda v: exp(CAST(v AS DOUBLE) * 10)) AS w FROM embeddings) SELECT vec_id, "
        "round(list_sum(list_transform(w, lambda v, k: v * k)) / list_sum(w), 4) AS score FROM x",
    ),
    "position_debias": Query(
        lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _R(scoring.debiased(F.col("l_discount") * 10, F.col("l_tax") * 10) * 4 + 1, "score")),
        "SELECT l_orderkey, l_linenumber, l_partkey, round((l_discount * 10 + (1 - l_tax * 10)) / 2 * 4 + 1, 6) AS score FROM lineitem",
    ),
    "faithfulness_brevity": Query(
        lambda s, d: judged(s, d).groupBy("judge").agg(_R(F.avg("faithfulness"), "faithfulness"), F.count("faithfulness").alias("n_faith"), _R(F.avg("brevity"), "brevity"), F.count("brevity").alias("n_brev")),
        f"WITH {_JUDGED_SQL} SELECT judge, round(avg(faithfulness), 6) AS faithfulness, count(faithfulness) AS n_faith, round(avg(brevity), 6) AS brevity, "
        "count(brevity) AS n_brev FROM judged GROUP BY 1",
    ),
    "pair_total": Query(lambda s, d: pairs.totals(candidates(s, d)), f"WITH {_CAND_SQL} SELECT row_idx, ord, cov, fid, total FROM tot"),
    "pair_select": Query(
        lambda s, d: pairs.select_pairs(_totalled(s, d)),
        f"""WITH {_CAND_SQL}, g AS (SELECT row_idx, count(*) AS n, arg_max(txt, (total, -ord)) AS b, arg_min(txt, (total, -ord)) AS w, max(total) - min(total) AS m FROM tot GROUP BY row_idx),
k AS (SELECT *, CASE WHEN n < 2 THEN 'too_few' WHEN {SQUEEZE_SQL('b')} = {SQUEEZE_SQL('w')} THEN 'identical' WHEN m < 2 THEN 'no_margin' ELSE 'kept' END AS outcome FROM g)
SELECT row_idx, n, outcome, CASE WHEN outcome = 'kept' THEN b END AS chosen, CASE WHEN outcome = 'kept' THEN w END AS rejected, CASE WHEN outcome = 'kept' THEN m END AS margin FROM k""",
    ),
    "chosen_rejected_v1": Query(
        lambda s, d: pairs.chosen_rejected_v1(_totalled(s, d)),
        f"WITH {_CAND_SQL} SELECT row_idx, arg_max(ord, (total, -ord)) AS chosen, arg_min(ord, (total, sha1('42:' || row_idx || ':' || ord))) AS rejected "
        "FROM tot GROUP BY row_idx HAVING count(*) >= 2",
    ),
    "gt_merge": Query(gt_merge, _GT_SQL),
    "gt_confirmed": Query(
        lambda s, d: review.confirmed(load(s, d, "gold_checklist").select("sid", F.when(F.col("reviewed"), " y").when(F.col("accepted_without_review"), "N").alias("ok"), F.when(F.pmod("sid", F.lit(6)) == 0, "  ").otherwise(F.col("gold_text")).alias("final_gt"))),
        f"WITH x AS (SELECT sid, reviewed AS y, {STRIP_SQL("CASE WHEN sid % 6 = 0 THEN '' ELSE coalesce(gold_text, '') END")} AS t FROM gold_checklist) "
        "SELECT sid, CASE WHEN NOT coalesce(y, false) THEN 'skipped' WHEN t = '' THEN 'empty' ELSE 'confirmed' END AS state, CASE "
        "WHEN y AND t <> '' THEN t END AS final_gt FROM x",
    ),
    "remap_override": Query(remap_override, _REMAP_SQL),
    "checklist_state": Query(checklist_state, _STATE_SQL),
    "items_by_category_with_empty": Query(
        lambda s, d: s.createDataFrame([(c,) for c in _CATS], "category string").join(load(s, d, "gold_checklist").select(F.explode("check_items").alias("i")).select(H.category(F.col("i.category")).alias("category"), F.col("i.id").alias("id")), "category", "left").groupBy("category").agg(F.count("id").alias("n")),
        f"WITH i AS (SELECT {CATEGORY_SQL('i.category')} AS category, i.id AS id FROM (SELECT unnest(check_items) AS i FROM gold_checklist)) "
        f"SELECT c.category, count(id) AS n FROM (VALUES {', '.join(f'({c!r})' for c in _CATS)}) c(category) LEFT JOIN i ON c.category = i.category GROUP BY 1",
    ),
    "panel_eligibility": Query(
        eligible,
        f"WITH {_ROLES_SQL} SELECT t.model, j.model AS judge, t.family = j.family AS same_family FROM r t, r j WHERE t.role = 'trained' AND j.role = 'judge'",
    ),
    "role_conflicts": Query(
        lambda s, d: roles.conflicts(_roles(s, d)),
        f"""WITH {_ROLES_SQL}, o AS (SELECT DISTINCT role, model, family FROM r), b AS (SELECT * FROM (VALUES ('teacher', 'judge', 'teacher_judges', 'error'), ('teacher', 'pair_judge', 'teacher_pairs', 'error'), ('pair_judge', 'judge', 'pair_judge_judges', 'error'), ('extractor', 'judge', 'extractor_judges', 'warning'), ('judge', 'trained', 'judge_trained', 'warning')) v(r1, r2, rule, level))
SELECT rule, level, x.model FROM b JOIN o x ON x.role = r1 WHERE EXISTS (SELECT 1 FROM o y WHERE y.role = r2 AND y.model = x.model)
UNION ALL SELECT 'judge_family_trained', 'warning', model FROM o WHERE role = 'judge' AND model NOT IN (SELECT model FROM o WHERE role = 'trained') AND family IN (SELECT family FROM o WHERE role = 'trained')
UNION ALL SELECT 'family_twice', 'warning', model FROM o WHERE role = 'judge' AND family IN (SELECT family FROM o WHERE role = 'judge' GROUP BY family HAVING count(*) > 1)""",
    ),
    "experiment_dag": Query(
        experiment_dag,
        """WITH RECURSIVE p AS (SELECT p_partkey AS name, CASE WHEN p_partkey // 3 > 0 THEN p_partkey // 3 END AS parent FROM part), l AS (SELECT name, parent, 0 AS level FROM p WHERE parent IS NULL UNION ALL SELECT p.name, p.parent, l.level + 1 FROM p JOIN l ON p.parent = l.name)
SELECT p.name, p.parent, l.level FROM p LEFT JOIN l USING (name)""",
    ),
    "holm": Query(
        lambda s, d: S.holm(load(s, d, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("name"), F.when(F.col("o_orderstatus") != "P", F.pow(F.col("o_totalprice") / 600000, F.lit(3.0))).alias("p")), "model", "p").select("model", "name", _R("p"), _R("p_holm"), "significant"),
        """WITH o AS (SELECT o_orderpriority AS model, o_orderkey AS name, CASE WHEN o_orderstatus <> 'P' THEN pow(o_totalprice / 600000, 3.0) END AS p FROM orders), r AS (SELECT *, count(p) OVER (PARTITION BY model) AS m, row_number() OVER (PARTITION BY model, p IS NULL ORDER BY p, name) AS k FROM o),
a AS (SELECT *, CASE WHEN p IS NOT NULL THEN max(least(1.0, (m - k + 1) * p)) OVER (PARTITION BY model, p IS NULL ORDER BY k) END AS h FROM r) SELECT model, name, round(p, 6) AS p, round(h, 6) AS p_holm, h < 0.05 AS significant FROM a""",
    ),
    "spearman_mad": Query(
        lambda s, d: S.spearman(_PAIRED(s, d), "grp", "a", "b").select("grp", "n", _R("rho"), _R("mad")),
        f"WITH r AS (SELECT grp, a, b, {RANKED('a', 'grp')} AS ra, {RANKED('b', 'grp')} AS rb FROM {_PAIRED_SQL}) SELECT grp, count(*) AS n, round(corr(ra, "
        "rb), 6) AS rho, round(avg(abs(a - b)), 6) AS mad FROM r GROUP BY 1",
    ),
    "paired_t_stats": Query(
        lambda s, d: S.paired_t(_PAIRED(s, d), "grp", "a", "b").select("grp", "n", _R("mean_diff"), _R("t"), _R("p"), _R("dz")),
        f"WITH {_T_SQL} SELECT grp, n, round(m, 6) AS mean_diff, round(t, 6) AS t, round({BOTH_SIDES_T('t', 'n - 1')}, 6) AS p, round(m / sd, 6) AS dz FROM t1",
    ),
    "paired_t_interval": Query(lambda s, d: S.paired_t(_PAIRED(s, d), "grp", "a", "b").select("grp", "n", "lo", "hi")),
    "wilcoxon_w": Query(
        lambda s, d: S.wilcoxon(_PAIRED(s, d), "grp", "a", "b").select("grp", "n", "w_plus", "w_minus", _R("z"), _R("p")),
        f"WITH {_W_SQL} SELECT grp, n, w_plus, w_minus, round(z, 6) AS z, round({TAIL_Z('z')}, 6) AS p FROM w2",
    ),
    "sign_counts": Query(
        lambda s, d: S.sign_test(_PAIRED(s, d), "grp", "a", "b").select("grp", "wins", "losses", "ties", _R("rank_biserial"), _R("p")),
        f"WITH {_SIGN_SQL} SELECT grp, wins, losses, ties, round(rb, 6) AS rank_biserial, round(p, 6) AS p FROM s1",
    ),
    "compare_v1": Query(
        lambda s, d: S.compare_v1(_PAIRED(s, d), "grp", "a", "b").select("grp", "n", *[_R(c) for c in ("mean_diff", "t", "p_t", "dz", "lo", "hi")], "w", _R("p_w"), "wins", "losses", _R("rank_biserial"), _R("p_sign")),
        f"""WITH {_T_SQL}, {_W_SQL}, {_SIGN_SQL} SELECT grp, t1.n, round(m, 6) AS mean_diff, round(t, 6) AS t, round({BOTH_SIDES_T('t', 't1.n - 1')}, 6) AS p_t, round(m / sd, 6) AS dz, round(m - 1.984 * sd / sqrt(t1.n), 6) AS lo, round(m + 1.984 * sd / sqrt(t1.n), 6) AS hi,
least(w_plus, w_minus) AS w, round({TAIL_Z('z')}, 6) AS p_w, wins, losses, round(rb, 6) AS rank_biserial, round(s1.p, 6) AS p_sign FROM t1 JOIN w2 USING (grp) JOIN s1 USING (grp)""",
    ),
    "variants_vs_raw": Query(against_raw, _RAW_SQL),
    "calibration_grid": Query(calibration_grid, _CAL_SQL),
    "bootstrap_permutation": Query(
        lambda s, d: S.resample(load(s, d, "gold_checklist").join(load(s, d, "inference_records").where("generated is not null").groupBy("sid").agg(F.avg(F.length("generated").cast("double")).alias("g")), "sid").select("is_normal_case", F.length("gold_text").cast("double").alias("a"), F.col("g").alias("b")), "is_normal_case", "a", "b"),
    ),
    "generations_with_scores": Query(
        with_scores,
        f"WITH {FAST_SQL}, l AS (SELECT sid, arg_max(composite, gen_id) FILTER (WHERE true) AS c0, first(composite ORDER BY gen_id DESC) AS composite, "
        "first(gate ORDER BY gen_id DESC) AS gate FROM fast GROUP BY sid) SELECT r.gen_id, r.sid, l.composite, l.gate FROM inference_records r LEFT "
        "JOIN l USING (sid)",
    ),
    "outputs_with_earlier": Query(
        beside_earlier,
        "WITH x AS (SELECT lower(engine) AS e, sid, max(gen_id) AS g, length(arg_max(generated, gen_id)) AS n FROM inference_records "
        "WHERE sid <> -1 AND generated IS NOT NULL GROUP BY ALL) SELECT a.sid, a.g AS gen_id, a.n, b.g AS earlier, b.n AS n_earlier FROM x a LEFT "
        "JOIN x b ON b.sid = a.sid AND b.e = 'hf' WHERE a.e = 'vllm'",
    ),
}
