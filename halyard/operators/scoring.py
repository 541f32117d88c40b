"""Scores of generated text on three axes. A score is a number, unknown (null) or excluded; none of them is another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WEIGHTS = (0.5, 0.3, 0.2)  # fixed values: coverage, faithfulness, brevity
SCORE = "coverage double, faithfulness double, brevity double, composite double, gate string, excluded boolean, exclude_reason string"


def points(status: Column) -> Column:
    """yes 1, partial 0.5, no 0; null for any other verdict."""
    s = F.lower(status)
    return F.when(s == "yes", 1.0).when(s == "partial", 0.5).when(s == "no", 0.0)


def coverage(items: DataFrame, verdicts: DataFrame, case: str = "case", item: str = "item", status: str = "status") -> DataFrame:
    """case, coverage, failed: the mean of the points of a case's items; a missing or unknown verdict fails the case.

    Of several verdicts on an item the last (by `ord`) counts; verdicts on unknown items are left out.
    """
    last = verdicts.groupBy(case, item).agg(F.max_by(F.lower(status), "ord").alias("s"))
    x = items.select(case, item).distinct().join(last, [case, item], "left")
    point = points(F.col("s"))
    g = x.groupBy(case).agg(F.count(F.lit(1)).alias("n"), F.count(point).alias("known"), F.sum(point).alias("points"))
    return g.select(case, F.when(F.col("known") == F.col("n"), F.col("points") / F.col("n")).alias("coverage"), (F.col("known") < F.col("n")).alias("failed"))


def coverage_v2(items: DataFrame, verdicts: DataFrame, case: str = "case", item: str = "item", status: str = "status") -> DataFrame:
    """case, coverage: version 2, in which a missing or unknown verdict is a no, and nothing fails."""
    last = verdicts.groupBy(case, item).agg(F.max_by(F.lower(status), "ord").alias("s"))
    x = items.select(case, item).distinct().join(last, [case, item], "left")
    return x.groupBy(case).agg(F.avg(F.coalesce(points(F.col("s")), F.lit(0.0))).alias("coverage"))


def category_coverage(verdicts: DataFrame, case: str = "case") -> DataFrame:
    """case, category, n, score, missed: of each category but `other` its mean points and the items that have none.

    verdicts: case, item, category, p (points).
    """
    x = verdicts.where("category <> 'other'")
    return x.groupBy(case, "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("score"), F.sort_array(F.collect_list(F.when(F.col("p") == 0, F.col("item")))).alias("missed")
    )


def faithfulness(verdicts: Column) -> Column:
    """Share of `supported` among an array of verdicts on claims; other verdicts count as claims; null without claims."""
    supported = F.size(F.filter(verdicts, lambda v: F.lower(v) == "supported"))
    return F.when(F.size(verdicts) > 0, supported / F.size(verdicts))


def brevity(score: Column) -> Column:
    """1 to 5, clamped, as 0 to 1; text that is no number is unknown."""
    n = score.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), (F.least(F.greatest(n, F.lit(1.0)), F.lit(5.0)) - 1) / 4)


def composite(cov: Column, faith: Column, brev: Column, has_items: Column) -> Column:
    """The weighted mean; without items that of the other two axes; null if a needed axis is."""
    a, b, c = WEIGHTS
    return F.when(has_items, a * cov + b * faith + c * brev).otherwise((b * faith + c * brev) / (b + c))


def judged(cov: Column, faith: Column, brev: Column, has_items: Column) -> Column:
    """The score of a case from three axes: excluded, with the axes that failed, if one that is needed is unknown."""
    failed = F.array_compact(F.array(F.when(has_items & cov.isNull(), "coverage"), F.when(faith.isNull(), "faithfulness"), F.when(brev.isNull(), "brevity")))
    bad = F.size(failed) > 0
    why = F.when(bad, F.concat(F.lit("judge_failed("), F.array_join(failed, "; "), F.lit(")")))
    return _score(F.when(has_items, cov), faith, brev, F.when(~bad, F.round(composite(cov, faith, brev, has_items), 4)), F.lit(""), bad, why)


def _score(cov, faith, brev, comp, gate, excluded, why) -> Column:
    values = (cov, faith, brev, comp, gate, excluded, why)
    return F.struct(*[v.cast(k.split()[1]).alias(k.split()[0]) for v, k in zip(values, SCORE.split(", "))])


def _fixed(cov=None, faith=None, brev=None, comp=None, gate="", why=None) -> Column:
    return _score(*map(F.lit, (cov, faith, brev, comp, gate, why is not None, why)))


def fast_score(status: Column, source: Column, has_items: Column, normal: Column, no_issue: Column) -> Column:
    """The score of a case that needs no judge, null for the others; the first that holds of:

    a generation that failed (0, degenerate), a case without gold or whose checklist failed (excluded), a normal case that is
    called so (1), one with findings that is called normal (0, missed_abnormal, brevity unknown).
    """
    return (
        F.when(F.coalesce(F.lower(status), F.lit("")) != "ok", _fixed(0.0, 0.0, 0.0, 0.0, "degenerate")).when(source == "no_gold", _fixed(why="no_gold")).when(source == "gold_failed", _fixed(why="checklist_extract_failed"))
        .when(normal & no_issue, _fixed(1.0, 1.0, 1.0, 1.0)).when(has_items & ~normal & no_issue, _fixed(0.0, 0.0, None, 0.0, "missed_abnormal"))
    )


def fast_score_dev(status: Column, no_issue: Column) -> Column:
    """The same where there is no gold: failed generations count 0 without coverage, and "no issue" can't be judged."""
    return F.when(F.coalesce(F.lower(status), F.lit("")) != "ok", _fixed(None, 0.0, 0.0, 0.0, "degenerate")).when(no_issue, _fixed(why="dev_no_issue"))


def fast_path(status: Column, has_items: Column, normal: Column, no_issue: Column) -> Column:
    """gate of the cases that need no judge: degenerate, no_gold, normal_ok, missed_abnormal; null for the others."""
    return (
        F.when(F.coalesce(F.lower(status), F.lit("")) != "ok", "degenerate").when(has_items.isNull(), "no_gold").when(normal & no_issue, "normal_ok")
        .when(has_items & ~normal & no_issue, "missed_abnormal")
    )


def official(judged_by: DataFrame, case: str = "case", judges: tuple[str, ...] | None = None, places: int = 4) -> DataFrame:
    """case, excluded, reasons, coverage, faithfulness, brevity, composite, gate, judges: one score of those of all judges.

    judged_by: case, judge, ord and the fields of a score. If a judge excludes the case it is excluded, with each reason;
    else fields are means of what is known, rounded to `places`, and the gate is the first judge's (by ord).
    """
    x = judged_by if judges is None else judged_by.where(F.col("judge").isin(*judges))
    axes = ("coverage", "faithfulness", "brevity", "composite")
    out = F.coalesce(F.bool_or("excluded"), F.lit(False))
    reasons = F.sort_array(F.collect_list(F.when(F.col("excluded"), F.concat("judge", F.lit("="), F.coalesce("exclude_reason", F.lit(""))))))
    g = x.groupBy(case).agg(out.alias("excluded"), F.array_join(reasons, ",").alias("reasons"), *[F.round(F.avg(a), places).alias(a) for a in axes], F.min_by("gate", "ord").alias("gate"), F.count(F.lit(1)).alias("judges"))
    kept = lambda c: F.when(~F.col("excluded"), F.col(c)).alias(c)
    return g.select(case, "excluded", "reasons", *map(kept, (*axes, "gate")), "judges")


def composite_v2(cov: Column, faith: Column, brev: Column) -> Column:
    """Version 2: unknown coverage counts 0, unknown faithfulness and brevity a half."""
    a, b, c = WEIGHTS
    return F.round(a * F.coalesce(cov, F.lit(0.0)) + b * F.coalesce(faith, F.lit(0.5)) + c * F.coalesce(brev, F.lit(0.5)), 4)


def score_v2(status: Column, has_gold: Column, normal: Column, no_issue: Column, cov: Column, faith: Column, brev: Column) -> Column:
    """Version 2's composite of a case: 0 for a failed generation, 1 for a normal case called so, without gold the mean of the
    other two axes by weight, else as composite_v2."""
    _, b, c = WEIGHTS
    without = F.round((b * F.coalesce(faith, F.lit(0.5)) + c * F.coalesce(brev, F.lit(0.5))) / (b + c), 4)
    return F.when(status != "ok", 0.0).when(has_gold & normal & no_issue, 1.0).when(~has_gold, without).otherwise(composite_v2(cov, faith, brev))


def sum_v1(text: Column, raw: Column, brev: Column, critical: Column, failed: str) -> Column:
    """Version 1's sum of two scores of 1 to 5; a generation that failed has 1 and 1."""
    lost = text.isin(failed, "특이사항 없음") & (F.length(raw) < 5)
    return F.when(lost, 2.0).otherwise(brev + critical)


def expectation(logits: Column) -> Column:
    """The mean of 1, 2, ... under the softmax of an array of logits, to four places; null for an empty array."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.round(F.try_divide(F.aggregate(F.zip_with(weights, F.sequence(F.lit(1), F.size(logits)), lambda w, k: w * k), F.lit(0.0), lambda a, x: a + x), total), 4)


def debiased(first: Column, second: Column) -> Column:
    """Probability that A is better, from the judgement of A before B and that of B before A."""
    return (first + (1 - second)) / 2


def simpo(chosen: Column, rejected: Column, beta: float = 2.0, ratio: float = 0.25, smoothing: float = 0.0, kind: str = "sigmoid") -> Column:
    """struct of loss, chosen and rejected reward, margin and right of a preference pair, from mean log-probabilities; ratio is
    the target margin over beta."""
    z = beta * (chosen - rejected - ratio)
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))  # noqa: E731  -log sigmoid(-x), without overflow
    loss = softplus(-z) * (1 - smoothing) + softplus(z) * smoothing if kind == "sigmoid" else F.greatest(F.lit(0.0), 1 - z)
    return F.struct(loss.alias("loss"), (beta * chosen).alias("chosen_reward"), (beta * rejected).alias("rejected_reward"), (beta * (chosen - rejected)).alias("margin"), (chosen > rejected).alias("right"))
