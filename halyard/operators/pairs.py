"""Candidates of one prompt: totals, preference pairs, and the best of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import hygiene as H

MARGIN = 2.0  # fixed value


def totals(scores: DataFrame) -> DataFrame:
    """row_idx, ord, cov, fid, total of candidates that both rubrics have scored: twice the coverage and the fidelity.

    scores: row_idx, ord (candidate), rubric (cov or fid), score. A score that could not be read is null and leaves its
    candidate out.
    """
    of = lambda name: F.max(F.when(F.col("rubric") == name, F.col("score"))).alias(name)
    return scores.groupBy("row_idx", "ord").agg(of("cov"), of("fid")).where("cov is not null and fid is not null").withColumn("total", 2.0 * F.col("cov") + F.col("fid"))


def select_pairs(candidates: DataFrame, margin: float = MARGIN) -> DataFrame:
    """row_idx, n, outcome, chosen, rejected, margin: the best and the worst candidate (row_idx, ord, txt, total) of each row.

    outcome: too_few (under two), identical (but for case and blanks), no_margin, or kept. Of equal totals the first (by
    ord) is the best and the last the worst, as a stable sort leaves them. Only two candidates of a row are kept at a time.
    """
    x = candidates.groupBy("row_idx").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("total", (-F.col("ord")).alias("o"), "txt")).alias("best"), F.min(F.struct("total", (-F.col("ord")).alias("o"), "txt")).alias("worst")
    )
    apart = F.col("best.total") - F.col("worst.total")
    why = F.when(F.col("n") < 2, "too_few").when(H.squeeze(F.col("best.txt")) == H.squeeze(F.col("worst.txt")), "identical").when(apart < margin, "no_margin").otherwise("kept")
    x = x.withColumn("outcome", why)
    kept = lambda c, name: F.when(F.col("outcome") == "kept", c).alias(name)
    return x.select("row_idx", "n", "outcome", kept(F.col("best.txt"), "chosen"), kept(F.col("worst.txt"), "rejected"), kept(F.round(apart, 2), "margin"))


def chosen_rejected_v1(candidates: DataFrame, seed: int = 42) -> DataFrame:
    """row_idx, chosen, rejected (their ord): the first of the best, and one of the worst by a hash; rows with one are left out."""
    draw = F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("row_idx").cast("string"), F.col("ord").cast("string")))
    x = candidates.groupBy("row_idx").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("total", (-F.col("ord")).alias("o"))).alias("best"), F.min(F.struct("total", draw.alias("d"), "ord")).alias("worst"))
    return x.where("n >= 2").select("row_idx", (-F.col("best.o")).alias("chosen"), F.col("worst.ord").alias("rejected"))
