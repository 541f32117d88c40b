"""Mixing sources to target shares of tokens by balanced sampling (cube method).

Each source gets a rate, the mean number of times that its documents are used. Its whole part is given to every document;
the fraction is a probability of inclusion that the cube method turns into 0 or 1: the vector of probabilities is moved
along the null space of the balancing equations (sum of tokens, number of documents) until one probability is settled,
again and again (the flight). Documents fly in blocks of bounded size, spread over all executors; each block leaves two
at most, which fly again with those of other blocks, until one block is left per source. Of that, LANDED documents at most
stay on the ground, whose sizes double; they and the two that the last flight leaves are settled at once, as the subset whose
tokens, then number, come closest to what is still wanted.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .bpe import DEFAULT_RANKS, with_counts

MAX_TARGETS = 10_000  # rows of the table of targets, which the driver plans with
LANDED = 18  # documents of a source that are landed, beside the two that its last flight leaves
ROW = "doc_id long, source string, n_tokens long, base int, pi double"


def plan_rates(targets: list[dict], total_tokens: int | None, keep: float) -> tuple[float, list[dict]]:
    """The size of the mix and the rate of each source.

    targets: source, share, repeat, tokens. total_tokens None: the largest mix, of at most all tokens there are, in which
    every source reaches its share that can do so without making the mix smaller than `keep` of all tokens.
    """
    there = sum(t["tokens"] for t in targets)
    shares = sum(t["share"] for t in targets) or 1.0
    for t in targets:
        t["share"] /= shares
    if total_tokens is None:
        reach = [t["tokens"] * t["repeat"] / t["share"] for t in targets if t["share"] > 0]
        total = min([float(there), *(r for r in reach if r >= keep * there)])
    else:
        total = float(total_tokens)
    for t in targets:
        wanted = t["share"] * total
        t["wanted"] = wanted
        t["rate"] = min(float(t["repeat"]), wanted / t["tokens"]) if t["tokens"] else 0.0
        t["in_reach"] = t["tokens"] * t["repeat"] >= wanted * (1 - 1e-9)
    return total, targets


def fly(x: list[float], pi: list[float], rng: random.Random) -> None:
    """Moves pi to 0 and 1, keeping sum(pi) and sum(pi * x), until two at most are left between."""
    eps = 1e-9
    left: list[int] = []
    for k in range(len(pi)):
        if eps < pi[k] < 1 - eps:
            left.append(k)
        else:
            pi[k] = float(round(pi[k]))
            continue
        while len(left) == 3:
            a, b, c = left
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - pi[i]) / w if w > 0 else pi[i] / -w for i, w in zip(left, u) if w)
            down = min(pi[i] / w if w > 0 else (1 - pi[i]) / -w for i, w in zip(left, u) if w)
            step = up if rng.random() * (up + down) < down else -down
            for i, w in zip(left, u):
                pi[i] = min(1.0, max(0.0, pi[i] + step * w))
                if pi[i] < eps or pi[i] > 1 - eps:
                    pi[i] = float(round(pi[i]))
            left = [i for i in left if 0 < pi[i] < 1]


def landing_set(x: list[float], pi: list[float], most: int = LANDED, least: int = 8) -> list[int]:
    """Places of the fractional documents that don't fly, but are landed: the `least` shortest, then each time the longest that is
    no longer than those taken together, until these outweigh any document. Their subsets come close to every sum up to that,
    so whatever the flight leaves, what is wanted lies among them."""
    left = sorted((k for k in range(len(pi)) if 0 < pi[k] < 1), key=lambda k: (x[k], k))
    if len(left) <= least:
        return left
    taken, longest = left[:least], x[left[-1]]
    rest, total = left[least:], sum(x[k] for k in left[:least])
    while rest and total < longest and len(taken) < most:
        at = max(0, bisect_right(rest, total, key=lambda k: x[k]) - 1)
        total += x[rest[at]]
        taken.append(rest.pop(at))
    return taken


def land(x: list[float], pi: list[float]) -> None:
    """Settles the few that are left so that tokens, then documents, differ least from what they should be."""
    open_ = [k for k in range(len(pi)) if 0 < pi[k] < 1]
    want, docs = sum(x[k] * pi[k] for k in open_), sum(pi[k] for k in open_)
    sums, counts = np.zeros(1), np.zeros(1)
    for k in open_:  # of all subsets; the bits of a subset's place say what is in it
        sums, counts = np.concatenate([sums, sums + x[k]]), np.concatenate([counts, counts + 1])
    best = int(np.lexsort((np.abs(counts - docs), np.abs(sums - want)))[0])
    for i, k in enumerate(open_):
        pi[k] = float(best >> i & 1)


def _flight(seed: int, landing: bool):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("doc_id").reset_index(drop=True)
        x, pi = g["n_tokens"].astype(float).tolist(), g["pi"].tolist()
        rng = random.Random(zlib.crc32(repr((seed, *map(str, key))).encode()))
        if landing:
            kept = set(landing_set(x, pi))
            flying = [k for k in range(len(pi)) if k not in kept]
            flown = [pi[k] for k in flying]
            fly([x[k] for k in flying], flown, rng)
            for k, p in zip(flying, flown):
                pi[k] = p
            land(x, pi)
        else:
            fly(x, pi, rng)
        return g.assign(pi=pi)[["doc_id", "source", "n_tokens", "base", "pi"]]

    return run


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, keep: float = 0.25, seed: int = 42, block: int = 20_000, ranks: str = DEFAULT_RANKS) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): doc_id, source, n_tokens, copies of each document used; and the shares reached by source.

    targets: source, target_share, max_repeat. Shares are of all tokens of the mix, and are scaled to a sum of 1. A source
    without documents, or with too few even at max_repeat, falls short (in_reach false) and gives all it has; the others
    keep their proportions. Documents of sources without a target (or null), and those without tokens (null and empty
    texts), are not used. Null shares and repeats count as 0; two targets for one source: the larger share. Repeated
    doc_ids are documents of their own. Empty tables give an empty mix and shares of 0. The result depends on seed alone.
    """
    spark = documents.sparkSession
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeat", F.lit(0))).alias("repeat"))
    sized = materialize(with_counts(documents.select("doc_id", "source", "text"), ranks=ranks), "mix-sizes")
    there = sized.where("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    rows = [r.asDict() for r in t.join(there, "source", "left").na.fill(0, ["docs", "tokens"]).orderBy("source").limit(MAX_TARGETS + 1).collect()]
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    _, rows = plan_rates(rows, total_tokens, keep)
    plan = spark.createDataFrame([(r["source"], r["share"], int(r["repeat"]), int(r["docs"]), int(r["tokens"]), float(r["wanted"]), float(r["rate"]), bool(r["in_reach"]), max(1, math.ceil(r["docs"] / block))) for r in rows], "source string, target_share double, max_repeat int, docs long, tokens long, wanted_tokens double, rate double, in_reach boolean, blocks int")
    base = F.floor(F.col("rate") + 1e-12)
    flying = sized.where("n_tokens > 0").join(plan.where("rate > 0").select("source", "rate", "blocks"), "source")
    flying = flying.select("doc_id", "source", "n_tokens", base.cast("int").alias("base"), F.greatest(F.lit(0.0), F.col("rate") - base).alias("pi"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks").cast("long")).alias("_block"))
    settled = []
    most = max([1, *(math.ceil(r["docs"] / block) for r in rows)])  # blocks of the largest source
    level = 0
    while True:
        last = most <= 1
        out = materialize(flying.groupBy("source", "_block").applyInPandas(_flight(seed + level, last), ROW), "mix-flight")
        if last:
            settled.append(out)
            break
        settled.append(out.where("pi = 0 or pi = 1"))
        # two at most are left of each block; they fly again in blocks of their own
        most, level = math.ceil(2 * most / block), level + 1
        flying = out.where("pi > 0 and pi < 1").withColumn("_block", F.pmod(F.xxhash64("doc_id", F.lit(seed + level)), F.lit(most).cast("long")))
    chosen = settled[0]
    for more in settled[1:]:
        chosen = chosen.unionByName(more)
    chosen = chosen.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("pi").cast("int")).alias("copies")).where("copies > 0")
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("docs_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    shares = plan.drop("blocks").join(used, "source", "left").na.fill(0, ["docs_used", "mix_tokens", "most_copies"])
    total = shares.agg(F.sum("mix_tokens").alias("_all"))
    shares = shares.join(F.broadcast(total)).withColumn("reached_share", F.coalesce(F.try_divide("mix_tokens", "_all"), F.lit(0.0))).drop("_all")  # one row beside a few
    return chosen, shares
