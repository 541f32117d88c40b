"""Judges' answers: asked for again until they can be read; prompts told apart by fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hygiene as H
from ..session import materialize

#: Families by a part of a model's name, and how often an answer is asked for.
FAMILIES = ("llama", "qwen", "gemma")
ATTEMPTS = 3


def family(model: Column) -> Column:
    out = F.lit("other")
    for k in reversed(FAMILIES):
        out = F.when(F.contains(F.lower(model), F.lit(k)), k).otherwise(out)
    return out


def ask_until_read(pending: DataFrame, key: str, ask: Callable[[DataFrame, int], DataFrame], attempts: int = ATTEMPTS, want: str = "obj") -> DataFrame:
    """key, attempt, parsed: the first answer to each key that holds JSON; null for those that never could be read.

    ask(pending, attempt) gives key and answer. Each attempt is about the keys that are left, and is written down, since an
    answer may cost much and must not be asked for twice.
    """
    done: DataFrame | None = None
    left = pending.select(key)
    for k in range(attempts):
        said = materialize(ask(left, k).select(key, H.first_json(F.col("answer"), want).alias("parsed")), "answers").where("parsed is not null").withColumn("attempt", F.lit(k))
        left = left.join(said, key, "left_anti")
        done = said if done is None else done.unionByName(said)
    return pending.select(key).join(done, key, "left").select(key, "attempt", "parsed")


def fingerprints(parts: DataFrame, name: str, order: str, text: str, buckets: int = 1024) -> DataFrame:
    """name, digest: 12 digits of a SHA-1 over the texts of each name in order (an integer), by buckets of the order."""
    x = parts.groupBy(name, F.pmod(order, F.lit(buckets)).alias("b")).agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.sha1(text).alias("h")))), lambda p: p["h"]), ",")).alias("h"))
    return x.groupBy(name).agg(F.substring(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda p: p["h"]), ",")), 1, 12).alias("digest"))


def changed(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """name, state: same, changed, added or removed between two tables of name and digest."""
    x = old.withColumnRenamed("digest", "_a").join(new.withColumnRenamed("digest", "_b"), name, "full")
    return x.select(name, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same").alias("state"))


def assert_same(old: DataFrame, new: DataFrame, name: str = "name") -> None:
    bad = changed(old, new, name).where("state <> 'same'")
    if n := bad.count():
        raise ValueError(f"{n} prompts differ, such as {[tuple(r) for r in bad.limit(5).collect()]}")
