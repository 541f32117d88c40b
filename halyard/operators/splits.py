"""Deterministic splits, leak checks and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize


def order_key(c: Column, seed: int = 42) -> Column:
    """A pseudo-random order that is the same in every engine with SHA-1."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def split_in_two(keys: DataFrame, key: str, first: int, seed: int = 42) -> DataFrame:
    """key, part: `few` for the `first` keys in pseudo-random order, `rest` for the others.

    The rank is global, so it is taken by a limit over the order (top k) and a join, not by one window over all keys.
    """
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct()
    few = distinct.orderBy(order_key(F.col(key), seed), key).limit(first).select(key, F.lit("few").alias("part"))
    return distinct.join(few, key, "left").select(key, F.coalesce("part", F.lit("rest")).alias("part"))


def stratified(cases: DataFrame, key: str, stratum: str, take: int, seed: int = 42) -> DataFrame:
    """key, stratum, picked: `take` cases, of the stratum that is true in proportion, rounded half to even, the rest of the others.

    stratum is a boolean; null counts as false. Fewer are picked where a stratum has too few. The picked of a stratum are the
    first in pseudo-random order, taken by a limit over the order and not by a window over the stratum.
    """
    x = cases.select(key, F.coalesce(F.col(stratum), F.lit(False)).alias(stratum))
    n = x.agg(F.count(F.lit(1)).alias("n"), F.count_if(stratum).alias("of")).first()
    first = min(round(take * n["of"] / max(1, n["n"])), n["of"])
    quota = {True: first, False: min(take - first, n["n"] - n["of"])}
    top = lambda which: x.where(F.col(stratum) == which).orderBy(order_key(F.col(key), seed), key).limit(quota[which]).select(key)
    picked = top(True).unionByName(top(False)).withColumn("picked", F.lit(True))
    return x.join(picked, key, "left").select(key, stratum, F.coalesce("picked", F.lit(False)).alias("picked"))


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """df with the place of each row in an order, from 0. Rows are sorted by ranges and numbered within them, so that no task
    holds all; the ranges' sizes are added up."""
    x = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    x = materialize(x.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(*order))), "numbered")
    sizes = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    return x.join(before, "_part").withColumn(name, F.col("_before") + F.col("_k") - 1).drop("_part", "_k", "_before")


def zip_by_position(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Rows of a and b (columns with _a and _b behind their names) side by side by their place in the order; an error if one has
    more rows."""
    na, nb = a.count(), b.count()
    if na != nb:
        raise ValueError(f"{na} and {nb} rows can't be put side by side")
    side = lambda df, s: numbered(df, order).select("position", *[F.col(c).alias(f"{c}_{s}") for c in df.columns])
    return side(a, "a").join(side(b, "b"), "position")


def require_sids(df: DataFrame, what: str, key: str = "sid") -> DataFrame:
    """The different keys of df; an error if any could not be read (null or -1)."""
    if bad := df.where(F.col(key).isNull() | (F.col(key) == -1)).count():
        raise ValueError(f"{what}: {bad} rows without {key}")
    return df.select(key).distinct()


def strict_join(rows: DataFrame, other: DataFrame, key: str, what: str) -> DataFrame:
    """The inner join by key; an error that names some of them if a row's key is missing in the other table."""
    lost = rows.join(other.select(key).distinct(), key, "left_anti").select(key).distinct()
    if n := lost.count():
        raise ValueError(f"{what}: {n} keys missing, such as {[r[0] for r in lost.limit(5).collect()]}")
    return rows.join(other, key)


def unsealed(split: str, allowed: bool, sealed: tuple[str, ...] = ("gold",)) -> str:
    """The split's name, unless it is sealed and was not asked for on purpose."""
    if split in sealed and not allowed:
        raise PermissionError(f"split {split} is sealed")
    return split


def draw(rows: DataFrame, bank: DataFrame, key: str, item: str, take: int, seed: int = 42, digits: int = 2) -> DataFrame:
    """key, item, k: for each of rows `take` different items of the whole bank, or all if it has fewer, in an order of its own.

    The bank's items are numbered in pseudo-random order, by buckets of the order's first hexadecimal digits; the drawn
    numbers are joined by equality. key and item must be unique.
    """
    bank = bank.select(item).withColumn("_order", order_key(F.col(item), seed)).withColumn("_b", F.substring("_order", 1, digits))
    sizes = bank.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    first = sizes.select("_b", (F.sum("_c").over(W.orderBy("_b")) - F.col("_c")).alias("_first"))  # a row for each bucket
    place = F.row_number().over(W.partitionBy("_b").orderBy("_order", item)) - 1
    bank = bank.withColumn("_place", place).join(first, "_b").select(item, (F.col("_first") + F.col("_place")).alias("_at"))
    x = rows.select(key).join(F.broadcast(sizes.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"))))  # one row
    for k in range(take):
        # one of the numbers that are left: those drawn before are stepped over
        number = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(key), F.lit(k))), 1, 15), 16, 10).cast("long")
        at = F.pmod(number, F.greatest(F.col("_n") - k, F.lit(1)))
        if k:
            at = F.aggregate(F.array_sort(F.array(*[f"_at{j}" for j in range(k)])), at, lambda a, before: a + (a >= before).cast("long"))
        x = x.withColumn(f"_at{k}", at)
    drawn = x.select(key, "_n", F.posexplode(F.array(*[f"_at{k}" for k in range(take)])).alias("_k", "_at")).where("_k < _n")
    return drawn.join(bank, "_at").select(key, item, (F.col("_k") + 1).alias("k"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys that both have; a leak check raises if there are any, see assert_disjoint."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key).distinct(), key, "left_semi")


def assert_disjoint(a: DataFrame, b: DataFrame, key: str, what: str) -> None:
    shared = overlap(a, b, key)
    if (n := shared.count()) > 0:
        raise ValueError(f"{what}: {n} keys in both, such as {[r[0] for r in shared.limit(5).collect()]}")


def fingerprint(df: DataFrame, group: str, key: str, buckets: int = 1024) -> DataFrame:
    """group, n, digest: 16 digits of a SHA-1 over the digests of buckets (key modulo) of the sorted keys, so that no task holds
    a whole group. Keys are integers; null keys take no part."""
    bucket = F.pmod(F.col(key), F.lit(buckets)).alias("b")
    parts = df.where(F.col(key).isNotNull()).select(group, key).distinct().groupBy(group, bucket).agg(
        F.count(F.lit(1)).alias("n"), F.sha1(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("long"))), ",")).alias("h")
    )
    return parts.groupBy(group).agg(F.sum("n").alias("n"), F.substring(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ",")), 1, 16).alias("digest"))
