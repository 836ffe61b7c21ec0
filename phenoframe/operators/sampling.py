"""Seeded subsets and splits. Orders come from md5 of "seed:key", so they don't depend on partitions or on arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import seeded_rank


def _smallest(df: DataFrame, label: str) -> DataFrame:
    """(label, _least): the size of the smallest class beside each class."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    return sizes.select(label, F.min("_n").over(Window.partitionBy()).alias("_least"))  # one row a class


def share_of(size: Column, share: float) -> Column:
    """``share`` of a size, to whole rows, half to even. The product is taken to nine decimals first: a half of a decimal share is a half, also where its double lies beside it."""
    return F.bround(F.round(size * share, 9))


def nested_subsets(df: DataFrame, label: str, key: str, fractions: list[float], seed: int, least: int = 8) -> DataFrame:
    """(key, label, fraction): for each fraction the first rows of each class, so smaller subsets lie in larger ones.

    A class gives round(fraction * n) rows (half to even), at least min(``least``, n); a fraction in which a class would have fewer than
    ``least`` rows is left out."""
    r = seeded_rank(df.select(key, label), [label], key, seed)
    take = lambda f: F.greatest(share_of(F.col("_size"), f), F.least(F.lit(least), F.col("_size")))
    chosen = F.array(*[F.struct(F.lit(f).alias("fraction"), take(f).alias("take")) for f in fractions])
    r = r.join(_smallest(df, label), label).filter(F.col("_least") >= least)
    return r.select(key, label, "_rank", F.inline(chosen)).filter(F.col("_rank") <= F.col("take")).select(key, label, "fraction")


def stratified_split(df: DataFrame, label: str, key: str, validation: float, test: float, seed: int) -> DataFrame:
    """Adds ``split``: train, val and test in each class's proportion, or train and val only where the smallest class has under four rows."""
    r = seeded_rank(df, [label], key, seed).join(_smallest(df, label), label)
    cut = F.when(F.col("_least") >= 4, share_of(F.col("_size"), test)).otherwise(F.lit(0))
    place = F.col("_rank")
    split = F.when(place <= cut, "test").when(place <= cut + share_of(F.col("_size"), validation), "val").otherwise("train")
    return r.withColumn("split", split).drop("_rank", "_size", "_least")


def group_split(df: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """Adds ``split``: whole groups go to val, max(1, int(groups * fraction)) of them."""
    groups = df.select(group).distinct().withColumn("_all", F.lit(1))
    ranked = seeded_rank(groups, ["_all"], group, seed)
    val = F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_size") * fraction))
    return df.join(ranked.select(group, F.when(val, "val").otherwise("train").alias("split")), group)


def consistency_sample(labels: DataFrame, present: DataFrame, label: str, key: str, n: int, balanced: bool, seed: int) -> DataFrame:
    """n labelled rows that the data still have: n // 2 of each class, or n of all, with ``place`` in a second seeded order."""
    have = labels.join(present.select(key), key, "left_semi")
    if balanced:
        r = seeded_rank(have, [label], key, seed).filter(F.col("_rank") <= n // 2).drop("_rank", "_size")
    else:
        r = have.orderBy(draw_key(seed, F.col(key)), key).limit(n)
    return seeded_rank(r.withColumn("_all", F.lit(1)), ["_all"], key, seed + 1).withColumnRenamed("_rank", "place").drop("_all", "_size")


def diversify(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """From the best 5 * n rows by ``order``, one of each group a round, groups in the order of their best row; n rows, with ``place``."""
    best = df.orderBy(*order).limit(5 * n)
    one = Window.partitionBy().orderBy(*order)  # 5 * n rows
    g = Window.partitionBy(group)
    r = best.withColumn("_at", F.row_number().over(one)).withColumn("_round", F.row_number().over(g.orderBy("_at"))).withColumn("_first", F.min("_at").over(g))
    r = r.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("_round", "_first")))
    return r.filter(F.col("place") <= n).drop("_at", "_round", "_first")


def restore_split(labels: DataFrame, keys: DataFrame, key: str, split: str) -> DataFrame:
    """The current labels (one row a key) of the given keys under another split, only where it differs."""
    return labels.join(keys.select(key).distinct(), key, "left_semi").filter(F.coalesce(F.col("split") != split, F.lit(True))).withColumn("split", F.lit(split))
