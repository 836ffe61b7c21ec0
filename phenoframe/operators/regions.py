"""Matching of two segmentations by their pixels, splits and merges, and labels at points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, image: list[str]) -> DataFrame:
    """(image, la, lb, inter, na, nb) of labelled pixels (image, y, x, label; 0 is background)."""
    x, y = (f.filter("label > 0").select(*image, "y", "x", F.col("label").alias(n)) for f, n in ((a, "la"), (b, "lb")))
    inter = x.join(y, [*image, "y", "x"]).groupBy(*image, "la", "lb").agg(F.count("*").alias("inter"))
    na, nb = x.groupBy(*image, "la").agg(F.count("*").alias("na")), y.groupBy(*image, "lb").agg(F.count("*").alias("nb"))
    return inter.join(na, [*image, "la"]).join(nb, [*image, "lb"])


def match_regions(pairs: DataFrame, image: list[str], least: float = 0.5) -> DataFrame:
    """One-to-one pairs of an IoU of ``least`` or more. Above 0.5 at most one partner is possible; at exactly 0.5 the best, then the smallest label, is taken on both sides."""
    iou = pairs.withColumn("iou", F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).filter(F.col("iou") >= least)
    for side, other in (("la", "lb"), ("lb", "la")):
        w = Window.partitionBy(*image, side).orderBy(F.desc("iou"), other)
        iou = iou.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return iou.select(*image, "la", "lb", "iou")


def unmatched(regions: DataFrame, matches: DataFrame, image: list[str], side: str) -> DataFrame:
    """(image, label) of the regions of a segmentation's pixels (image, label) that no match has on its ``side`` (la or lb)."""
    own = regions.filter("label > 0").select(*image, "label").distinct()
    return own.join(matches.select(*image, F.col(side).alias("label")), [*image, "label"], "left_anti")


def splits_merges(pairs: DataFrame, image: list[str], share: float = 0.5) -> DataFrame:
    """(image, splits, merges): regions of a (of b) that hold two or more regions of the other, each with ``share`` of itself inside."""
    split = pairs.filter(F.col("inter") >= share * F.col("nb")).groupBy(*image, "la").agg(F.count("*").alias("_n")).filter("_n > 1").groupBy(*image).agg(F.count("*").alias("splits"))
    merge = pairs.filter(F.col("inter") >= share * F.col("na")).groupBy(*image, "lb").agg(F.count("*").alias("_n")).filter("_n > 1").groupBy(*image).agg(F.count("*").alias("merges"))
    return split.join(merge, image, "full").fillna(0, ["splits", "merges"])


def label_at(points: DataFrame, px: DataFrame, image: list[str]) -> DataFrame:
    """Adds the label of the pixel at the rounded place (half to even), 0 outside."""
    at = points.withColumn("_y", F.bround("y").cast("int")).withColumn("_x", F.bround("x").cast("int"))
    grid = px.select(*image, F.col("y").cast("int").alias("_y"), F.col("x").cast("int").alias("_x"), "label")
    return at.join(grid, [*image, "_y", "_x"], "left").withColumn("label", F.coalesce("label", F.lit(0))).drop("_y", "_x")
