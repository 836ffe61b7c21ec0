"""Measures around points of an image, and statistics of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles


def around(px: DataFrame, sites: DataFrame, image: list[str], half: int) -> DataFrame:
    """Site rows (image, site, y, x) with the pixels of the square of ``half`` around each: dy, dx, value. A site fans out to (2 * half + 1)^2 rows."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    s = sites.select(*image, "site", F.col("y").alias("_sy"), F.col("x").alias("_sx")).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    s = s.select(*image, "site", (F.col("_sy") + F.col("dy")).alias("y"), (F.col("_sx") + F.col("dx")).alias("x"), "dy", "dx")
    return s.join(px.select(*image, "y", "x", F.col("value").cast("double").alias("value")), [*image, "y", "x"])


def _median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def peak_amplitude(px: DataFrame, sites: DataFrame, image: list[str], half: int = 8, core: int = 2) -> DataFrame:
    """(image, site, amplitude): the 3 x 3 maximum less the median of the square ring outside the core; null where the square leaves the image."""
    v, far = F.col("value"), F.greatest(F.abs("dy"), F.abs("dx"))
    a = around(px, sites, image, half).groupBy(*image, "site").agg((F.max(F.when(far <= 1, v)) - _median(F.when(far > core, v))).alias("a"), F.count("*").alias("n"))
    found = a.select(*image, "site", F.when(F.col("n") == (2 * half + 1) ** 2, F.col("a")).alias("amplitude"))
    return sites.select(*image, "site").join(found, [*image, "site"], "left")


def annulus_snr(px: DataFrame, sites: DataFrame, image: list[str], sigma: float) -> DataFrame:
    """(image, site, snr): (value at the site - median) / deviation of the ring from 2 to 4 sigma; 0 with fewer than eight pixels or a flat ring."""
    v, d2 = F.col("value"), F.col("dy") ** 2 + F.col("dx") ** 2
    ring = F.when((d2 >= 4 * sigma**2) & (d2 <= 16 * sigma**2), v)
    s = around(px, sites, image, int(4 * sigma + 0.999)).groupBy(*image, "site").agg(
        F.max(F.when(d2 == 0, v)).alias("peak"), _median(ring).alias("m"), F.stddev_pop(ring).alias("s"), F.count(ring).alias("n")
    )
    found = s.select(*image, "site", F.when((F.col("n") >= 8) & (F.col("s") > 1e-12), (F.col("peak") - F.col("m")) / F.col("s")).otherwise(F.lit(0.0)).alias("snr"))
    return sites.select(*image, "site").join(found, [*image, "site"], "left").fillna(0.0, ["snr"])


def patch_snr(px: DataFrame, sites: DataFrame, image: list[str], half: int, core: int = 2) -> DataFrame:
    """(image, site, snr): (value at the site - median) / deviation of the patch's pixels farther than ``core``; 0 with fewer than four of them or where they are flat."""
    v, d2 = F.col("value"), F.col("dy") ** 2 + F.col("dx") ** 2
    far = F.when(d2 > core**2, v)
    s = around(px, sites, image, half).groupBy(*image, "site").agg(F.max(F.when(d2 == 0, v)).alias("peak"), _median(far).alias("m"), F.stddev_pop(far).alias("s"), F.count(far).alias("n"))
    found = s.select(*image, "site", F.when((F.col("n") >= 4) & (F.col("s") >= 1e-9), (F.col("peak") - F.col("m")) / F.col("s")).otherwise(F.lit(0.0)).alias("snr"))
    return sites.select(*image, "site").join(found, [*image, "site"], "left").fillna(0.0, ["snr"])


def channel_stats(px: DataFrame, channel: list[str]) -> DataFrame:
    """Per channel mean, std, skew (0 where undefined) and the share of pixels within max(5 % of the median, 1) of it. No task holds a channel's pixels."""
    x = px.withColumn("_v", F.col("value").cast("double"))
    v = F.col("_v")
    base = percentiles(x, channel, {"_m": ("_v", 0.5)}, F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.coalesce(F.nanvl(F.skewness(v), F.lit(0.0)), F.lit(0.0)).alias("skew"))
    near = F.abs(v - F.col("_m")) <= F.greatest(0.05 * F.abs("_m"), F.lit(1.0))
    share = x.join(base.select(*channel, "_m"), channel).groupBy(*channel).agg(F.avg(near.cast("double")).alias("near_background"))
    return base.drop("_m").join(share, channel)


def pick_phase(stats: DataFrame, source: list[str], channel: str) -> DataFrame:
    """(source, channel): the channel of the least mean absolute skew over a source's scenes, to one decimal; then the larger mean share near the background, then
    the lower channel. ``stats`` has a row for each scene and channel."""
    over = stats.groupBy(*source, channel).agg(F.avg(F.abs("skew")).alias("_skew"), F.avg("near_background").alias("_near"))
    return over.groupBy(*source).agg(F.min_by(channel, F.struct(F.bround("_skew", 1), -F.col("_near"), channel)).alias(channel))
