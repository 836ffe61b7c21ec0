"""Aggregations: profiles, scores against controls, summaries, agreement and classifier metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentiles


def profile(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key and feature the mean and the CV (sample deviation / mean, 0 where the mean is 0)."""
    out = []
    for c in columns:
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        out += [F.avg(x).alias(c), F.when(F.avg(x) == 0, F.lit(0.0)).otherwise(F.try_divide(F.stddev_samp(x), F.avg(x))).alias(f"{c}_CV")]
    return df.groupBy(*keys).agg(*out)


def long_form(profiles: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, value)."""
    return profiles.unpivot(keys, columns, "feature", "value")


def sscore(profiles: DataFrame, control: Column, keys: list[str], columns: list[str], run: str | None = None) -> DataFrame:
    """(keys, feature, value, score): z of each profile against the control profiles.

    Pooled over all runs, or with ``run`` against the controls of the own run: a run without controls stays as it is, one with a
    single control takes the pooled deviation. A deviation of 0 counts as 1. Without any control all profiles are standardised."""
    long = long_form(profiles.withColumn("_control", control), [*keys, "_control"], columns)
    c = F.when(F.col("_control"), F.col("value"))
    pooled = long.groupBy("feature").agg(
        F.avg(c).alias("mu"), F.stddev_samp(c).alias("sd"), F.count(c).alias("n"), F.avg("value").alias("mu_all"), F.stddev_pop("value").alias("sd_all")
    )
    x = long.join(pooled, "feature")
    one = lambda s: F.when(F.coalesce(s, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(s)
    mu, sd = F.when(F.col("n") > 0, F.col("mu")).otherwise(F.col("mu_all")), F.when(F.col("n") > 0, F.col("sd")).otherwise(F.col("sd_all"))
    score = (F.col("value") - mu) / one(sd)
    if run:
        w = Window.partitionBy(run, "feature")
        x = x.withColumn("_m", F.avg(c).over(w)).withColumn("_s", F.stddev_samp(c).over(w)).withColumn("_n", F.count(c).over(w))
        own = (F.col("value") - F.col("_m")) / one(F.when(F.col("_n") < 2, F.col("sd")).otherwise(F.col("_s")))
        score = F.when(F.col("n") == 0, score).when(F.col("_n") == 0, F.col("value")).otherwise(own)
    return x.select(*keys, "feature", "value", score.alias("score"))


def summary_table(df: DataFrame, keys: list[str], length: str, width: str, area: str) -> DataFrame:
    wanted = {"length_median": (length, 0.5), "_q1": (length, 0.25), "_q3": (length, 0.75), "width_median": (width, 0.5), "area_median": (area, 0.5)}
    p = percentiles(df, keys, wanted, F.count("*").alias("n"), F.avg(width).alias("width_mean"), F.avg(area).alias("area_mean"))
    rounded = {c: F.bround(c, 3) for c in ("length_median", "width_median", "width_mean", "area_median", "area_mean")}
    p = p.withColumns({**rounded, "length_iqr": F.bround(F.col("_q3") - F.col("_q1"), 3)})
    return p.select(*keys, "n", "length_median", "length_iqr", "width_median", "width_mean", "area_median", "area_mean")


def variation(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """n, mean, median, std, p5, p95, mad, cv, robust_cv and dynamic_range per key."""
    wanted = {"median": (column, 0.5), "p5": (column, 0.05), "p95": (column, 0.95)}
    base = percentiles(df, keys, wanted, F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    return base.join(deviations(df, column, keys, base), keys).withColumns({
        "cv": F.try_divide(F.col("std"), F.col("mean")), "robust_cv": F.try_divide(F.col("mad"), F.col("median")),
        "dynamic_range": F.col("p95") / F.greatest(F.col("p5"), F.lit(1e-9)),
    })


def deviations(df: DataFrame, column: str, keys: list[str], medians: DataFrame) -> DataFrame:
    """(keys, mad): the median absolute deviation from the ``median`` of each key."""
    away = df.select(*keys, column).join(medians.select(*keys, "median"), keys).select(*keys, F.abs(F.col(column) - F.col("median")).alias("_away"))
    return percentiles(away, keys, {"mad": ("_away", 0.5)})


def robust_sigma(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """1.4826 times the median absolute deviation."""
    medians = percentiles(df, keys, {"median": (column, 0.5)})
    return deviations(df, column, keys, medians).select(*keys, (F.lit(1.4826) * F.col("mad")).alias("sigma"))


def embedding_profiles(df: DataFrame, key: str, vector: str, centred: bool = True) -> DataFrame:
    """(key, dim, value): mean vector of each condition, less the mean of all cells if ``centred``.

    Sums of vectors are combined inside tasks; the long form has one row per condition and dimension."""
    long = df.select(key, F.posexplode(vector).alias("dim", "x"))
    sums = long.groupBy(key, "dim").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("x").alias("n"))
    mean = F.col("s") / F.col("n")
    if centred:
        whole = sums.groupBy("dim").agg((F.sum("s") / F.sum("n")).alias("all"))
        return sums.join(whole, "dim").select(key, "dim", (mean - F.col("all")).alias("value"))
    return sums.select(key, "dim", mean.alias("value"))


#: Fixed value: what the first word of a control's label looks like.
CONTROL = r"^(?i:NT|WT|DMSO|CTRL|UNT)[0-9]*$"


def control_relative(profiles: DataFrame, key: str) -> DataFrame:
    """(key, dim, value) less the mean over the control profiles of each dimension; without any control there are no rows.

    Controls are told by the first word of their label. Profiles count alike, however many cells they have."""
    control = F.split(F.trim(key), r"\s+")[0].rlike(CONTROL)
    anchor = profiles.filter(control).groupBy("dim").agg(F.avg("value").alias("_a"))  # one row a dimension
    return profiles.join(anchor, "dim").select(key, "dim", (F.col("value") - F.col("_a")).alias("value"))


def label_counts(df: DataFrame, split: str, label: str) -> DataFrame:
    """Counts per split and label and overall (split null); a split other than test counts as train."""
    known = df.withColumn("split", F.when(F.col(split) == "test", "test").otherwise("train"))
    return known.rollup(F.col(label).alias("label"), "split").agg(F.count("*").alias("n")).filter("label IS NOT NULL")


def binary_metrics(df: DataFrame, y: str, p: str, keys: list[str]) -> DataFrame:
    """Confusion at P >= 0.5, accuracy, balanced accuracy and majority baseline per key."""
    t, good = F.col(y) == 1, F.col(p) >= 0.5
    out = df.groupBy(*keys).agg(
        F.count_if(~t & ~good).alias("tn"), F.count_if(~t & good).alias("fp"), F.count_if(t & ~good).alias("fn"), F.count_if(t & good).alias("tp")
    )
    n = F.expr("tn + fp + fn + tp")
    return out.withColumns({
        "accuracy": F.try_divide(F.expr("tp + tn"), n),
        "balanced_accuracy": (F.try_divide(F.col("tp"), F.expr("tp + fn")) + F.try_divide(F.col("tn"), F.expr("tn + fp"))) / 2,
        "majority_baseline": F.try_divide(F.greatest(F.expr("tp + fn"), F.expr("tn + fp")), n),
    })


def class_balance(df: DataFrame, y: str, keys: list[str]) -> DataFrame:
    """(keys, n_bad, n_good, single_class): rows of label 0 and 1, and whether an evaluation sees one class only."""
    c = df.groupBy(*keys).agg(F.count_if(F.col(y) == 0).alias("n_bad"), F.count_if(F.col(y) == 1).alias("n_good"))
    return c.withColumn("single_class", (F.col("n_bad") == 0) | (F.col("n_good") == 0))


def flips(df: DataFrame, a: str, b: str, names: list) -> DataFrame:
    """(label, again, n) for all pairs of ``names``: how rows of one label were labelled again; rows with another label on either side have no part."""
    counts = df.filter(F.col(a).isin(names) & F.col(b).isin(names)).groupBy(F.col(a).alias("label"), F.col(b).alias("again")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(x, y) for x in names for y in names], counts.drop("n").schema)  # as many rows as pairs of labels
    return every.join(counts, ["label", "again"], "left").fillna(0, ["n"])


def disagreements(df: DataFrame, a: str, b: str, row: str) -> DataFrame:
    """(row, a, b) of rows with both labels where they differ."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(row, a, b)


#: The upper ends of Cohen's kappa bands.
BANDS = ((0.0, "poor"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agree, raw_agreement, kappa and band of two binary ratings (0/1)."""
    x, y = F.col(a) == 1, F.col(b) == 1
    c = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(x == y).alias("agree"), F.count_if(x).alias("a1"), F.count_if(y).alias("b1")
    )
    n = F.col("n").cast("double")
    by_chance = (F.col("a1") * F.col("b1") + (n - F.col("a1")) * (n - F.col("b1"))) / (n * n)
    raw = F.col("agree") / n
    kappa = F.when(by_chance == 1, F.lit(1.0)).otherwise(F.try_divide(raw - by_chance, 1 - by_chance))
    band = F.lit("almost perfect")
    for end, name in reversed(BANDS):
        band = F.when(F.col("kappa") <= end, name).otherwise(band)
    return c.select("n", "agree", raw.alias("raw_agreement"), kappa.alias("kappa")).withColumn("band", band)
