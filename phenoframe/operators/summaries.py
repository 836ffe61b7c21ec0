"""Group summaries: histograms, anchors, merges, weights, coverage, regions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import strip_replicate
from ..worktable import materialize
from .quantiles import percentiles

#: Regions up to which their keys are broadcast.
FEW = 100_000


def log_histogram(df: DataFrame, column: str, keys: list[str], bins: int = 49) -> DataFrame:
    """(keys, bin, share): counts over equal steps of log10 from the least p5 / 1.1 to the largest p95 * 1.1 (each 1 at least), over the group's largest count.

    Values outside are left out and the last bin is closed; empty bins give no row."""
    p = percentiles(df, keys, {"p5": (column, 0.05), "p95": (column, 0.95)})
    every = Window.partitionBy()  # one row a group
    edges = p.select(*keys, F.log10(F.greatest(F.min("p5").over(every) / 1.1, F.lit(1.0))).alias("_lo"), F.log10(F.greatest(F.max("p95").over(every) * 1.1, F.lit(1.0))).alias("_hi"))
    place = F.floor((F.log10(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    x = df.select(*keys, column).join(edges, keys).withColumn("bin", F.when(F.log10(column) == F.col("_hi"), bins - 1).otherwise(place).cast("int"))
    counts = x.filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*keys, "bin").agg(F.count("*").alias("_n"))
    return counts.select(*keys, "bin", (F.col("_n") / F.max("_n").over(Window.partitionBy(*keys))).alias("share"))


def anchor(long: DataFrame, run: str, feature: str, value: str, control: Column, weight: str) -> DataFrame:
    """Subtracts the own run's control mean; a run without controls takes the mean of all controls, and without any control the mean of all cells (``weight``: cells of a profile)."""
    x = long.withColumn("_c", F.when(control, F.col(value)))
    own = x.groupBy(run, feature).agg(F.avg("_c").alias("_own"))
    pooled = x.groupBy(feature).agg(F.avg("_c").alias("_pooled"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("_cells"))
    base = F.coalesce("_own", "_pooled", "_cells")
    return x.join(own, [run, feature]).join(pooled, feature).withColumn(value, F.col(value) - base).drop("_c", "_own", "_pooled", "_cells")


def anchor_cells(cells: DataFrame, run: str, columns: list[str], control: Column) -> DataFrame:
    """Subtracts the mean of the own run's control cells; runs without controls stay as they are."""
    own = cells.groupBy(run).agg(*[F.avg(F.when(control, F.col(c))).alias(f"_{c}") for c in columns])
    x = cells.join(own, run)
    return x.withColumns({c: F.col(c) - F.coalesce(f"_{c}", F.lit(0.0)) for c in columns}).drop(*[f"_{c}" for c in columns])


def merge_replicates(df: DataFrame, run: str, condition: str, control: Column) -> DataFrame:
    """(merge_key, n, runs): controls keep "run::condition", others go by the label without its replicate; up to three runs are listed, else "n runs"."""
    key = F.when(control, F.concat_ws("::", run, condition)).otherwise(strip_replicate(F.col(condition)))
    per_run = df.groupBy(key.alias("merge_key"), run).agg(F.count("*").alias("_n"))
    out = per_run.groupBy("merge_key").agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list(run)).alias("_runs"))
    shown = F.when(F.size("_runs") <= 3, F.array_join("_runs", ", ")).otherwise(F.concat(F.size("_runs").cast("string"), F.lit(" runs")))
    return out.select("merge_key", "n", shown.alias("runs"))


def condition_meta(df: DataFrame, keys: list[str], order: str, first: list[str], current: Column) -> DataFrame:
    """Per profile the first row's fields by ``order``, the number of cells, and whether any row is of the current run."""
    s = F.min_by(F.struct(*first), order)
    return df.groupBy(*keys).agg(s.alias("_s"), F.count("*").alias("n_cells"), F.bool_or(current).alias("is_current")).select(*keys, "_s.*", "n_cells", "is_current")


def class_weights(df: DataFrame, label: str, least: int, cap: int) -> DataFrame:
    """(label, n, idx, weight, balanced) of classes with ``least`` rows or more: idx in label order from 0, the weight of a row min(1 / n, cap / n), and 1 / n scaled so that they sum to the number of classes.

    Rows of other classes and blank ones have no weight."""
    c = df.filter(F.trim(F.col(label).cast("string")) != "").groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    every = Window.partitionBy()  # one row a class
    inverse = 1 / F.greatest(F.col("n"), F.lit(1))
    return c.select(
        label, "n", (F.row_number().over(every.orderBy(label)) - 1).alias("idx"), F.least(1 / F.col("n"), cap / F.col("n")).alias("weight"),
        (inverse / F.sum(inverse).over(every) * F.count("*").over(every)).alias("balanced"),
    )


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, h1, h2): the number of rows and the sums of two words of each row's md5, which no order changes and no task has to sort."""
    line = F.md5(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    word = lambda k: F.sum(F.conv(F.substring(line, k, 8), 16, 10).cast("long"))
    return df.agg(F.count("*").alias("n"), word(1).alias("h1"), word(9).alias("h2"))


def gene_template(df: DataFrame, keys: list[str], gene: Column, columns: list[str]) -> DataFrame:
    """(gene, n, blank columns): the number of distinct conditions of each gene, most first."""
    d = df.select(*keys).distinct().withColumn("gene", gene).filter("gene <> ''")
    return d.groupBy("gene").agg(F.count("*").alias("n")).withColumns({c: F.lit("") for c in columns}).orderBy(F.desc("n"), "gene")


def evaluate_picks(picks: DataFrame, manual: DataFrame, scene: str, metric: str) -> DataFrame:
    """Per metric: n, exact, within_1, mae and rank against manual z; scenes marked -1 (no focus) are left out."""
    x = picks.join(manual.filter("chosen_z >= 0").select(scene, "chosen_z"), scene).withColumn("_e", F.abs(F.col("z") - F.col("chosen_z")))
    s = x.groupBy(metric).agg(F.count("*").alias("n"), F.count_if(F.col("_e") == 0).alias("exact"), F.count_if(F.col("_e") <= 1).alias("within_1"), F.avg("_e").alias("mae"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("exact"), "mae", metric)))  # one row a metric


def coverage(df: DataFrame, source: str, run: str, condition: str, gene: str) -> DataFrame:
    """Rows, runs, conditions and genes of each source."""
    return df.groupBy(source).agg(F.count("*").alias("n"), F.countDistinct(run).alias("runs"), F.countDistinct(condition).alias("conditions"), F.countDistinct(gene).alias("genes"))


def coverage_matrix(df: DataFrame, source: str, run: str, condition: str, sources: list[str]) -> DataFrame:
    """Per run the number of distinct conditions in each source, 0 where there is none."""
    d = df.select(run, source, condition).distinct()
    return d.groupBy(run).pivot(source, sources).count().fillna(0)


def region_stats(px: DataFrame, region: list[str], value: str) -> DataFrame:
    """Per region p90, p95, median and population deviation."""
    p = lambda q: F.percentile(value, F.lit(q))
    return px.groupBy(*region).agg(p(0.9).alias("cell_p90"), p(0.95).alias("cell_p95"), p(0.5).alias("cell_median"), F.stddev_pop(value).alias("cell_std"))


def prominence(spots: DataFrame, stats: DataFrame, region: list[str], intensity: str) -> DataFrame:
    """Adds prominence_p90 and prominence_median: intensity over the region's figure, 0 where that is not positive, null without a region."""
    x = spots.join(stats, region, "left")
    over = lambda c: F.when(F.col(c) > 0, F.col(intensity) / F.col(c)).when(F.col(c).isNotNull(), F.lit(0.0))
    return x.withColumns({"prominence_p90": over("cell_p90"), "prominence_median": over("cell_median")})


def region_intensity(px: DataFrame, region: list[str], channel: str, channels: list[str], value: str) -> DataFrame:
    """intensity_{mean,min,max,median,p95,total}_<channel> of each region."""
    aggs = [F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"), F.sum(value).alias("total")]
    wide = px.groupBy(*region).pivot(channel, channels).agg(*aggs)
    return wide.withColumnsRenamed({f"{c}_{a}": f"intensity_{a}_{c}" for c in channels for a in ("mean", "min", "max", "median", "p95", "total")})


def running_covariance(px: DataFrame, region: list[str]) -> DataFrame:
    """(region, _run): the covariance of y and x as a running sum over the region's pixels in row order, with a product and its addition rounded once.

    DuckDB's covar_pop(y, x) adds up this way, so the sign of what is 0 but for rounding is the same. A region's pixels are held in one task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=["y", "x"]).sort_values(["y", "x"])
        my = mx = c = 0.0
        for n, (y, x) in enumerate(zip(g["y"].astype(float), g["x"].astype(float), strict=True), 1):
            dx = x - mx
            mx += dx / n
            my += (y - my) / n
            c = math.fma(dx, y - my, c)
        return g[region].head(1).assign(_run=c / len(g))

    return px.select(*region, "y", "x").groupBy(*region).applyInPandas(run, px.select(*region).schema.add("_run", "double"))


def region_geometry(px: DataFrame, region: list[str], px_per_um: float) -> DataFrame:
    """Area, half-open box, centroid, axis lengths, eccentricity, orientation and equivalent diameter from labelled pixels; a pixel adds 1/12 to its second moments.

    The orientation is the angle from the row axis to the major axis, in [-pi/2, pi/2]; pi/4 or -pi/4 by the sign of the covariance where both axes are equal.
    Where the covariance is 0 but for rounding and its sign shows, that of its running sum in row order counts."""
    m = materialize(px.groupBy(*region).agg(
        F.count("*").alias("area_px"), F.min("y").alias("bbox_y0"), F.min("x").alias("bbox_x0"), (F.max("y") + 1).alias("bbox_y1"), (F.max("x") + 1).alias("bbox_x1"),
        F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"), (F.var_pop("y") + 1 / 12).alias("_yy"), (F.var_pop("x") + 1 / 12).alias("_xx"), F.covar_pop("y", "x").alias("_xy"),
    ), "moments")
    level = m.filter((F.abs("_xy") < 1e-9 * (F.col("_yy") + F.col("_xx"))) & (F.col("_yy") - F.col("_xx") < 1e-12) & (F.col("_yy") > 1 / 12)).select(*region)
    held = px.join(F.broadcast(level) if level.count() <= FEW else level, region, "left_semi")
    m = m.join(running_covariance(held, region), region, "left").withColumn("_xy", F.coalesce("_run", "_xy"))
    root = F.sqrt(((F.col("_yy") - F.col("_xx")) / 2) ** 2 + F.col("_xy") ** 2)
    big, small = (F.col("_yy") + F.col("_xx")) / 2 + root, F.greatest((F.col("_yy") + F.col("_xx")) / 2 - root, F.lit(0.0))
    even = F.when(F.col("_xy") > 0, F.pi() / 4).otherwise(-F.pi() / 4)
    tilt = F.when(F.abs(F.col("_yy") - F.col("_xx")) < 1e-12, even).otherwise(F.atan2(2 * F.col("_xy"), F.col("_yy") - F.col("_xx")) / 2)
    return m.withColumns({
        "area_um2": F.col("area_px") / px_per_um**2, "major_axis_length_um": 4 * F.sqrt(big) / px_per_um, "minor_axis_length_um": 4 * F.sqrt(small) / px_per_um,
        "eccentricity": F.sqrt(1 - small / big), "orientation": tilt, "equivalent_diameter_um": F.sqrt(4 * F.col("area_px") / F.pi()) / px_per_um,
    }).drop("_yy", "_xx", "_xy", "_run")


def crosstalk_subtract(px: DataFrame, frame: list[str], target: str, source: str, k: float) -> DataFrame:
    """Adds ``corrected``: max(target - k * max(source - the frame's median of it, 0), 0)."""
    base = percentiles(px, frame, {"_m": (source, 0.5)})
    bleed = k * F.greatest(F.col(source) - F.col("_m"), F.lit(0.0))
    return px.join(base, frame).withColumn("corrected", F.greatest(F.col(target) - bleed, F.lit(0.0))).drop("_m")


def zclip(df: DataFrame, columns: list[str], limit: float = 5.0) -> DataFrame:
    """z by the population deviation over all cells (below 1e-8 it counts as 1), null becomes 0, clipped. The means and deviations are one row, read once."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = {}
    for c in columns:
        m, s = one[f"m_{c}"] or 0.0, one[f"s_{c}"] or 0.0
        z = F.coalesce((F.col(c) - m) / (s if s >= 1e-8 else 1.0), F.lit(0.0))
        out[c] = F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))
    return df.withColumns(out)


def score_summary(per_query: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Means of ap and knn and the number of valid queries per key, in the given order."""
    return per_query.groupBy(*keys).agg(F.avg("ap").alias("map"), F.avg("knn").alias("knn"), F.count("*").alias("n")).orderBy(*order)


def top_abs(scores: DataFrame, keys: list[str], feature: str, score: str, n: int) -> DataFrame:
    """The n features of each profile with the largest absolute score."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs(score)), feature)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
