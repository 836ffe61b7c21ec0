"""Row filters and quality decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passes(thresholds: dict[str, float], columns: list[str]) -> Column:
    """AND of feature >= minimum; null and NaN fail; unknown columns are ignored."""
    ok = F.lit(True)
    for name, low in sorted(thresholds.items()):
        if name in columns:
            c = F.col(name).cast("double")
            ok = ok & F.coalesce(~F.isnan(c) & (c >= low), F.lit(False))
    return ok


def filter_min(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    return df.filter(passes(thresholds, df.columns))


def filter_report(df: DataFrame, thresholds: dict[str, float], keys: list[str]) -> DataFrame:
    """Per key: n_input, n_pass and pct_pass (0 if empty)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n_input"), F.count_if(passes(thresholds, df.columns)).alias("n_pass"))
    return out.withColumn("pct_pass", F.coalesce(F.try_divide(100.0 * F.col("n_pass"), F.col("n_input")), F.lit(0.0)))


def filter_in(df: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """OR within a field, AND across fields; a field that the table lacks is an error."""
    for field, values in chosen.items():
        if field not in df.columns:
            raise ValueError(f"no such field: {field}")
        df = df.filter(F.col(field).isin(values)) if values else df
    return df


def unknown_values(df: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """(field, value) of chosen values that no row has, in one pass over the table."""
    wanted = [(f, v) for f, values in sorted(chosen.items()) for v in values]
    hits = df.agg(*[F.coalesce(F.bool_or(F.col(f).eqNullSafe(F.lit(v))), F.lit(False)).alias(f"h{k}") for k, (f, v) in enumerate(wanted)])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(str(v)).alias("value"), F.col(f"h{k}").alias("hit")) for k, (f, v) in enumerate(wanted)])
    return hits.select(F.inline(rows)).filter("NOT hit").select("field", "value")


def natural_key(column: Column) -> Column:
    """Sorts text with its numbers by value: runs of digits are padded."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), r"([0-9]+)", "0000000000$1"), r"0*([0-9]{10})(?![0-9])", "$1")


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    """value, n and the place in natural order's key."""
    return df.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).withColumn("sort_key", natural_key(F.col("value")))


def quality_rules(
    df: DataFrame, height: float, width: float, px_per_um: float, margin: float = 2, least_um2: float = 0.3, clump_um2: float = 25.0
) -> DataFrame:
    """Adds ``rule`` (edge, debris or ok) and the flag ``clump`` from bbox_y0/x0/y1/x1 and area_px."""
    edge = (F.col("bbox_y0") < margin) | (F.col("bbox_x0") < margin) | (F.col("bbox_y1") > height - margin) | (F.col("bbox_x1") > width - margin)
    square = px_per_um**2
    rule = F.when(edge, "edge").when(F.col("area_px") < least_um2 * square, "debris").otherwise("ok")
    return df.withColumn("rule", rule).withColumn("clump", F.col("area_px") > clump_um2 * square)


def keeps(p_good: Column, confidence: float = 0.5, threshold: float | None = None) -> Column:
    """Whether a cell is kept: by a valid tuned threshold on P(bad), or if good is the likelier class with enough confidence."""
    if threshold is not None and 0 < threshold < 1:
        return (1 - p_good) < threshold
    return (p_good >= 0.5) & (p_good >= confidence)


def quality_report(df: DataFrame, sample: str, p_good: str, confidence: float = 0.5, threshold: float | None = None) -> DataFrame:
    """Per sample: total, edge, debris, rejected by the classifier, kept (needs ``rule``)."""
    ok = F.col("rule") == "ok"
    keep = keeps(F.col(p_good), confidence, threshold)
    return df.groupBy(sample).agg(
        F.count("*").alias("total"), F.count_if(F.col("rule") == "edge").alias("edge"), F.count_if(F.col("rule") == "debris").alias("debris"),
        F.count_if(ok & ~keep).alias("cnn"), F.count_if(ok & keep).alias("kept"),
    )
