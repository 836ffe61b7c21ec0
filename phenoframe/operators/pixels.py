"""Focus metrics over a long table of pixels (image keys, y, x, value): stencils as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def focus_metrics(px: DataFrame, by: list[str], mask: str | None = None) -> DataFrame:
    """Per image: normalised variance, Brenner, Vollath F4 and the sum of the modified Laplacian.

    With ``mask`` (a boolean column) only the foreground counts: its pixels' variance, Laplacians about them, Brenner's differences whose middle lies in it and
    products of which both ends do. One shuffle by (image, column) serves the vertical neighbours and one by (image, row) the horizontal ones."""
    down = Window.partitionBy(*by, "x").orderBy("y")
    across = Window.partitionBy(*by, "y").orderBy("x")
    d = px.withColumn("v", F.col("value").cast("double")).withColumn("_in", F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(True))
    d = d.withColumns({f"y{k}": F.lead("v", k).over(down) for k in (1, 2)} | {f"_in{k}": F.lead("_in", k).over(down) for k in (1, 2)} | {"y_1": F.lag("v", 1).over(down)})
    d = d.withColumns({"x1": F.lead("v", 1).over(across), "x_1": F.lag("v", 1).over(across)})
    v, on = F.col("v"), F.col("_in")
    where = lambda ok, c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0.0))
    foreground = F.when(on, v)
    return d.groupBy(*by).agg(
        F.when(F.avg(foreground) > 0, F.var_pop(foreground) / F.avg(foreground)).otherwise(F.lit(0.0)).alias("normalized_variance"),
        where(F.col("_in1"), (F.col("y2") - v) ** 2).alias("brenner"),
        (where(on & F.col("_in1"), v * F.col("y1")) - where(on & F.col("_in2"), v * F.col("y2"))).alias("vollath_f4"),
        (where(on, F.abs(2 * v - F.col("y1") - F.col("y_1"))) + where(on, F.abs(2 * v - F.col("x1") - F.col("x_1")))).alias("sml"),
    )


def maximum_projection(px: DataFrame, by: list[str]) -> DataFrame:
    """The maximum over z at each place."""
    return px.groupBy(*by, "y", "x").agg(F.max("value").alias("value"))
