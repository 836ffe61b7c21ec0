"""Sharpness of pixel grids and the choice of a slice from a stack; stencils are windows over (image keys, y, x, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _beside(column: str, w, k: int):
    """The value k places on, the border's own where there is none."""
    return F.coalesce(F.lead(column, k).over(w) if k > 0 else F.lag(column, -k).over(w), F.col(column))


def gradients(px: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``lap`` (five-point Laplacian) and ``sobel`` (squared Sobel gradient) to each pixel; borders repeat their own value."""
    down, across = Window.partitionBy(*by, "x").orderBy("y"), Window.partitionBy(*by, "y").orderBy("x")
    p = px.withColumn("v", F.col("value").cast("double"))
    p = p.withColumn("_dy", _beside("v", down, 1) - _beside("v", down, -1)).withColumn("_ly", _beside("v", down, 1) + _beside("v", down, -1) - 2 * F.col("v"))
    p = p.withColumn("_gy", _beside("_dy", across, 1) + 2 * F.col("_dy") + _beside("_dy", across, -1))
    p = p.withColumn("_dx", _beside("v", across, 1) - _beside("v", across, -1)).withColumn("_lx", _beside("v", across, 1) + _beside("v", across, -1) - 2 * F.col("v"))
    p = p.withColumn("_gx", _beside("_dx", down, 1) + 2 * F.col("_dx") + _beside("_dx", down, -1))
    return p.withColumns({"lap": F.col("_ly") + F.col("_lx"), "sobel": F.col("_gy") ** 2 + F.col("_gx") ** 2}).drop("_dy", "_ly", "_gy", "_dx", "_lx", "_gx")


def sharpness(px: DataFrame, by: list[str], mask: str | None = None) -> DataFrame:
    """Per image laplacian_variance, tenengrad (sum), tenengrad_mean and relative_variance = var / (mean^2 + 1e-9), over the pixels of ``mask`` if it is given."""
    g = gradients(px, by)
    if mask:
        g = g.withColumns({c: F.when(F.col(mask), F.col(c)) for c in ("lap", "sobel", "v")})
    spread = lambda c: F.coalesce(F.var_pop(c), F.lit(0.0))
    return g.groupBy(*by).agg(
        spread("lap").alias("laplacian_variance"), F.coalesce(F.sum("sobel"), F.lit(0.0)).alias("tenengrad"), F.avg("sobel").alias("tenengrad_mean"),
        (F.var_pop("v") / (F.avg("v") ** 2 + 1e-9)).alias("relative_variance"),
    )


def smooth_z(scores: DataFrame, stack: list[str], columns: list[str]) -> DataFrame:
    """Each score averaged with its neighbours in z by 1, 2, 1, ends repeated; stacks of fewer than three slices stay as they are."""
    w = Window.partitionBy(*stack).orderBy("z")
    n = F.count("*").over(Window.partitionBy(*stack))
    return scores.withColumns({c: F.when(n < 3, F.col(c)).otherwise((_beside(c, w, -1) + 2 * F.col(c) + _beside(c, w, 1)) / 4) for c in columns})


def ensemble(scores: DataFrame, stack: list[str], columns: list[str]) -> DataFrame:
    """Adds ``ensemble``: the mean of the scores, each scaled to 0..1 within its stack (0 where it is flat)."""
    w = Window.partitionBy(*stack)
    scaled = []
    for c in columns:
        low, high = F.min(c).over(w), F.max(c).over(w)
        scaled.append(F.when(high - low < 1e-12, F.lit(0.0)).otherwise((F.col(c) - low) / (high - low)))
    return scores.withColumn("ensemble", sum(scaled[1:], scaled[0]) / len(scaled))


def pick_slice(scores: DataFrame, stack: list[str], metric: str) -> DataFrame:
    """(stack, z): the slice of the largest score; ties within 1e-12 go to the one nearest the middle, then to the lower z. z counts from 0."""
    w = Window.partitionBy(*stack)
    x = scores.withColumn("_best", F.max(metric).over(w)).withColumn("_middle", (F.count("*").over(w) - 1) / 2)
    near = F.struct(F.abs(F.col("z") - F.col("_middle")), "z")
    return x.filter(F.col(metric) >= F.col("_best") - 1e-12).groupBy(*stack).agg(F.min_by("z", near).alias("z"))


def parse_grid(text: str) -> tuple[int, int]:
    """(rows, columns) of a grid as "NxM", in any case and with blanks; anything else, and numbers below one, are an error."""
    parts = text.lower().replace(" ", "").split("x")
    if len(parts) != 2 or not all(p.isdigit() and int(p) for p in parts):
        raise ValueError(f"a grid is rows x columns, like 2x3, not {text!r}")
    return int(parts[0]), int(parts[1])


def tile_id(px: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """Adds tile_y and tile_x; the last row and column take the remainder."""
    if rows < 1 or cols < 1 or height // rows < 1 or width // cols < 1:
        raise ValueError("the grid must be positive and no finer than the image")
    at = lambda c, size, n: F.least(F.floor(F.col(c) / (size // n)), F.lit(n - 1)).cast("int")
    return px.withColumns({"tile_y": at("y", height, rows), "tile_x": at("x", width, cols)})


def stitch(px: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """The pixels of each tile's (or each place's) chosen z."""
    return px.join(picks.select(*keys, "z"), [*keys, "z"])


def best_z_per_pixel(px: DataFrame, image: list[str]) -> DataFrame:
    """(image, y, x, z): at each place the z of the largest absolute Laplacian, the lowest of equal ones."""
    g = gradients(px, [*image, "z"])
    return g.groupBy(*image, "y", "x").agg(F.max_by("z", F.struct(F.abs("lap"), -F.col("z"))).alias("z"))


def local_peaks(px: DataFrame, by: list[str], distance: int, floor: float, n: int | None = None) -> DataFrame:
    """Pixels that are the maximum of their square window and above ``floor``; with ``n``, each image's n brightest."""
    across = Window.partitionBy(*by, "y").orderBy("x").rangeBetween(-distance, distance)
    down = Window.partitionBy(*by, "x").orderBy("y").rangeBetween(-distance, distance)
    p = px.withColumn("_m", F.max("value").over(across)).withColumn("_m", F.max("_m").over(down)).filter((F.col("value") == F.col("_m")) & (F.col("value") > floor)).drop("_m")
    if n is None:
        return p
    w = Window.partitionBy(*by).orderBy(F.desc("value"), "y", "x")
    return p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
