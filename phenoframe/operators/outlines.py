"""Points at equal steps along closed outlines, and profiles of widths along a midline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vertices of an outline that one task adds up.
SLOT = 4096
#: Fixed values of a width profile: places after densifying, places of each pole, and the places between which the middle lies.
DENSE, POLE, MIDDLE = 200, 20, (80, 120)
PROFILE = ("width_median", "width_mean", "width_max", "width_min", "width_std", "width_pos_max", "width_pos_min", "pole_width", "pole_taper")


def _with_next(df: DataFrame, keys: list[str], order: str, columns: list[str], after: Column) -> DataFrame:
    """Each row with ``_<column>`` of the row of its key numbered ``after``; null where there is none."""
    other = df.select(*keys, F.col(order).alias("_after"), *[F.col(c).alias(f"_{c}") for c in columns])
    return df.withColumn("_after", after).join(other, [*keys, "_after"], "left").drop("_after")


def _whole_numbers(start: Column, end: Column, below: int) -> Column:
    """The whole numbers k with start <= k < end and k < below."""
    low, high = F.ceil(start), F.least(F.ceil(end) - 1, F.lit(below - 1))
    return F.when(high >= low, F.sequence(low, high))


def resample_closed(vertices: DataFrame, keys: list[str], order: str, y: str, x: str, n: int = 100) -> DataFrame:
    """(keys, k, y, x): ``n`` points at equal arc length along each closed outline, from its vertex 0 on, by linear interpolation.

    ``order`` numbers an outline's vertices 0, 1, 2 and so on. Outlines of fewer than four vertices, or without length, give no rows; repeated
    vertices are sides without length. Lengths are added up by slots of 4,096 vertices, and each side makes the points that lie on it, so
    nothing is searched and an outline of any length is spread."""
    size = vertices.groupBy(*keys).agg(F.count("*").alias("_m")).filter(F.col("_m") >= 4)
    v = vertices.select(*keys, F.col(order).cast("long").alias("_i"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).join(size, keys)
    side = _with_next(v, keys, "_i", ["y", "x"], (F.col("_i") + 1) % F.col("_m"))
    side = side.withColumn("_d", F.sqrt((F.col("_y") - F.col("y")) ** 2 + (F.col("_x") - F.col("x")) ** 2)).withColumn("_slot", F.floor(F.col("_i") / SLOT))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = side.groupBy(*keys, "_slot").agg(F.sum("_d").alias("_s")).select(
        *keys, "_slot", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_before"), F.sum("_s").over(upto).alias("_until"), F.sum("_s").over(whole).alias("_total")
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy("_i")
    at = side.join(sums.filter("_total > 0"), [*keys, "_slot"])
    at = at.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_d").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    # A side ends at the very number at which the next one begins, so that no point is lost or made twice; the last ends behind them all.
    to = F.when(F.col("_i") == F.col("_m") - 1, 2 * F.col("_total")).otherwise(F.coalesce(F.lead("_from").over(inside), "_until"))
    at, step = at.withColumn("_to", to), F.col("_total") / n
    on = at.withColumn("k", F.explode(_whole_numbers(F.col("_from") / step, F.col("_to") / step, n)))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("k") * step - F.col("_from"), F.col("_d")), F.lit(0.0))))
    return on.select(*keys, F.col("k").cast("int").alias("k"), *[(F.col(c) + part * (F.col(f"_{c}") - F.col(c))).alias(c) for c in ("y", "x")])


def densify(samples: DataFrame, keys: list[str], order: str, value: str, n: int = DENSE) -> DataFrame:
    """(keys, k, value): ``n`` places at equal steps from the first to the last sample, by linear interpolation; a single sample stays alone.

    ``order`` numbers the samples 0, 1, 2 and so on. Each sample makes the places up to the next one."""
    return _dense(samples, keys, order, value, n).withColumnsRenamed({"_k": "k", "_value": "value"})


def _dense(samples: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    size = samples.groupBy(*keys).agg(F.count("*").alias("_m"))
    s = samples.select(*keys, F.col(order).cast("long").alias("_i"), F.col(value).cast("double").alias("_w")).join(size, keys)
    s = _with_next(s, keys, "_i", ["_w"], F.col("_i") + 1)
    last = F.col("_m") - 1
    ks = F.when(F.col("_m") == 1, F.array(F.lit(0).cast("long"))).when(F.col("_i") == last, F.array(F.lit(n - 1).cast("long")))
    first = lambda i: F.floor((i * (n - 1) + last - 1) / last)  # noqa: E731  (exact for whole numbers of this size)
    low, high = first(F.col("_i")), first(F.col("_i") + 1) - 1
    ks = ks.when(high >= low, F.sequence(low, high))
    at = s.withColumn("_k", F.explode(ks))
    part = F.when(last > 0, F.col("_k") * last / (n - 1) - F.col("_i")).otherwise(F.lit(0.0))
    between = F.col("_w") + part * (F.coalesce("__w", "_w") - F.col("_w"))
    return at.select(*keys, F.col("_k").cast("int").alias("_k"), between.alias("_value"))


def _places(m: int) -> tuple[np.ndarray, ...]:
    """Of a midline of ``m`` samples: the places' (left sample, right sample, part of the way), numbered among the samples that lie beside a place."""
    if m == 1:
        return np.zeros(1, int), np.zeros(1, int), np.zeros(1)
    k = np.arange(DENSE)
    left = k * (m - 1) // (DENSE - 1)
    right = np.minimum(left + 1, m - 1)
    used = np.arange(m) if m <= DENSE else np.union1d(left, right)
    return np.searchsorted(used, left), np.searchsorted(used, right), k * (m - 1) / (DENSE - 1) - left


def _statistics(v: np.ndarray, k: np.ndarray, single: bool) -> np.ndarray:
    """A row a midline from its values ``v`` at places ``k``; NaN is the largest value."""
    s, n = np.sort(v, 1), v.shape[1]
    high, low = v.argmax(1), np.where(np.isnan(v), np.inf, v).argmin(1)
    fold = lambda at: np.minimum(k[at] / (DENSE - 1), 1 - k[at] / (DENSE - 1))
    mean = lambda a: np.cumsum(a, 1)[:, -1] / a.shape[1]  # noqa: E731  (added up in order, as SQL does)
    out = [0.5 * s[:, (n - 1) // 2] + 0.5 * s[:, n // 2], mean(v), s[:, -1], s[:, 0], v.std(1), fold(high), fold(low)]
    pole, mid = v[:, (k < POLE) | (k >= DENSE - POLE)], v[:, (k >= MIDDLE[0]) & (k < MIDDLE[1])]
    if single or not pole.shape[1]:
        return np.column_stack([*out, np.full((len(v), 2), np.nan)])
    pole, mid = mean(pole), mean(mid) if mid.shape[1] else np.zeros(len(v))
    return np.column_stack([*out, pole, np.where(mid <= 1e-9, 0.0, pole / np.where(mid <= 1e-9, 1.0, mid))])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        m, lists = b.column("_m").to_numpy(), b.column("_w")
        flat = lists.flatten()
        gap, w = flat.is_null().to_numpy(zero_copy_only=False), flat.fill_null(0.0).to_numpy()
        start = np.cumsum(lists.value_lengths().to_numpy()) - lists.value_lengths().to_numpy()
        out, none = np.zeros((len(m), len(PROFILE))), np.ones((len(m), len(PROFILE)), bool)
        for size in np.unique(m):
            (left, right, part), rows, k = _places(int(size)), np.flatnonzero(m == size), np.arange(DENSE if size > 1 else 1)
            at = start[rows][:, None]
            a, c, lacks = w[at + left], w[at + right], gap[at + left]
            v = a + part * (np.where(gap[at + right], a, c) - a)
            full = ~lacks.any(1)
            out[rows[full]] = _statistics(v[full], k, size == 1)
            none[rows[full], : 7 if size == 1 else None] = False
            for n in np.flatnonzero(~full & ~lacks.all(1)):
                out[rows[n]] = _statistics(v[n : n + 1, ~lacks[n]], k[~lacks[n]], False)[0]
                none[rows[n]] = False
                none[rows[n], 7] = not ((k[~lacks[n]] < POLE) | (k[~lacks[n]] >= DENSE - POLE)).any()
        keys = [c for c in b.schema.names if c not in ("_m", "_w")]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], *[pa.array(out[:, n], mask=none[:, n]) for n in range(len(PROFILE))]], names=[*keys, *PROFILE])


def width_profile(samples: DataFrame, keys: list[str], order: str, width: str) -> DataFrame:
    """(keys, width_median, width_mean, width_max, width_min, width_std, width_pos_max, width_pos_min, pole_width, pole_taper) of widths along a midline.

    Statistics are over ``DENSE`` interpolated places. Positions of the first largest and first smallest one are folded: 0 is a pole, 0.5 the
    middle. The pole's width is the mean of both outer tenths, its taper that over the mean of the middle fifth (0 where that is not
    positive); both are null for a single sample. A midline is one row with its samples (of a longer one than ``DENSE`` those beside a place, 2 * ``DENSE``
    at most); its places are made and measured where it stands, and none is sent, sorted or spilled. Other numbers than 0, 1, 2 and so on in ``order`` are not looked for."""
    last, i = F.col("_m") - 1, F.col("_i")
    first = lambda i: F.floor((i * (DENSE - 1) + last - 1) / last)
    makes = lambda i: first(i + 1) > first(i)
    s = samples.select(*keys, F.col(order).cast("long").alias("_i"), F.col(width).cast("double").alias("_w")).withColumn("_m", F.count("*").over(Window.partitionBy(*keys)))
    s = s.filter((F.col("_m") <= DENSE) | (i == last) | makes(i) | makes(i - 1))
    line = s.groupBy(*keys).agg(F.max("_m").alias("_m"), F.array_sort(F.collect_list(F.struct("_i", "_w"))).alias("_s"))
    line = line.select(*keys, "_m", F.transform("_s", lambda p: p["_w"]).alias("_w"))
    kind = ", ".join([*[f"`{c}` {line.schema[c].dataType.simpleString()}" for c in keys], *[f"{c} double" for c in PROFILE]])
    return line.mapInArrow(_profiles, kind)
