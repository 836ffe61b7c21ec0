"""Detection of spots in pixel tables (image keys, y, x, value): wavelet response, candidates of regions, sub-pixel centres, contrast of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..worktable import materialize
from .evaluation import suppress_points
from .quantiles import percentiles
from .sites import around

#: The weights of the smoothing kernel, and what makes a median deviation a standard deviation.
KERNEL, MAD = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16), 1.4826


def rescale(px: DataFrame, image: list[str], low: float = 0.01, high: float = 0.999) -> DataFrame:
    """``value`` on a scale from 0 at the image's percentile ``low`` to 1 at ``high``, clipped; 0 where both are equal."""
    p = percentiles(px, image, {"_low": ("value", low), "_high": ("value", high)})
    span = F.col("_high") - F.col("_low")
    at = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("_low")) / span))).otherwise(F.lit(0.0))
    return px.join(p, image).withColumn("value", at).drop("_low", "_high")


def _smooth(lines: Column, field: str, step: int) -> Column:
    """A line of pixels (structs in order) with ``s`` of each smoothed along it by the kernel with holes; the line is mirrored at its ends."""
    size = F.size(lines)

    def at(i: Column, shift: int) -> Column:
        j = F.pmod(i + shift, 2 * size)
        return F.element_at(lines, F.when(j < size, j + 1).otherwise(2 * size - j).cast("int"))[field]

    def pixel(p: Column, i: Column) -> Column:
        terms = [F.lit(w) * at(i, (k - 2) * step) for k, w in enumerate(KERNEL)]
        return F.struct(p["y"].alias("y"), p["x"].alias("x"), p["planes"].alias("planes"), p["v"].alias("v"), sum(terms[1:], terms[0]).alias("s"))

    return F.transform(lines, pixel)


def atrous_planes(px: DataFrame, image: list[str], scales: int) -> DataFrame:
    """(image, y, x, planes): the differences of an image smoothed by the kernel with holes of 2^k - 1 pixels and of one smoothed once more.

    Images are whole rectangles from (0, 0). Each axis of a scale is one exchange of lines, so an image is as many tasks' work as it has lines."""
    p = px.select(*image, "y", "x", F.array().cast("array<double>").alias("planes"), F.col("value").cast("double").alias("v"), F.col("value").cast("double").alias("s"))
    for k in range(scales):
        for along, across in (("y", "x"), ("x", "y")):
            field = "v" if along == "y" else "s"
            line = p.groupBy(*image, F.col(across).alias("_line")).agg(F.array_sort(F.collect_list(F.struct(along, *[c for c in ("y", "x", "planes", "v", "s") if c != along]))).alias("_l"))
            p = line.select(*image, F.explode(_smooth(F.col("_l"), field, 2**k)).alias("p")).select(*image, "p.y", "p.x", "p.planes", "p.v", "p.s")
        p = p.select(*image, "y", "x", F.array_append("planes", F.col("v") - F.col("s")).alias("planes"), F.col("s").alias("v"), "s")
    return p.select(*image, "y", "x", "planes")


def atrous_response(px: DataFrame, image: list[str], scales: tuple[int, ...] = (1, 2), threshold: float = 3.0, total: int = 4) -> DataFrame:
    """(image, y, x, response): the sum over the chosen scales of what rises above ``threshold`` robust deviations of its plane.

    The image is rescaled first (``rescale``). A plane's deviation is 1.4826 times its median absolute deviation in the image. ``total`` counts the
    scales in the decomposition, of which no more are made than the largest chosen one takes."""
    if not scales or min(scales) < 0:
        raise ValueError("scales must be given and not be negative")
    planes = atrous_planes(rescale(px, image), image, max(scales) + 1)
    chosen = F.array(*[F.struct(F.lit(k).alias("scale"), F.col("planes")[k].alias("plane")) for k in sorted(set(scales)) if k < max(total, max(scales) + 1)])
    long = planes.select(*image, "y", "x", F.inline(chosen))
    long, keys = materialize(long, "atrous-planes"), [*image, "scale"]
    off = long.join(percentiles(long, keys, {"_m": ("plane", 0.5)}), keys).withColumn("_off", F.abs(F.col("plane") - F.col("_m")))
    cut = percentiles(off, keys, {"_mad": ("_off", 0.5)})
    kept = F.when(F.col("plane") > threshold * MAD * F.col("_mad"), F.col("plane")).otherwise(F.lit(0.0))
    return long.join(cut, keys).groupBy(*image, "y", "x").agg(F.sum(kept).alias("response"))


def radial_centres(px: DataFrame, sites: DataFrame, image: list[str], half: int) -> DataFrame:
    """(image, site, y, x, sigma): the point nearest, by weighted least squares, to the lines along the gradients around each site, and the width there.

    ``sites``: (image, site, y, x) of whole pixels; the square of ``half`` around each is cut at the image's border. Weights are squared gradients
    over one plus the distance from their centre of mass; gradients below a hundredth of the largest have none. y and x are null with fewer than
    three rows or columns, fewer than four gradients, or where all point the same way. sigma comes from second moments above the
    border's median about the centre (the site itself where there is none); 0 without any. A site's patch is one group of a task; all steps
    share one exchange."""
    p = around(px, sites, image, half).repartition(*[F.col(c) for c in image], F.col("site"))
    key = [*image, "site"]
    all_ = Window.partitionBy(*key)

    def slope(along: str, across: str) -> Column:
        w = Window.partitionBy(*key, across).orderBy(along)
        back, on = F.lag("value").over(w), F.lead("value").over(w)
        return F.when(back.isNull(), on - F.col("value")).when(on.isNull(), F.col("value") - back).otherwise((on - back) / 2)

    p = p.withColumns({"gy": slope("dy", "dx"), "gx": slope("dx", "dy")}).withColumn("m2", F.col("gx") ** 2 + F.col("gy") ** 2)
    ends = {f"{f.__name__}_{c}": f(c).over(all_) for c in ("dy", "dx") for f in (F.min, F.max)}
    mass = F.sum("m2").over(all_)
    p = p.withColumns({"most": F.max("m2").over(all_), "cy": F.sum(F.col("m2") * F.col("y")).over(all_) / F.nullif(mass, F.lit(0.0)), "cx": F.sum(F.col("m2") * F.col("x")).over(all_) / F.nullif(mass, F.lit(0.0)), **ends})
    keep = F.col("m2") > 1e-4 * F.col("most")
    away = F.sqrt((F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2)
    w, m2 = F.when(keep, F.col("m2") / (away + 1)).otherwise(F.lit(0.0)), F.nullif(F.col("m2"), F.lit(0.0))
    uu, vv, uv = (F.coalesce(w * c, F.lit(0.0)) for c in (1 - F.col("gx") ** 2 / m2, 1 - F.col("gy") ** 2 / m2, -F.col("gx") * F.col("gy") / m2))
    p = p.withColumns({"uu": uu, "vv": vv, "uv": uv, "keep": keep})
    total = lambda c: F.sum(c).over(all_)
    p = p.withColumns({
        "a11": total("uu"), "a12": total("uv"), "a22": total("vv"), "b1": total(F.col("uu") * F.col("x") + F.col("uv") * F.col("y")),
        "b2": total(F.col("uv") * F.col("x") + F.col("vv") * F.col("y")), "kept": total(F.col("keep").cast("int")),
    })
    det = F.col("a11") * F.col("a22") - F.col("a12") ** 2
    wide = (F.col("max_dy") - F.col("min_dy") >= 2) & (F.col("max_dx") - F.col("min_dx") >= 2)
    solved = wide & (F.col("kept") >= 4) & (F.abs(det) >= 1e-12)
    p = p.withColumns({"py": F.when(solved, (F.col("a11") * F.col("b2") - F.col("a12") * F.col("b1")) / det), "px": F.when(solved, (F.col("a22") * F.col("b1") - F.col("a12") * F.col("b2")) / det)})
    border = (F.col("dy") == F.col("min_dy")) | (F.col("dy") == F.col("max_dy")) | (F.col("dx") == F.col("min_dx")) | (F.col("dx") == F.col("max_dx"))
    p = p.withColumn("ground", F.median(F.when(border, F.col("value"))).over(all_)).withColumn("up", F.greatest(F.col("value") - F.col("ground"), F.lit(0.0)))
    r2 = (F.col("y") - F.coalesce("py", F.col("y") - F.col("dy"))) ** 2 + (F.col("x") - F.coalesce("px", F.col("x") - F.col("dx"))) ** 2
    spread = F.sum(F.col("up") * r2) / F.nullif(F.sum("up"), F.lit(0.0))
    found = p.groupBy(*key).agg(F.first("py").alias("y"), F.first("px").alias("x"), F.when(spread.isNotNull(), F.sqrt(F.greatest(spread / 2, F.lit(1e-12)))).otherwise(F.lit(0.0)).alias("sigma"))
    return sites.select(*key).join(found, key, "left")


def region_candidates(px: DataFrame, image: list[str], region: str, distance: int, snr: float) -> DataFrame:
    """(image, region, y, x, amplitude): pixels of labelled regions that are the largest of their own region within ``distance`` rows and columns, and
    more than ``snr`` of the region's deviations above its median.

    Label 0 is no region; regions with a deviation below 1e-9 have no candidates. A brighter pixel of the next region hides none. Of equal
    pixels within the distance the first by row and column stays. Pixels send their value along the row, then what came together goes along
    the column: no window looks beyond a region and nothing has to be filled in."""
    own = px.filter(F.col(region) > 0).select(*image, region, "y", "x", F.col("value").cast("double").alias("value"))
    stats = own.groupBy(*image, region).agg(F.median("value").alias("_m"), F.stddev_pop("value").alias("_s")).filter("_s >= 1e-9")
    p = own.join(stats, [*image, region]).select(*image, region, "y", "x", (F.col("value") - F.col("_m")).alias("v"), (snr * F.col("_s")).alias("least"))
    steps = F.explode(F.sequence(F.lit(-distance), F.lit(distance)))
    mine = F.struct("v", "least")
    p = p.withColumn("_k", steps).groupBy(*image, region, "y", (F.col("x") + F.col("_k")).alias("x")).agg(F.max("v").alias("top"), F.max(F.when(F.col("_k") == 0, mine)).alias("own"))
    p = p.withColumn("_k", steps).groupBy(*image, region, (F.col("y") + F.col("_k")).alias("y"), "x").agg(F.max("top").alias("top"), F.max(F.when(F.col("_k") == 0, F.col("own"))).alias("own"))
    peaks = p.filter("own.v = top AND own.v > own.least").select(*image, region, "y", "x", F.col("own.v").alias("amplitude"))
    place = peaks.withColumn("_row", F.struct("y", "x"))
    return suppress_points(place, [*image, region], "_row", "y", "x", "amplitude", float(distance), square=True).drop("_row")


def object_contrast(px: DataFrame, image: list[str], label: str, ring: int = 4) -> DataFrame:
    """(image, label, contrast): the absolute difference of the medians inside an object and in the ring around it, over the ring's (1e-6 at least).

    The ring holds the pixels of no object within ``ring`` steps along rows and columns. Null with fewer than five of them. Only edge pixels
    send their label out, each to the pixels in its reach, and those of objects are never joined."""
    beside = lambda along, across: Window.partitionBy(*image, across).orderBy(along)
    own = F.col(label)
    same = [F.coalesce(f(label).over(beside(a, b)) == own, F.lit(False)) for a, b in (("y", "x"), ("x", "y")) for f in (F.lag, F.lead)]
    marked = px.withColumn("_in", same[0] & same[1]).withColumn("_in", F.col("_in") & same[2] & same[3])
    edge = marked.filter((own > 0) & ~F.col("_in")).select(*image, label, "y", "x")
    reach = [(a, b) for a in range(-ring, ring + 1) for b in range(-ring, ring + 1) if abs(a) + abs(b) <= ring]
    sent = F.inline(F.arrays_zip(F.lit([a for a, _ in reach]).alias("dy"), F.lit([b for _, b in reach]).alias("dx")))
    out = edge.select(*image, label, "y", "x", sent).select(*image, label, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()
    around_ = out.join(px.filter(own == 0).select(*image, "y", "x", "value"), [*image, "y", "x"])
    rings = around_.groupBy(*image, label).agg(F.count("*").alias("_n"), F.median("value").alias("_ring"))
    inside = px.filter(own > 0).groupBy(*image, label).agg(F.median("value").alias("_inside"))
    contrast = F.abs(F.col("_inside") - F.col("_ring")) / F.greatest("_ring", F.lit(1e-6))
    return inside.join(rings, [*image, label], "left").select(*image, label, F.when(F.col("_n") >= 5, contrast).alias("contrast"))
