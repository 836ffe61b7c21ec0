"""Plate layouts, batch sheets and the artefacts named after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

#: Plate shapes, rows by columns.
PLATES = ((2, 3), (4, 6), (6, 8), (8, 12), (16, 24), (32, 48))


def plate_bounds(df: DataFrame, keys: list[str], well: str) -> DataFrame:
    """Per plate the first and last row and column, and the smallest standard shape that holds them (null beyond the largest)."""
    k = L.well_key(F.col(well))
    x = df.select(*keys, (F.ascii(k["letter"]) - 65).alias("row"), (k["number"] - 1).alias("col")).filter("row BETWEEN 0 AND 25 AND col IS NOT NULL")
    b = x.groupBy(*keys).agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"))
    rows, cols = F.lit(None).cast("int"), F.lit(None).cast("int")
    for r, c in reversed(PLATES):
        fits = (F.col("row_max") < r) & (F.col("col_max") < c)
        rows, cols = F.when(fits, r).otherwise(rows), F.when(fits, c).otherwise(cols)
    return b.withColumns({"n_rows": rows, "n_cols": cols})


def plate_grid(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Every well of each plate's bounds."""
    g = bounds.withColumn("row", F.explode(F.sequence("row_min", "row_max"))).withColumn("col", F.explode(F.sequence("col_min", "col_max")))
    return g.select(*keys, F.concat(F.char(F.col("row") + 65), (F.col("col") + 1).cast("string")).alias("well"))


def duplicate_wells(layout: DataFrame, keys: list[str], well: str) -> DataFrame:
    """Wells that a layout names more than once after normalising, with their count."""
    return layout.groupBy(*keys, L.norm_well(F.col(well)).alias("well")).agg(F.count("*").alias("n")).filter("n > 1")


def pool_samples(sheet: DataFrame, stem: Column, path: str, row: str) -> DataFrame:
    """(stem, paths, repeated): rows of one output stem pooled, their files in row order; ``repeated`` counts files named more than once."""
    files = sheet.filter(stem.isNotNull() & (F.trim(stem) != "")).select(stem.alias("stem"), path, row)
    sample = files.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct(row, path))).alias("rows"))
    paths = F.transform("rows", lambda r: r[path])
    return sample.select("stem", paths.alias("paths"), (F.size(paths) - F.size(F.array_distinct(paths))).alias("repeated"))


def add_files(df: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """The table with the new rows whose path it lacks, each path once."""
    return df.unionByName(new.dropDuplicates([path]).join(df.select(path), path, "left_anti").select(df.columns))


def keep_expected(artefacts: DataFrame, layout: DataFrame, stem: str) -> tuple[DataFrame, DataFrame]:
    """(kept, stale): artefacts whose stem the layout expects, and the others. An empty layout keeps all."""
    expected = layout.select(stem).filter(F.col(stem).isNotNull()).distinct()
    if expected.isEmpty():
        return artefacts, artefacts.limit(0)
    return artefacts.join(expected, stem, "left_semi"), artefacts.join(expected, stem, "left_anti")


def rewrite_keys(df: DataFrame, renames: DataFrame, key: str, old: str, new: str, within: list[str]) -> DataFrame:
    """Replaces the old stem by the new one inside the columns ``within``; rows without a rename stay as they are. ``renames`` has one row an old stem."""
    names = renames.select(F.col(old).alias(key), F.col(new).alias("_new"))
    x = df.join(names, key, "left")
    changed = {c: F.when(F.col("_new").isNotNull(), F.replace(F.col(c), F.col(key), F.col("_new"))).otherwise(F.col(c)) for c in within if c != key}
    return x.withColumns(changed).withColumn(key, F.coalesce("_new", key)).drop("_new")


def relabel_plan(layout: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(stem, expected, bucket) of artefacts. ``layout``: source (or null), scenes, stem; ``sidecars``: stem, source, scenes (null without a sidecar).

    Scenes match as sets, first with the source, else among layout rows without one; the smallest stem wins a tie.
    Buckets: no sidecar, no match, correct, to rename."""
    as_set = F.array_sort(F.array_distinct("scenes"))
    lay = layout.withColumn("_set", as_set)
    exact = lay.filter("source IS NOT NULL").groupBy("source", "_set").agg(F.min("stem").alias("_exact"))
    loose = lay.filter("source IS NULL").groupBy("_set").agg(F.min("stem").alias("_loose"))
    x = sidecars.withColumn("_set", as_set).join(exact, ["source", "_set"], "left").join(loose, "_set", "left")
    expected = F.coalesce("_exact", "_loose")
    bucket = F.when(F.col("scenes").isNull(), "no sidecar").when(expected.isNull(), "no match").when(expected == F.col("stem"), "correct").otherwise("to rename")
    return x.select("stem", expected.alias("expected"), bucket.alias("bucket"))


def merge_sources(scenes: DataFrame, well: str, source: str, order: str, scene: str) -> DataFrame:
    """(well, source, scenes, conflicts): the first file that lists a well owns it; its scenes sorted, and the number of later files that list it too."""
    per_file = scenes.groupBy(L.norm_well(F.col(well)).alias("well"), source).agg(F.min(order).alias("_order"), F.array_sort(F.collect_set(scene)).alias("scenes"))
    first = per_file.groupBy("well").agg(F.min_by(F.struct(source, "scenes"), F.struct("_order", source)).alias("s"), (F.count("*") - 1).alias("conflicts"))
    return first.select("well", f"s.{source}", "s.scenes", "conflicts")


def layout_template(merged: DataFrame, well: str, scenes: str) -> DataFrame:
    """(well, n_positions, order): the wells of ``merge_sources`` with their numbers of positions; ``order`` sorts them as the plate does, letter then number."""
    k = L.well_key(F.col(well))
    return merged.select(F.col(well).alias("well"), F.size(scenes).alias("n_positions"), F.struct(k["letter"].alias("letter"), k["number"].alias("number")).alias("order"))


#: The column of a layout that names the well, and the columns that it must have.
WELL, REQUIRED = "well", ("well", "condition")


def clean_layout(raw: DataFrame, scenes: str = "scene_indices", required: tuple[str, ...] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """(layout, issues (issue, detail)) of a plate layout's rows as text: wells normalised, scene lists as numbers.

    A lacking column or a well that is named twice is an error. Rows without a well are left out. An issue is a layout in which no row has a condition, and each
    well with a scene list of which nothing could be read."""
    lacking = [c for c in required if c not in raw.columns]
    if lacking:
        raise ValueError(f"the layout lacks columns: {lacking}")
    own = raw.filter(F.trim(WELL) != "").withColumn(WELL, L.norm_well(F.col(WELL)))
    twice = own.groupBy(WELL).agg(F.count("*").alias("n")).filter("n > 1").orderBy(WELL).limit(5).collect()
    if twice:
        raise ValueError(f"wells named more than once: {[r[WELL] for r in twice]}")
    text = F.coalesce(F.col(scenes), F.lit("")) if scenes in raw.columns else F.lit("")
    layout = own.withColumn("_text", text).withColumn(scenes, L.parse_int_list(F.col("_text")))
    bad = layout.filter((F.trim("_text") != "") & (F.size(scenes) == 0)).select(F.lit("unreadable scenes").alias("issue"), F.concat_ws(": ", WELL, "_text").alias("detail"))
    none = layout.agg(F.count_if(F.coalesce(F.trim("condition") != "", F.lit(False))).alias("n")).filter("n = 0").select(F.lit("no condition").alias("issue"), F.lit("no row has a condition").alias("detail"))
    return layout.drop("_text"), none.unionByName(bad)


def backfill_times(artefacts: DataFrame, layout: DataFrame, scenes: DataFrame) -> DataFrame:
    """(stem, times): acquisition times of an artefact's scenes, in scene order, through the layout (stem, scenes); unmatched ones keep an empty list."""
    bare = F.regexp_replace("stem", "(_focused|_filtered)$", "")
    wanted = layout.select(F.col("stem").alias("_stem"), F.explode("scenes").alias("scene")).join(scenes.select("scene", "time"), "scene")
    times = wanted.groupBy("_stem").agg(F.transform(F.array_sort(F.collect_set(F.struct("scene", "time"))), lambda s: s["time"]).alias("times"))
    x = artefacts.withColumn("_stem", bare).join(times, "_stem", "left")
    return x.withColumn("times", F.coalesce("times", F.array().cast("array<timestamp>"))).drop("_stem")
