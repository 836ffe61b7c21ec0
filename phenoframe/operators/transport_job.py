"""The stored distances between conditions: what the store lacks is computed, what it has is kept."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import strip_replicate
from ..sources import results
from ..worktable import materialize
from . import transport
from .components import fit_components, reduce_vectors

#: Fewest groups of which distances are worth a view.
LEAST_GROUPS = 3


class Distances(NamedTuple):
    """``pairs`` (i, j, divergence, distance) and ``groups`` (key, run_id, condition, n_cells_used) as stored, how many pairs this run ``added``, and the first
    parameter that made the store of another run useless (``mismatch``, "name: stored -> wanted"), if any."""

    pairs: DataFrame
    groups: DataFrame
    added: int
    mismatch: str | None


def anchored(cells: DataFrame, run: str, vector: str, control: Column) -> DataFrame:
    """``vector`` less the mean vector of the own run's controls; runs without controls stay as they are. One row a run and dimension is joined back."""
    x = cells.withColumn(vector, F.col(vector).cast("array<double>"))
    own = x.filter(control).select(run, F.posexplode(vector).alias("dim", "v")).groupBy(run, "dim").agg(F.avg("v").alias("m"))
    own = own.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("_m"))
    less = F.zip_with(vector, "_m", lambda v, m: v - F.coalesce(m["m"], F.lit(0.0)))
    return x.join(own, run, "left").withColumn(vector, F.when(F.col("_m").isNull(), F.col(vector)).otherwise(less)).drop("_m")


def point_clouds(cells: DataFrame, run: str, condition: str, row: str, vector: str, control: Column, merge: bool, cap: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(clouds (key, points), groups (key, run_id, condition, n_cells_used)).

    A group is a run's condition; with ``merge``, conditions that are no controls go by their label without its replicate, over all runs, of which up to three
    are listed. Groups of fewer than ``least`` cells are left out and of larger ones ``cap`` cells are drawn."""
    name = strip_replicate(F.col(condition)) if merge else F.col(condition)
    single = control | F.lit(not merge)
    key = F.when(single, F.concat_ws("::", F.col(run).cast("string"), F.col(condition))).otherwise(name)
    keyed = cells.select(key.alias("key"), F.col(run).cast("string").alias("run_id"), F.when(single, F.col(condition)).otherwise(name).alias("condition"), F.col(row).alias("row"), F.col(vector).alias("vector"))
    groups = keyed.groupBy("key", "condition", "run_id").agg(F.count("*").alias("n")).groupBy("key", "condition").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("run_id")).alias("runs"))
    runs = F.when(F.size("runs") <= 3, F.array_join("runs", ",")).otherwise(F.concat(F.size("runs").cast("string"), F.lit(" runs")))
    groups = groups.filter(F.col("n") >= least).select("key", runs.alias("run_id"), "condition", F.least(F.col("n"), F.lit(cap)).alias("n_cells_used"))
    return transport.clouds(keyed, "key", "row", "vector", cap, least), groups


def _differing(stored: dict, wanted: dict) -> str | None:
    return next((f"{k}: {stored.get(k)} -> {wanted[k]}" for k in sorted(wanted) if stored.get(k) != wanted[k]), None)


def distance_job(
    spark: SparkSession, cells: DataFrame, path: str, run: str, condition: str, row: str, vector: str, control: Column, version: str,
    merge: bool = False, cap: int = 400, least: int = 5, dims: int = 0, reg: float = 0.05,
) -> Distances | None:
    """Distances between all groups of cells, stored at ``path``; None where there are fewer than three groups, and nothing is stored.

    Vectors are anchored to their run's controls, reduced to ``dims`` components if that is fewer than they have (0: not), and grouped by
    ``point_clouds``. ``version`` says which cells these are (a file's time, a table's version): with it and the options the store is compared,
    by the first that differs it is made anew, and where all agree only pairs with a group that it lacks are computed. Its scale of costs is kept,
    so old and new pairs go together. What was stored stays readable until the new is whole (``sources.results``)."""
    options = {"version": version, "merge": merge, "cap": cap, "least": least, "dims": dims, "reg": reg}
    x = anchored(cells, run, vector, control)
    if dims:
        size = x.agg(F.max(F.size(vector))).first()[0] or 0
        if size > dims:
            n = x.count()
            fitted = fit_components(x, vector, None, min(dims, size, max(2, n // 10)))
            x = reduce_vectors(x, vector, fitted, "_reduced").drop(vector).withColumnRenamed("_reduced", vector)
    clouds, groups = point_clouds(x, run, condition, row, vector, control, merge, cap, least)
    clouds, groups = materialize(clouds, "distance-clouds"), materialize(groups, "distance-groups")
    if groups.count() < LEAST_GROUPS:
        return None
    manifest = results.read_manifest(spark, path)
    mismatch = _differing(json.loads(manifest["options"]), options) if manifest else None
    old = results.read_results(spark, path) if manifest and mismatch is None else None
    scale = manifest["scale"] if old else reg * transport.cost_scale(clouds)
    known = old["groups"].select("key") if old else None
    new = materialize(transport.sinkhorn_matrix(clouds, absolute=scale, known=known), "distance-pairs")
    added = new.count()
    here = groups.select("key")
    if old is None or added or not known.join(here, "key", "left_anti").isEmpty():
        kept = old["pairs"].join(here.withColumnRenamed("key", "i"), "i", "left_semi").join(here.withColumnRenamed("key", "j"), "j", "left_semi") if old else None
        pairs = new if kept is None else kept.unionByName(new)
        results.write_results({"pairs": pairs, "groups": groups}, path, {"options": json.dumps(options, sort_keys=True), "scale": scale}, ("parquet",))
    stored = results.read_results(spark, path)
    return Distances(stored["pairs"], stored["groups"], added, mismatch)
