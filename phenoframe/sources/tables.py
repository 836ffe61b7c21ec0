"""Readers and writers of feature tables, group tables, label logs and the run library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table: CSV by its suffix, else Parquet; NaN becomes null."""
    if path.endswith(".csv"):
        return nan_to_null(spark.read.csv(path, header=True, inferSchema=True))
    return nan_to_null(spark.read.parquet(path))


def consolidate(frames: list[DataFrame]) -> DataFrame:
    """All tables by column name, with null for what one lacks."""
    if not frames:
        raise ValueError("no feature tables")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def group_table(wide: DataFrame, gene: str, order: str) -> DataFrame:
    """(scheme, gene, grp) from a wide table: names trimmed and lower-cased, blanks and "nan" left out, the last row of a gene wins."""
    schemes = [c for c in wide.columns if c not in (gene, order) and not c.startswith("_")]
    long = wide.select(F.lower(F.trim(gene)).alias("gene"), order, *[F.col(c).cast("string") for c in schemes]).unpivot(["gene", order], schemes, "scheme", "grp")
    long = long.withColumn("grp", F.trim("grp")).filter("gene <> '' AND grp <> '' AND lower(grp) <> 'nan'")
    return long.groupBy("scheme", "gene").agg(F.max_by("grp", order).alias("grp"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(scheme, gene, grp) of a CSV, or of a TSV by its suffix; the gene's header in any case, schemes without any group give no rows."""
    wide = spark.read.csv(path, header=True, sep="\t" if path.lower().endswith((".tsv", ".tab")) else ",")
    gene = next((c for c in wide.columns if c.strip().lower() == "gene"), None)
    if gene is None:
        raise ValueError(f"no column gene in {path}")
    lines = wide.select(*[F.col(f"`{c}`").alias(c.strip()) for c in wide.columns]).withColumn("_line", F.monotonically_increasing_id())
    return group_table(lines, gene.strip(), "_line")


LABEL_LOG = "cell_uid string, label_idx string, label_name string, labeled_at string, split string"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label log: rows without a key or with a label that isn't an integer are marked ``bad``; a blank split is train."""
    raw = spark.read.csv(path, header=True, schema=LABEL_LOG)
    label = F.col("label_idx").try_cast("int")
    return raw.select(
        "cell_uid", label.alias("label_idx"), "label_name", F.col("labeled_at").try_cast("timestamp").alias("labeled_at"),
        F.coalesce(F.when(F.trim("split") != "", F.trim("split")), F.lit("train")).alias("split"),
        (label.isNull() | F.coalesce(F.trim("cell_uid") == "", F.lit(True))).alias("bad"),
    )


def valid_labels(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of a label log that are sound, one row with n and n_bad)."""
    return log.filter(~F.col("bad")).drop("bad"), log.agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))


def load_library(index: DataFrame, runs: DataFrame, species: str = "") -> DataFrame:
    """Rows of the runs of one species (any case; empty: all) with the run's id and experiment type."""
    chosen = index.filter(F.lower("species") == species.lower()) if species else index
    keep = chosen.select("run_id", F.col("run_id").alias("_library_run_id"), F.col("experiment_type").alias("_library_experiment_type"))
    return runs.join(keep, "run_id")


#: What a crop table lacks is filled with these.
CROP_DEFAULTS = {"string": "", "int": 0, "bigint": 0, "boolean": False}


def consolidate_metadata(frames: list[DataFrame], columns: dict[str, str], fov: str = "fov_id") -> DataFrame:
    """All crop tables by name with typed defaults; field ids of each file are shifted by the sum of max + 1 of the files before (1 for a file without ids).

    One aggregate gives the largest id of all files; the shifts are one row a file."""
    out = []
    for n, f in enumerate(frames):
        filled = [
            F.coalesce(F.col(c).cast(t), F.lit(CROP_DEFAULTS[t])).alias(c) if c in f.columns else F.lit(CROP_DEFAULTS[t]).cast(t).alias(c) for c, t in columns.items()
        ]
        known = F.col(fov).cast("long") if fov in f.columns else F.lit(None).cast("long")
        out.append(f.select(*filled, known.alias("_known"), F.lit(n).alias("_file")))
    every = consolidate(out)
    last = {r["_file"]: r["last"] for r in every.groupBy("_file").agg(F.max("_known").alias("last")).collect()}  # one row a file
    shifts, at = [], 0
    for n in range(len(frames)):
        shifts.append(at)
        at += 1 if last.get(n) is None else int(last[n]) + 1
    shift = F.element_at(F.lit(shifts), F.col("_file") + 1)
    return every.withColumn(fov, (F.col(fov) + shift).cast(columns[fov])).drop("_known", "_file")


def shared_attributes(attributes: DataFrame, files: int) -> DataFrame:
    """(name, value): the attributes (file, name, value) that every one of ``files`` files has with the same value."""
    same = attributes.groupBy("name").agg(F.countDistinct("file").alias("n"), F.countDistinct("value").alias("v"), F.min("value").alias("value"), F.count_if(F.col("value").isNull()).alias("none"))
    return same.filter((F.col("n") == files) & (F.col("v") == 1) & (F.col("none") == 0)).select("name", "value")


def annotate(df: DataFrame, pathways: DataFrame, gene: str) -> DataFrame:
    """Adds ``pathway`` by gene in any case; what has none is Unannotated. ``pathways``: (gene, pathway), the smallest pathway of a gene counts."""
    names = pathways.groupBy(F.lower(F.trim("gene")).alias("_gene")).agg(F.min("pathway").alias("pathway"))
    x = df.withColumn("_gene", F.lower(F.trim(gene))).join(names, "_gene", "left")
    return x.withColumn("pathway", F.coalesce("pathway", F.lit("Unannotated"))).drop("_gene")


def search_runs(index: DataFrame, species: str = "", experiment_type: str = "", text: str = "") -> DataFrame:
    """Runs of a species and type, with ``text`` in their id or conditions; any case, empty arguments match all."""
    if species:
        index = index.filter(F.lower("species") == species.lower())
    if experiment_type:
        index = index.filter(F.lower("experiment_type") == experiment_type.lower())
    if text:
        low = F.lit(text.lower())
        index = index.filter(F.contains(F.lower("run_id"), low) | F.coalesce(F.contains(F.lower("condition_labels"), low), F.lit(False)))
    return index


def relink(df: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """Replaces a path's prefix; backslashes become slashes and ``changed`` tells which rows had the prefix."""
    plain = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    old, new = old.replace("\\", "/").rstrip("/"), new.replace("\\", "/").rstrip("/")
    hit = F.coalesce((plain == old) | F.startswith(plain, F.lit(old + "/")), F.lit(False))
    return df.withColumn("changed", hit).withColumn(path, F.when(hit, F.concat(F.lit(new), F.substr(plain, F.lit(len(old) + 1)))).otherwise(F.col(path)))


def register_run(index: DataFrame, run: DataFrame) -> DataFrame:
    """The index with the run's row in place of one of the same id; a blank species is unknown."""
    known = F.when(F.trim("species") != "", F.col("species")).otherwise("unknown")
    return index.join(run.select("run_id"), "run_id", "left_anti").select(index.columns).unionByName(run.withColumn("species", known), allowMissingColumns=True)


def run_row(cells: DataFrame, run: str, condition: str) -> DataFrame:
    """(run_id, n_cells, n_conditions, condition_labels): what the index says of each run's cells; the labels sorted and joined by commas."""
    own = cells.groupBy(F.col(run).alias("run_id"), condition).agg(F.count("*").alias("n"))
    return own.groupBy("run_id").agg(F.sum("n").alias("n_cells"), F.count(condition).alias("n_conditions"), F.array_join(F.array_sort(F.collect_list(condition)), ",").alias("condition_labels"))


def update_run(index: DataFrame, run_id: str, fields: dict[str, str]) -> tuple[DataFrame, bool]:
    """(the index with the given fields of one run set, whether it has the run); a field that it lacks is an error."""
    lacking = [c for c in fields if c not in index.columns]
    if lacking:
        raise ValueError(f"no such fields: {lacking}")
    own = F.col("run_id").eqNullSafe(F.lit(run_id))
    there = not index.filter(own).isEmpty()
    return index.withColumns({c: F.when(own, F.lit(v)).otherwise(F.col(c)) for c, v in fields.items()}), there


def remove_run(index: DataFrame, run_id: str) -> DataFrame:
    return index.filter(~F.col("run_id").eqNullSafe(F.lit(run_id)))


def write_distances(pairs: DataFrame, path: str, params: dict[str, str]) -> None:
    """Long pairs as Parquet and the parameters as JSON beside them."""
    pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    spark = pairs.sparkSession
    spark.createDataFrame(sorted(params.items()), "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/params")


def read_distances(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    rows = spark.read.schema("name string, value string").json(f"{path}/params").collect()  # a few parameters
    return spark.read.parquet(f"{path}/pairs"), {r["name"]: r["value"] for r in rows}


def wide_distances(pairs: DataFrame, groups: DataFrame, order: str, distance: str) -> DataFrame:
    """The groups (key, ...) in ``order`` with their distances to the first, second and so on as d_0, d_1, ...; 0 to themselves. For export: as many columns as groups."""
    names = [r["key"] for r in groups.select("key", order).orderBy(order).collect()]
    place = F.create_map(*[F.lit(x) for n, k in enumerate(names) for x in (k, f"d_{n}")])
    both = pairs.select("i", "j", distance).union(pairs.select("j", "i", distance)).unionByName(groups.select(F.col("key").alias("i"), F.col("key").alias("j"), F.lit(0.0).alias(distance)))
    wide = both.withColumn("_d", F.element_at(place, F.col("j"))).groupBy(F.col("i").alias("key")).pivot("_d", [f"d_{n}" for n in range(len(names))]).agg(F.first(distance))
    return groups.join(wide, "key")


def long_distances(wide: DataFrame, order: str) -> DataFrame:
    """(i, j, distance) for i before j from the wide form; columns d_<n> count by their number."""
    columns = sorted((c for c in wide.columns if c.startswith("d_") and c[2:].isdigit()), key=lambda c: int(c[2:]))
    place = wide.select("key", (F.row_number().over(Window.orderBy(order)) - 1).alias("_n"))  # one row a group
    long = wide.select("key", F.posexplode(F.array(*columns)).alias("_j", "distance"))
    ends = place.select(F.col("key").alias("j"), F.col("_n").alias("_j"))
    return long.join(place, "key").filter("_j > _n").join(ends, "_j").select(F.col("key").alias("i"), "j", "distance")


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each readable JSON file, with its path; unreadable ones are left out."""
    raw = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").schema(f"{schema}, _bad string").json(path)
    return raw.select("*", F.col("_metadata.file_path").alias("file_path")).filter("_bad IS NULL").drop("_bad")


def fingerprint_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


#: Columns that a label log got later, and what older rows have there.
LATER = {"split": "train", "model_at_label": "none"}


def with_later_columns(log: DataFrame) -> DataFrame:
    """A label log with the later columns, of which rows written before them take the defaults."""
    return log.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(v)) if c in log.columns else F.lit(v) for c, v in LATER.items()})


def append_labels(df: DataFrame, path: str) -> None:
    """Appends to a label log; absent columns take their defaults."""
    with_later_columns(df).write.mode("append").parquet(path)


def read_label_table(spark: SparkSession, path: str) -> DataFrame:
    """A label log written by ``append_labels``, old files with the defaults of columns that they lack."""
    return with_later_columns(spark.read.option("mergeSchema", True).parquet(path))


def record_session(log: DataFrame, session: DataFrame) -> DataFrame:
    """The session log with the given sessions in place of older entries of the same id."""
    return log.join(session.select("session_id"), "session_id", "left_anti").select(log.columns).unionByName(session, allowMissingColumns=True)


def union_sources(own: DataFrame, library: DataFrame, path: str) -> DataFrame:
    """Own files first, then the library's that are not among them, each path once."""
    first = own.dropDuplicates([path])
    return first.unionByName(library.dropDuplicates([path]).join(first.select(path), path, "left_anti"), allowMissingColumns=True)


def remap(df: DataFrame, inventory: DataFrame, path: str) -> DataFrame:
    """Adds ``found``: the path where the inventory has it, else a file of the same name, nearest the root and then first by name; null if unresolved."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    inv = inventory.select(F.col(path).alias("_p")).distinct()
    by_name = inv.groupBy(name(F.col("_p")).alias("_n")).agg(F.min_by("_p", F.struct(F.size(F.split("_p", "/")), "_p")).alias("_near"))
    x = df.join(inv, F.col(path) == F.col("_p"), "left").withColumn("_n", name(F.col(path))).join(by_name, "_n", "left")
    return x.withColumn("found", F.coalesce("_p", "_near")).drop("_p", "_n", "_near")


def register_model(registry: DataFrame, model: DataFrame) -> DataFrame:
    """The registry with the model as its last entry (``position``), in place of one of the same name."""
    rest = registry.join(model.select("model_name"), "model_name", "left_anti").select(registry.columns)
    last = registry.agg(F.max("position")).first()[0] or 0
    return rest.unionByName(model.withColumn("position", F.lit(last + 1)), allowMissingColumns=True)


def latest_model(registry: DataFrame, model_type: str | None = None) -> DataFrame:
    """The last entry, of a type if one is given."""
    own = registry.filter(F.col("model_type") == model_type) if model_type else registry
    return own.orderBy(F.desc("position")).limit(1)


def update_model_runs(registry: DataFrame, name: str, runs: list[str]) -> DataFrame:
    """Adds run ids to a model's sorted set."""
    more = F.array_sort(F.array_union("run_ids", F.array(*[F.lit(x) for x in runs])))
    return registry.withColumn("run_ids", F.when(F.col("model_name") == name, more).otherwise(F.col("run_ids")))
