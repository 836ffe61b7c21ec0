"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, mixing, BPE encoding.

Every stage takes all rows that the stage before it kept, and all but the last return the columns of ``documents``.
Each row is a document of its own: stages select by a key that they give to every row, so null and repeated ids
lose nothing and multiply nothing. Rows of equal text leave exact dedup as one row, whatever their ids. Null and empty texts leave at
language ID; texts are taken whole, however long; ties go by doc_id, then by the row's key; no documents give no rows. Columns beyond those
of ``documents`` go along, whatever their names: a stage's own columns take names that the table lacks. What a stage wrote on its way is deleted
once its result stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoframe.llm import bpe, dedup_exact, language_id, mixing, ngram_join
from phenoframe.worktable import materialize, new_path, scope


def _free(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it a name that no column of docs has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    name = "_" + name
    while name in taken:
        name = "_" + name
    return name


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs with a ``key`` of their own: doc_id where every row has one and none repeats, and nothing is written.

    Elsewhere rows are written with a number, so that it stays the same. Numbers of all partitions alternate, so they are close."""
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(key, F.col("doc_id"))
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(key, 33)
    parts = rows.agg(F.coalesce(F.max(part), F.lit(0)) + 1).first()[0]
    return rows.withColumn(key, F.col(key).bitwiseAND(F.lit((1 << 33) - 1)) * F.lit(parts) + part)


def _keep(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among keys (each once), without it."""
    return rows.join(keys.hint("shuffle_hash"), key, "left_semi").drop(key)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, row by row: texts in which no language can be told (``und``) go."""
    key = _free(docs, "row")
    tagged = language_id.language_id(docs.withColumn(key, F.struct(*docs.columns)), key_col=key)
    return tagged.filter("lang_pred <> 'und'").select(f"{key}.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts one row with the largest doc_id stays; a null id only where its group has no other."""
    key, pair = _free(docs, "row"), _free(docs, "pair")
    rows = _numbered(docs, key)
    judged = dedup_exact.exact_dedup(rows.withColumn(pair, F.struct("doc_id", key)), pair)
    return _keep(rows, judged.filter("kept").select(F.col(f"doc_id.{key}").alias(key)), key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one row with the smallest doc_id of each component stays; a null id only where no other is in it."""
    key = _free(docs, "row")
    rows = _numbered(docs, key)
    placed = ngram_join.ngram_join(rows, key).select(F.col("doc_id").alias(key), "component_id")
    placed = placed.join(rows.select(key, "doc_id").hint("shuffle_hash"), key)
    least = placed.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", key)).alias("least"))
    return _keep(rows, least.select(F.col(f"least.{key}").alias(key)), key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row appears as often as the mix takes it, a part counting once."""
    key, name, times, copy = (_free(docs, c) for c in ("row", "name", "times", "copy"))
    rows = _numbered(docs, key)
    # Null ids are ordered by their texts, so that they are dealt as others are.
    named = rows.withColumn(name, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64("text").cast("string"))))
    taken = mixing.mix(named, name, key_col=key).filter("size > 0 AND taken > 0")
    taken = taken.select(key, F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times))
    repeated = rows.join(taken.hint("shuffle_hash"), key)
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token counts and digests of ids and decoded text."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language ID, n-gram shingles and BPE have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
