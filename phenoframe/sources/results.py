"""Sets of result tables that become readable at once."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def _at(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_results(tables: dict[str, DataFrame], path: str, manifest: dict[str, Any], formats: tuple[str, ...] = ("parquet", "csv")) -> str:
    """Write every table in each format, then the manifest that names them; returns the version written.

    A version's tables go to a folder of their own. The manifest is written beside the old one and renamed over it last, so a killed write leaves the old
    results, or none, readable and never a part of the new ones. Tables without columns are left out, as they say nothing; tables without rows
    stay. CSV takes one file a partition with a header. Names of tables are names of folders."""
    if not tables:
        raise ValueError("no result tables")
    spark = next(iter(tables.values())).sparkSession
    version, named = f"v-{uuid.uuid4().hex}", {}
    for name, df in sorted(tables.items()):
        if not df.columns:
            continue
        for f in formats:
            writer = df.write.option("header", True) if f == "csv" else df.write
            writer.format(f).save(f"{path}/{version}/{name}.{f}")
        named[name] = {"schema": json.loads(df.schema.json()), "formats": list(formats)}
    fs, draft = _at(spark, f"{path}/{version}/{MANIFEST}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps({**manifest, "version": version, "tables": named}, indent=2, sort_keys=True, default=str).encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}"), over)
    return version


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The manifest of the results at ``path``; None where no write has ended."""
    fs, p = _at(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{path}/{MANIFEST}").collect()))  # one small file


def read_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that the manifest names, from their first format; an error where no write has ended."""
    from pyspark.sql.types import StructType

    manifest = read_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no finished results at {path}")
    out = {}
    for name, t in manifest["tables"].items():
        f = t["formats"][0]
        out[name] = spark.read.schema(StructType.fromJson(t["schema"])).format(f).option("header", True).load(f"{path}/{manifest['version']}/{name}.{f}")
    return out
