"""Work tables in the shared folder of the cluster, used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a temporary one where it is unset. A cluster must name one that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="phenoframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_SCOPE: ContextVar[str] = ContextVar("work table scope", default="")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/phenoframe/{_SCOPE.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Work tables made inside are deleted at the end: write what is to stay before that, to a path made outside."""
    inner = f"{_SCOPE.get()}scope-{uuid.uuid4().hex}/"
    token = _SCOPE.set(inner)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/phenoframe/{inner}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
