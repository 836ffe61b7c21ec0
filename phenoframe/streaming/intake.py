"""Streams that keep a table current: the latest label of each object, and new samples that pass the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..worktable import materialize
from ..operators.filters import filter_min
from ..operators.joins import latest


#: Parts of a latest table by the hash of its key.
PARTS = 64


def _newest(spark: SparkSession, schema: StructType, sink: str, parts: list[int] | None = None, below: int | None = None) -> DataFrame:
    """The newest version of each part (of these parts, before a batch)."""
    rows = spark.read.schema(StructType(schema.fields + [StructField("part", IntegerType()), StructField("batch", LongType())])).parquet(sink)
    rows = rows if parts is None else rows.filter(F.col("part").isin(parts))
    rows = rows if below is None else rows.filter(F.col("batch") < below)
    newest = rows.select("part", "batch").groupBy("part").agg(F.max("batch").alias("batch"))  # names of folders: one row a part
    return rows.join(F.broadcast(newest), ["part", "batch"], "left_semi")


def stream_latest_labels(spark: SparkSession, path: str, schema: str, sink: str, key: str, ts: str, seq: str, checkpoint: str) -> StreamingQuery:
    """Merges label rows that arrive at ``path`` into the latest table at ``sink``; read it by ``current_labels``.

    The table is in ``PARTS`` parts by the key. A batch reads and writes only the parts that its rows are in, as versions named after it, so one that is run again after
    a failure gives the same table; it drops versions behind the one that it read."""

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        own = materialize(batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")), "labels-batch")
        touched = [r["part"] for r in own.select("part").distinct().collect()]
        if not touched:
            return
        both, old = own, []
        fs = s.sparkContext._jvm.org.apache.hadoop.fs.Path(sink).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(s.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)):
            before = _newest(s, batch.schema, sink, touched, number)
            both = own.unionByName(before.drop("batch"))
            old = before.select("part", "batch").distinct().collect()  # a row a part
        columns = [*batch.columns, "part"]
        new = latest(both, key, ts, seq).select(*columns, F.lit(number).cast("long").alias("batch"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(sink)
        for part, last in old:
            for status in fs.listStatus(s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sink}/part={part}")):
                name = status.getPath().getName()
                if name.startswith("batch=") and int(name[6:]) < last:
                    fs.delete(status.getPath(), True)

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()


def current_labels(spark: SparkSession, sink: str) -> DataFrame:
    """The newest version of all parts of a latest table."""
    schema = StructType([f for f in spark.read.parquet(sink).schema.fields if f.name not in ("part", "batch")])
    return _newest(spark, schema, sink).drop("part", "batch")


def stream_intake(spark: SparkSession, path: str, schema: str, thresholds: dict[str, float], sink: str, checkpoint: str) -> StreamingQuery:
    """Appends rows of new sample files that pass the thresholds; the file log in ``checkpoint`` skips finished files."""
    passed = filter_min(spark.readStream.schema(schema).parquet(path), thresholds)
    return passed.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
