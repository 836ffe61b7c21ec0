"""Token ids in Arrow's file format: batches of fixed-size lists that a reader maps into memory without copying.

A data set is a folder of shards. A shard holds one record batch after another of the columns ``ids`` (a
fixed-size list of SEQUENCE ids) and ``mask`` (as many booleans: whether the id is part of the data). The ids of
its documents follow one another in ascending order of doc_id; only the last sequence is padded. The shards' manifest rows
(doc_id, shard, place, n_tokens) are a Parquet table beside them.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..worktable import materialize, new_path
from . import textops as T
from .bpe import BLOCK, default_tokenizer, encoder

SEQUENCE = 2048
#: Sequences a record batch.
BATCH = 256


def id_type(vocabulary: int) -> pa.DataType:
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


class ShardWriter:
    """Writes one shard; the file gets its name when it is whole, so that a task that runs again replaces it."""

    def __init__(self, folder: str, shard: int, kind: pa.DataType, sequence: int = SEQUENCE):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{root}/shard-{shard:06d}.arrow"
        self.temp = f"{root}/.{uuid.uuid4().hex}"
        self.kind, self.sequence, self.place = kind, sequence, 0
        self.dtype = kind.to_pandas_dtype()
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = self.fs.open_output_stream(self.temp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        self.place += len(ids)
        size = self.sequence * BATCH
        if self.waiting >= size:
            flat = np.concatenate(self.rest)
            whole = len(flat) // size * size
            for at in range(0, whole, size):
                self._write(flat[at : at + size], size)
            self.rest, self.waiting = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, live: int) -> None:
        mask = np.arange(len(flat)) < live
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(a, k), self.sequence) for a, k in ((flat, self.kind), (mask, pa.bool_()))]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([*self.rest, np.zeros(0, self.dtype)])
        if len(flat):
            pad = -len(flat) % self.sequence
            self._write(np.concatenate([flat, np.zeros(pad, self.dtype)]), len(flat))
        self.out.close()
        self.sink.close()
        self.fs.move(self.temp, self.final)


class ShardReader:
    """Random access to a shard by place, over the mapped file where the store is a local path."""

    def __init__(self, folder: str, shard: int):
        fs, root = filesystem(folder)
        path = f"{root}/shard-{shard:06d}.arrow"
        source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.shard, self.at, self.flat = shard, -1, None

    def batch(self, k: int) -> np.ndarray:
        if k != self.at:
            ids = self.reader.get_batch(k).column(0)
            self.at, self.flat = k, ids.flatten().to_numpy(zero_copy_only=True)
        return self.flat

    def __len__(self) -> int:
        """Sequences of the shard."""
        batches = self.reader.num_record_batches
        return (batches - 1) * BATCH + self.reader.get_batch(batches - 1).num_rows if batches else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Sequence ``i``: its ids and its mask, both views of the mapped file (the mask in bits, as it is stored)."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k, row = divmod(i, BATCH)
        batch = self.reader.get_batch(k)
        ids, mask = (batch.column(c).flatten().slice(row * self.sequence, self.sequence) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def read(self, place: int, n: int) -> np.ndarray:
        size, parts = self.sequence * BATCH, []
        while n > 0:
            k, inside = divmod(place, size)
            part = self.batch(k)[inside : inside + n]
            parts.append(part)
            place, n = place + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def write_tokens(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 2,
    shards: int | None = None, sequence: int = SEQUENCE,
) -> DataFrame:
    """Encode, append ``end_id`` to each document, write the shards, and return the manifest (doc_id, shard, place, n_tokens).

    Documents are dealt to shards by ranges of their id, so shards follow one another in ascending order. Equal ids stand in the
    order of their texts; a null id comes first. Null texts are empty: only the end id. No documents: no shards."""
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sorted_docs = own.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, out = encoder(path), None
        kind = id_type(max(len(e.byte_length), (end_id or 0) + 1))
        for b in batches:
            if b.num_rows and out is None:
                out = ShardWriter(folder, b.column(2)[0].as_py(), kind, sequence)
            for i, j, data, offsets in T.blocks(T.column(b, "text"), BLOCK):
                ids, first = e.encode(data, offsets)
                length = np.diff(first)
                if end_id is not None:
                    ids = np.insert(ids, first[1:], end_id)
                    length = length + 1
                place = out.place + np.cumsum(length) - length
                out.add(ids)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(place), pa.array(length)], ["doc_id", "shard", "place", "n_tokens"]
                )
        if out is not None:
            out.close()

    return materialize(sorted_docs.mapInArrow(write, "doc_id long, shard int, place long, n_tokens long"), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the manifest, read back from the shards: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. The window that adds up the shards runs over one row a shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = sizes.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))
    placed = manifest.join(F.broadcast(base), "shard").select("doc_id", "shard", "place", "n_tokens", (F.col("base") + F.col("place")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            crc = []
            for s, place, n in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if shard is None or shard.shard != s:
                    shard = ShardReader(folder, s)
                crc.append(zlib.crc32(shard.read(place, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), b.column(3), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return os.fspath(new_path(spark, "tokens"))
