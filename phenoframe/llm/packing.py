"""Packed exchange of (document, 46-bit id) pairs: one row per task and bucket instead of one row per pair.

Ids are the upper 46 bits of 64-bit hashes and serve to find candidates only: two hashes that share an id add one, and what
is found is compared by wider hashes. The upper bits choose the bucket, so the others fit into five bytes;
document ids of a row are sorted and kept as differences in the narrowest type."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..worktable import materialize

ID_BITS = 46
#: Keys from here on stand for rows without a usable id.
OWN = 1 << 62
#: Bytes of pairs that a bucket should hold.
BUCKET_BYTES = 8 << 20
#: Pairs a task gathers before it packs them.
GATHER = 1_000_000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) with a key ``doc`` of each row's own, and (doc, name) for the rows whose key isn't their id.

    A row without an id, and all but one of the rows that repeat an id (the one whose text has the least hash keeps it), get keys
    above every id. Such rows are looked for first; where there are none, the id is the key and nothing is written."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    if own.groupBy("doc").count().filter("count > 1 OR doc IS NULL").isEmpty():
        return own, None
    rows = materialize(own.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("text")), "keyed")
    named, nameless = rows.filter("doc IS NOT NULL"), rows.filter("doc IS NULL")
    heads = named.groupBy("doc").agg(F.min(F.struct("h", "row"))["row"].alias("head"))
    fresh = F.lit(OWN) + F.col("row")
    named = named.join(heads, "doc").select(F.when(F.col("row") == F.col("head"), F.col("doc")).otherwise(fresh).alias("doc"), "text", F.col("doc").alias("name"))
    table = materialize(named.unionByName(nameless.select(fresh.alias("doc"), "text", F.lit(None).cast("long").alias("name"))), "keyed")
    return table.select("doc", "text"), table.filter(F.col("doc") >= OWN).select("doc", "name")


def unkeyed(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """``df`` with keys in ``columns`` turned back into ids."""
    for c in columns if names is not None else ():
        name = names.select(F.col("doc").alias(c), F.col("name").alias("_name"))
        df = df.join(name, c, "left").withColumn(c, F.when(F.col(c) >= OWN, F.col("_name")).otherwise(F.col(c))).drop("_name")
    return df


def sampled(own: DataFrame, docs: int) -> tuple[DataFrame, int]:
    """About ``docs`` documents by a hash of their key, and the number of all. Samples steer balance only, never a result."""
    total = max(1, own.count())
    draw = F.pmod(F.xxhash64(F.lit(6), "doc"), F.lit(1 << 20))
    return own.filter(draw < (1 << 20) * min(1.0, docs / total)), total


def bucket_bits(partitions: int, size: float = 0.0) -> int:
    """Buckets are a power of two, at least 64, the number of shuffle partitions, and what splits ``size`` bytes into BUCKET_BYTES."""
    wanted = max(64, partitions, int(size / BUCKET_BYTES))
    return min(24, int(wanted - 1).bit_length())


def by_buckets(df: DataFrame, size: float):
    """``df`` grouped by bucket, over as many partitions as ``size`` bytes need where the session has fewer."""
    parts = int(size / (8 * BUCKET_BYTES))
    return (df.repartition(parts, "b") if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df).groupBy("b")


def bucket_of(docs: np.ndarray, bits: int) -> np.ndarray:
    from .textops import mix

    return (mix(docs.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def pack_numbers(x: np.ndarray) -> bytes:
    """Sorted integers as their first value and differences, in the narrowest type that holds them."""
    if not len(x):
        return b""
    d = np.diff(x.astype(np.int64), prepend=x[:1]).view(np.uint64)
    most = int(d.max())
    width = next(w for w in (1, 2, 4, 8) if w == 8 or most < 1 << (8 * w))
    return bytes([width]) + int(x[0]).to_bytes(8, "little", signed=True) + d.astype(f"<u{width}").tobytes()


def unpack_numbers(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    d = np.frombuffer(b, f"<u{b[0]}", offset=9).astype(np.int64)
    return np.cumsum(d, dtype=np.int64) + int.from_bytes(b[1:9], "little", signed=True)


def pack_unsigned(x: np.ndarray) -> bytes:
    """Unsorted non-negative integers in the narrowest type."""
    most = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if w == 8 or most < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack_unsigned(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def pack_ids(ids: np.ndarray) -> bytes:
    """The lower five bytes of ids."""
    return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack_ids(b: bytes, bucket: int, bits: int) -> np.ndarray:
    low = np.zeros((len(b) // 5, 8), np.uint8)
    low[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    keep = ID_BITS - bits
    return (low.view("<u8").ravel() & np.uint64((1 << keep) - 1)) | np.uint64(bucket << keep)


def by_bucket(bucket: np.ndarray, docs: np.ndarray, *more: np.ndarray):
    """Yield (bucket, docs, ...) with rows sorted by document inside each bucket."""
    order = np.lexsort((docs, bucket))
    b, columns = bucket[order], [c[order] for c in (docs, *more)]
    values, first = np.unique(b, return_index=True)
    for v, a, z in zip(values.tolist(), first.tolist(), np.append(first, len(b))[1:].tolist(), strict=True):
        yield v, *(c[a:z] for c in columns)


def rows(out: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else schema.empty_table()


def send_ids(docs: np.ndarray, ids: np.ndarray, bits: int) -> list[tuple]:
    """Rows (bucket, kind 0, docs, ids, none)."""
    bucket = (ids >> np.uint64(ID_BITS - bits)).astype(np.int64)
    return [(b, 0, pack_numbers(d), pack_ids(i), b"") for b, d, i in by_bucket(bucket, docs, ids)]


def received_ids(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(docs, ids) of the rows of kind 0 of one bucket."""
    docs, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for b, kind, d, i in zip(*(table.column(c).to_pylist() for c in ("b", "kind", "docs", "ids")), strict=True):
        if kind == 0:
            docs.append(unpack_numbers(d))
            ids.append(unpack_ids(i, b, bits))
    return np.concatenate(docs), np.concatenate(ids)


SCHEMA = pa.schema([("b", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("ids", pa.binary()), ("more", pa.binary())])
DDL = "b long, kind int, docs binary, ids binary, more binary"
