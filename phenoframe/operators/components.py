"""Principal components of vectors: one pass for their sums and products, a solve of the size of their features, one pass for the scores."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Rows whose products a task adds up at a time.
ROWS = 4096


class Components(NamedTuple):
    """``axes`` (kept, components), the ``mean`` of the kept features, the ``variances`` of the components taken and the share of all that each ``explains``."""

    kept: list[int]
    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    explains: np.ndarray


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of an array column; what isn't a finite number is NaN."""
    x = np.array([[np.nan if v is None else v for v in row] for row in vectors.to_pylist() if row is not None], float)
    return np.where(np.isfinite(x), x, np.nan)


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, finite values, sums, products) of the features of an array column, what isn't finite counting as 0 in sums and products.

    A task adds up its rows as whole matrices and gives one row a feature; rows of a feature are added up by one task, so what comes to the driver is
    as large as the features, squared."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, have, total, gram = 0, [], 0, 0, 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = _matrix(b.column(0).slice(at, ROWS))
                if len(x):
                    held = np.isfinite(x)
                    x = np.where(held, x, 0.0)
                    n, have, total, gram = n + len(x), have + held.sum(0), total + x.sum(0), gram + x.T @ x
        if n:
            d = len(total)
            parts = [pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(have), pa.array(total), pa.array([g.tobytes() for g in gram], pa.binary())]
            yield pa.RecordBatch.from_arrays(parts, ["i", "n", "have", "total", "gram"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for i, n, have, total, g in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                row = np.frombuffer(g)
                old = held.get(i)
                held[i] = [n, have, total, row] if old is None else [old[0] + n, old[1] + have, old[2] + total, old[3] + row]
        columns = list(zip(*held.values(), strict=True)) if held else [[], [], [], []]
        out = [pa.array(list(held), pa.int32()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array([g.tobytes() for g in columns[3]], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, ["i", "n", "have", "total", "gram"])

    schema = "i int, n long, have long, total double, gram binary"
    rows = df.select(vector).mapInArrow(count, schema).repartition("i").mapInArrow(add, schema).collect()
    rows.sort(key=lambda r: r["i"])
    if not rows:
        return 0, np.zeros(0), np.zeros(0), np.zeros((0, 0))
    return rows[0]["n"], *(np.array([r[c] for r in rows], float) for c in ("have", "total")), np.stack([np.frombuffer(r["gram"]) for r in rows])


def fit_components(df: DataFrame, vector: str, share: float | None = 0.95, most: int | None = None, above: int = 0) -> Components | None:
    """Components of the array column ``vector``: the fewest that explain more than ``share`` of the variance, ``most`` at most.

    Features that are never a finite number are dropped; elsewhere such values count as 0. With ``above`` features or fewer, fewer than two rows, or no
    variance there is nothing to reduce: None. Signs of axes are such that the largest entry is positive."""
    n, have, total, gram = moments(df, vector)
    kept = np.flatnonzero(have > 0)
    if n < 2 or len(kept) <= above:
        return None
    mean = total[kept] / n
    cov = (gram[np.ix_(kept, kept)] - n * np.outer(mean, mean)) / (n - 1)
    values, axes = np.linalg.eigh(cov)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
    if not values.sum() > 0:
        return None
    part = values / values.sum()
    take = min(len(kept), n)
    if share is not None:
        take = min(take, int(np.searchsorted(np.cumsum(part), share, side="right")) + 1)
    take = min(take, most) if most else take
    axes = axes[:, :take]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(take)])
    return Components(kept.tolist(), mean, axes, values[:take], part[:take])


def reduce_vectors(df: DataFrame, vector: str, fitted: Components | None, out: str) -> DataFrame:
    """Adds ``out``: the scores of each vector on the components; without components the vector itself, with 0 for what isn't finite. A null vector stays null."""
    if fitted is None:
        number = F.col(vector).cast("array<double>")
        return df.withColumn(out, F.transform(number, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)))
    shared = df.sparkSession.sparkContext.broadcast(fitted)  # features times components
    rest = df.drop(out).withColumn("_v", F.col(vector).cast("array<double>"))
    schema = rest.drop("_v").schema.add(out, ArrayType(DoubleType()))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                vectors = part.column(part.num_columns - 1)
                x = _matrix(vectors)
                scores = iter(((np.nan_to_num(x[:, c.kept]) - c.mean) @ c.axes).tolist() if len(x) else [])
                column = pa.array([next(scores) if v.is_valid else None for v in vectors], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], [*part.schema.names[:-1], out])

    return rest.mapInArrow(project, schema)
