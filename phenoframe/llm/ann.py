"""Approximate nearest neighbours by inner product: an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..worktable import materialize


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids of rows by Lloyd's rounds, in numpy (x is the bounded sample)."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)


def traverse(near1: np.ndarray, near2: np.ndarray, counts: np.ndarray, wanted: int) -> float:
    """The multi-sequence walk: visit centroid pairs by falling summed inner product until ``wanted`` entries
    are seen. Returns the sum of the last pair visited, so that the pairs visited are those not below it.

    near1, near2: inner products of the query's halves with the centroids; counts: entries of each pair."""
    o1, o2 = np.argsort(-near1, kind="stable"), np.argsort(-near2, kind="stable")
    a, b = near1[o1].tolist(), near2[o2].tolist()
    pairs = counts[np.ix_(o1, o2)].tolist()
    heap, seen, last = [(-(a[0] + b[0]), 0, 0)], 0, a[0] + b[0]
    # A pair (i, j) enters by (i, j - 1); only the first of a row enters by the row before it.
    while heap and seen < wanted:
        s, i, j = heapq.heappop(heap)
        last = -s
        seen += pairs[i][j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return last if seen >= wanted else -np.inf


#: Cells are scored one by one where they hold so many entries or more, smaller neighbours together.
TOGETHER = 64


class Block:
    """The entries of one block of the index, cell by cell."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, cell: np.ndarray, n2: int, k: int):
        # Of equal vectors only the k + 1 smallest ids of the block can be among a query's best k.
        order = np.argsort(ids, kind="stable")
        ids, x, cell = ids[order], x[order], cell[order]
        _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
        by = np.argsort(group, kind="stable")
        sizes = np.bincount(group)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = np.flatnonzero(rank <= k)
        keep = keep[np.argsort(cell[keep], kind="stable")]
        self.ids, self.x, self.k = ids[keep], x[keep], k
        cells, first = np.unique(cell[keep], return_index=True)
        self.one, self.two, self.first = cells // n2, cells % n2, np.append(first, len(keep))
        # Runs of neighbouring cells that are scored together: one cell each, but for cells of few entries.
        self.runs, at = [0], 0
        for c in range(1, len(cells)):
            if self.first[c] - self.first[at] >= TOGETHER:
                self.runs.append(c)
                at = c
        self.runs.append(len(cells))

    def best(self, q_ids: np.ndarray, q: np.ndarray, low: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k entries for each query among the cells that it visits, those whose sum is not below ``low``; runs of cells that it doesn't visit are not scored."""
        half, k = c1.shape[1], self.k
        visits = (q[:, :half] @ c1.T)[:, self.one] + (q[:, half:] @ c2.T)[:, self.two] >= low[:, None] - 1e-9
        s = np.full((len(q), len(self.ids)), -np.inf)
        for c, d in zip(self.runs[:-1], self.runs[1:], strict=True):
            who, a, z = np.flatnonzero(visits[:, c:d].any(1)), self.first[c], self.first[d]
            near = q[who] @ self.x[a:z].T
            if d - c > 1:
                near[~np.repeat(visits[who, c:d], np.diff(self.first[c : d + 1]), axis=1)] = -np.inf
            s[who, a:z] = near
        s[q_ids[:, None] == self.ids[None, :]] = -np.inf
        if len(self.ids) > k:
            least = np.partition(s, len(self.ids) - k, axis=1)[:, len(self.ids) - k]
            row, at = np.nonzero((s >= (least - 1e-9)[:, None]) & (s > -np.inf))
        else:
            row, at = np.nonzero(s > -np.inf)
        exact = (q[row] * self.x[at]).sum(1)
        order = np.lexsort((self.ids[at], -exact, row))
        row, at, exact = row[order], at[order], exact[order]
        first = np.searchsorted(row, np.arange(len(q)))
        best = (np.arange(len(row)) - first[row]) < k
        return q_ids[row[best]], self.ids[at[best]], exact[best]


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest_neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_every: int = 20,
    centroids: int = 192, visit: float = 0.33, least: int = 1000, sample: int = 20_000, index_rows: int = 4096, query_rows: int = 1024,
) -> DataFrame:
    """The ``k`` nearest of each query by inner product: query_id, rank, vec_id, score.

    Queries are the rows whose id divides by ``query_every``; candidates are all rows but the query's own.
    Both halves get ``centroids`` centroids from about ``sample`` rows (a documented, bounded sample); every row is indexed. A query visits
    pairs until it has seen ``visit`` times the number of all rows, ``least`` at least, equal vectors counting ``k`` + 1 times at most. Vectors whose entries spread evenly in all
    directions need the large default share for a recall of 0.9; clustered ones need far less. The index is cut into blocks of at
    most about ``index_rows`` rows, a pair of cells larger than a block being split by a hash of
    the id. It moves once; queries are sent to the blocks that they visit, and stream past each in pieces of ``query_rows``, being scored against the cells they visit only. Vectors null, zero, of another length than the most, or with null or
    non-finite components take no part; neither do rows without an id. Ties go to the smaller id. Repeated ids are entries of their own
    but never each other's neighbours. An empty table gives an empty result."""
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        usable(F.col("v")) & F.col("id").isNotNull()
    )
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim, rows = sizes[0]["d"], sizes[0]["count"]
    good = good.filter(F.size("v") == dim)
    half = dim - dim // 2
    draw = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 20))
    picked = good.filter(draw < (1 << 20) * min(1.0, sample / rows)).orderBy(draw, "id").limit(2 * sample).select("v").collect()
    x = np.array([r["v"] for r in picked], np.float64).reshape(-1, dim)
    if not len(x):
        return empty
    count = max(1, min(centroids, rows // 50))
    c1, c2 = kmeans(x[:, :half], count, seed=1), kmeans(x[:, half:], count, seed=2)
    n2 = len(c2)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), dim)
            cell = nearest(v[:, :half], c1) * n2 + nearest(v[:, half:], c2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    index = materialize(good.mapInArrow(assign, "id long, v array<double>, cell int"), "ann-index")
    counts = np.zeros(len(c1) * n2, np.int64)  # centroids squared values at most
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    # Of equal vectors k + 1 can be of use to a query, so no more of them count as visited.
    useful = np.zeros(len(counts), np.int64)
    alike = index.groupBy("cell", F.xxhash64("v").alias("h")).count()
    for r in alike.groupBy("cell").agg(F.sum(F.least(F.col("count"), F.lit(k + 1))).alias("n")).collect():
        useful[r["cell"]] = r["n"]
    # Blocks of the index: cells in order, a new block every ``index_rows`` rows; a larger cell has blocks of its own.
    block, own, at, filled = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if n > index_rows:
            at, filled = at + (filled > 0), 0
            block[cell], own[cell] = at, -(-n // index_rows)
            at += own[cell]
        else:
            if filled + n > index_rows:
                at, filled = at + 1, 0
            block[cell], filled = at, filled + n
    blocks = int(at + (filled > 0))
    last = block + own - 1
    wanted = min(rows, max(least, int(visit * rows)))
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, salt = b.column(2).to_numpy(), b.column(3).to_numpy()
            where = block[cell] + salt % own[cell]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(where.astype(np.int32))], ["id", "v", "cell", "b"])

    salt = F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(1 << 30)).cast("int")
    entries = index.withColumn("salt", salt).mapInArrow(place, "id long, v array<double>, cell int, b int")
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = useful.reshape(len(c1), n2)
        for b in batches:
            q = _matrix(b.column(1), dim)
            near1, near2 = q[:, :half] @ c1.T, q[:, half:] @ c2.T
            limit = np.array([traverse(s, t, grid, wanted) for s, t in zip(near1, near2, strict=True)])
            seen = []
            for s, t, low in zip(near1, near2, limit, strict=True):
                visited = np.flatnonzero(((s[:, None] + t[None, :]).ravel() >= low - 1e-9) & (counts > 0))
                hit = np.zeros(blocks + 1, np.int64)  # marks where runs of blocks begin and end
                np.add.at(hit, block[visited], 1)
                np.add.at(hit, last[visited] + 1, -1)
                seen.append(np.flatnonzero(np.cumsum(hit)[:blocks] > 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(limit), pa.array(seen, pa.list_(pa.int32()))], ["id", "v", "low", "seen"]
            )

    asked = index.filter(F.col("id") % query_every == 0).select("id", "v")
    asked = asked.mapInArrow(walk, "id long, v array<double>, low double, seen array<int>")
    asked = asked.select(F.explode("seen").alias("b"), F.lit(1).alias("kind"), "id", "v", F.lit(0).alias("cell"), "low")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, index = None, [], None
        for batch in batches:
            b, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(b * 2 + kind)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
                if a == z:
                    continue
                ids, v = batch.column(2).slice(a, z - a).to_numpy(), _matrix(batch.column(3).slice(a, z - a), dim)
                if b[a] != now:
                    now, parts, index = b[a], [], None
                if kind[a] == 0:
                    parts.append((ids, v, batch.column(4).slice(a, z - a).to_numpy()))
                    continue
                if index is None:
                    index = Block(*(np.concatenate(p) for p in zip(*parts, strict=True)), n2, k)
                low = batch.column(5).slice(a, z - a).to_numpy()
                for i in range(0, z - a, query_rows):
                    found = index.best(ids[i : i + query_rows], v[i : i + query_rows], low[i : i + query_rows], c1, c2)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    placed = entries.select("b", F.lit(0).alias("kind"), "id", "v", "cell", F.lit(0.0).alias("low"))
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 8)
    meeting = placed.unionByName(asked).repartition(parts, "b").sortWithinPartitions("b", "kind")
    found = meeting.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
