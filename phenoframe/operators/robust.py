"""Exact median slopes over all pairs of points, and average ranks, without making the pairs: the fit of one channel's bleed into another.

Equal points are merged and counted. A pair has a slope below t where the residuals y - t x stand against the order of x, so slopes below t are
counted as inversions, block by block. A bracket around the median narrows by such counts, at slopes of a sample's pairs that lie in it; pairs
are made only of the last one. A key that is no larger than a sample is solved in one block."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..worktable import materialize

#: Blocks of a key's values, for ranks.
BLOCKS = 64
#: Points of a block, and the most blocks of a key along the residuals.
SIZE, RESIDUAL_BLOCKS = 32_768, 256
#: Points of a key's sample, and slopes drawn from its pairs in a bracket.
SAMPLE, DRAWN = 65_536, 50_000
#: Slopes of a key's last bracket.
MOST = 500_000
#: A bracket as narrow as this share of the spread of y over that of x holds slopes that are equal but for rounding.
RESOLUTION = 1e-13
ROUNDS = 200


def average_ranks(df: DataFrame, keys: list[str], column: str, name: str, weight: Column | None = None) -> DataFrame:
    """Adds ``name``: the rank of ``column`` within its key from 1, equal values sharing their mean; a row stands for ``weight`` rows. Values are
    counted before they are sorted, and sorted within blocks."""
    counts = materialize(df.groupBy(*keys, column).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n")), "rank-counts")
    edges = F.percentile_approx(column, [k / BLOCKS for k in range(1, BLOCKS)], 20 * BLOCKS)
    step = lambda at, s: F.when((at + s < BLOCKS) & (F.get("_edges", at + s - 1) < F.col(column)), at + s).otherwise(at)
    steps = F.array(*[F.lit(2**k) for k in reversed(range(BLOCKS.bit_length()))])
    v = counts.join(counts.groupBy(*keys).agg(edges.alias("_edges")), keys).withColumn("_b", F.aggregate(steps, F.lit(0), step)).drop("_edges")  # the edges below a value, by halving
    v = materialize(v, "rank-blocks")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over blocks, BLOCKS a key
    sums = v.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m")).select(*keys, "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    placed = v.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(sums, [*keys, "_b"])
    ranks = placed.select(*keys, column, (F.col("_before") + F.col("_in") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, [*keys, column])


def _levels(values: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of places i < j with values[i] > values[j], bit by bit from the highest of the ranks: (right, left, first, last), where the place
    right[k] makes pairs with left[first[k]:last[k]]."""
    n = len(values)
    rank, at = np.empty(n, np.int64), np.arange(n)
    rank[np.argsort(values, kind="stable")] = at
    ids = at
    for bit in reversed(range((max(n, 1) - 1).bit_length())):
        one = (rank >> bit) & 1 == 1
        first, last = (rank >> bit + 1) << bit, np.cumsum(one)
        yield ids[~one], ids[one], first[~one], last[~one]
        to = np.where(one, first + (1 << bit) + last - 1, at - (last - first))  # zeros of a group before its ones
        moved, rank, was, ids = rank, np.empty_like(rank), ids, np.empty_like(ids)
        rank[to], ids[to] = moved, was


def _sums(weights: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(weights)])


def inversions(values: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Pairs of places i < j with values[i] > values[j]; each counts as often as the product of its weights."""
    total = 0
    for right, left, first, last in _levels(values):
        if weights is None:
            total += int((last - first).sum())
        else:
            upto = _sums(weights[left])
            total += int((weights[right] * (upto[last] - upto[first])).sum())
    return total


def _order(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """The order of points, sorted by x and y, by their residuals at t."""
    if np.isinf(t):
        return np.arange(len(x)) if t < 0 else np.lexsort((y, -x))
    return np.argsort(y - t * x, kind="stable")


def _between(x: np.ndarray, y: np.ndarray, lo: float, hi: float) -> Iterator[tuple[np.ndarray, ...]]:
    """The pairs of points, sorted by x and y, with a slope from ``lo`` to below ``hi``, in the form of _levels."""
    order, rank = _order(x, y, lo), np.empty(len(x), np.int64)
    rank[_order(x, y, hi)] = np.arange(len(x))
    for right, left, first, last in _levels(rank[order]):
        yield order[right], order[left], first, last


def _made(x: np.ndarray, y: np.ndarray, w: np.ndarray, right: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and weights of pairs; those whose x are in turn, in turn only by rounding, are left out."""
    keep = x[left] < x[right]
    right, left = right[keep], left[keep]
    return (y[right] - y[left]) / (x[right] - x[left]), w[right] * w[left]


def _pairs(levels: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs as (right, left)."""
    rights, lefts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for right, left, first, last in levels:
        n = last - first
        rights.append(np.repeat(right, n))
        lefts.append(left[np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())])
    return np.concatenate(rights), np.concatenate(lefts)


def _drawn(x: np.ndarray, y: np.ndarray, w: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, int]:
    """Slopes of random pairs from ``lo`` to below ``hi``, sorted, and how many distinct pairs there are."""
    rng, levels, number = np.random.default_rng(0), [], 0
    for right, left, first, last in _between(x, y, lo, hi):
        upto = _sums(w[left])
        levels.append((right, left, upto, upto[first], upto[last], np.cumsum(w[right] * (upto[last] - upto[first]))))
        number += int((last - first).sum())
    masses = np.array([level[-1][-1] if len(level[-1]) else 0 for level in levels], float)
    if not masses.sum():
        return np.empty(0), 0
    out = []
    for (right, left, upto, first, last, mass), n in zip(levels, rng.multinomial(DRAWN, masses / masses.sum()), strict=True):
        if n:
            k = np.searchsorted(mass, rng.integers(0, mass[-1], n), "right")
            out.append(_made(x, y, w, right[k], left[np.searchsorted(upto, rng.integers(first[k], last[k]), "right") - 1])[0])
    return np.sort(np.concatenate(out)), number


def _nudge(t: float, unit: float) -> float:
    return max(unit * RESOLUTION, abs(t) * 1e-15)


def _tight(lo: float, hi: float, unit: float) -> bool:
    return bool(np.isfinite(lo) and np.isfinite(hi) and hi - lo <= 4 * _nudge(max(abs(lo), abs(hi)), unit))


def _middle(lo: float, hi: float) -> float:
    """Of slopes equal but for rounding: the middle, or 0 where the bracket holds it."""
    return 0.0 if lo <= 0 <= hi else (lo + hi) / 2


def _probes(slopes: np.ndarray, low: float, high: float, margin: float, lo: float, hi: float, unit: float, step: int) -> list[float]:
    """Two slopes between ``lo`` and ``hi``: those at the shares ``low`` and ``high`` of the drawn ones and a margin, else the thirds."""
    far = unit * 4.0 ** min(step + 1, 400)
    a, b = lo if np.isfinite(lo) else min(hi, 0.0) - far, hi if np.isfinite(hi) else max(lo, 0.0) + far
    thirds, out = [a + (b - a) / 3, b - (b - a) / 3], []
    for k, (share, sign) in enumerate(((low - margin, -1), (high + margin, 1))):
        t = slopes[int(np.clip(share * len(slopes), 0, len(slopes) - 1))] if len(slopes) else np.nan
        t = t + sign * _nudge(t, unit)
        out.append(float(t) if lo < t < hi else thirds[k])
    return out


def _at(slopes: np.ndarray, weights: np.ndarray, rank: int) -> float:
    order = np.argsort(slopes, kind="stable")
    return float(slopes[order][min(len(order) - 1, int(np.searchsorted(np.cumsum(weights[order]), rank, "right")))])


def slope_at(x: np.ndarray, y: np.ndarray, w: np.ndarray, rank: int, pairs: int, unit: float, most: int = MOST) -> float:
    """The slope of that rank, from 0, among the pairs of points sorted by x and y."""
    lo, hi, below, upto = -np.inf, np.inf, 0, pairs
    for step in range(ROUNDS):
        if upto - below <= most:
            slopes, weights = _made(x, y, w, *_pairs(_between(x, y, lo, hi)))
            return _at(slopes, weights, rank - below) if len(slopes) else _middle(lo, hi)
        if _tight(lo, hi, unit):
            return _middle(lo, hi)
        share = (rank + 0.5 - below) / (upto - below)
        slopes = _drawn(x, y, w, lo, hi)[0] if step % 8 < 6 else np.empty(0)
        for t in _probes(slopes, share, share, 1.5 / DRAWN**0.5, lo, hi, unit, step):
            if lo < t < hi:
                n = inversions(y - t * x, w)
                lo, below, hi, upto = (t, n, hi, upto) if n <= rank else (lo, below, t, n)
    raise RuntimeError("the bracket of a median slope doesn't narrow")


def _bytes(a: np.ndarray) -> bytes:
    """Doubles, or counts in as few bytes as they need."""
    return a.tobytes() if a.dtype == np.float64 else a.astype(np.min_scalar_type(int(a.max()))).tobytes()


def _doubles(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64)


def _counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64)


def _points(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = _doubles(row.x)
    return x, _doubles(row.y), _counts(row.w, len(x))


def _kind(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _edges(x: np.ndarray, y: np.ndarray, t: float, blocks: int) -> list[float]:
    """Where the blocks of the residuals at t part, from a sample of the points. A residual that is an edge is a block of its own."""
    r = np.sort(y - t * x)
    return np.unique(r[np.arange(1, blocks) * len(r) // blocks]).tolist()


def _block(r: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even numbers between edges, odd ones on them."""
    return np.searchsorted(edges, r, "left") + np.searchsorted(edges, r, "right")


def _cut(keys: list[str]):
    """Packs rows sorted by key, x and y into blocks of SIZE; their numbers rise along a key."""

    def pack(frames: list[pd.DataFrame], number: int) -> pd.DataFrame:
        pdf = pd.concat(frames)
        row = (*(pdf[k].iloc[0] for k in keys), (TaskContext.get().partitionId() << 32) + number, *(_bytes(pdf[c].to_numpy()) for c in ("x", "y", "w")))
        return pd.DataFrame([row], columns=[*keys, "xb", "x", "y", "w"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, held, last, number = [], 0, None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            starts = [0, *(np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()[1:]) + 1), len(pdf)]
            for a, b in zip(starts, starts[1:]):
                key = tuple(pdf[k].iloc[a] for k in keys)
                while a < b:
                    if open_ and (key != last or held >= SIZE):
                        yield pack(open_, number)
                        open_, held, number = [], 0, number + 1
                    take = pdf.iloc[a : min(b, a + SIZE - held)]
                    open_, held, last, a = [*open_, take], held + len(take), key, a + len(take)
        if open_:
            yield pack(open_, number)

    return cut


def slopes_below(blocks: DataFrame, keys: list[str], probes: DataFrame) -> DataFrame:
    """(keys, part, probe, below): how many pairs of the points, packed as (keys, xb, x, y, w), have a slope below t, for each of ``probes`` (keys,
    part, probe, t, edges).

    Pairs of one block along x are counted there. The others' residuals meet in blocks between the edges; pairs of different blocks both
    ways follow from the sizes of the crossings."""
    own = [*keys, "part", "probe"]
    sent = blocks.join(probes, keys)
    kind = _kind(sent, own)

    def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, y, w = _points(row)
                r, key, edges = y - row.t * x, [getattr(row, c) for c in own], np.asarray(row.edges, float)
                rows = [(*key, -1, row.xb, inversions(r, w), 0, None, None)]
                order = np.argsort(r, kind="stable")
                r, w = r[order], w[order]
                rb = _block(r, edges)
                ends = [0, *(np.flatnonzero(np.diff(rb)) + 1), len(r)]
                for a, b in zip(ends, ends[1:]):
                    rows.append((*key, int(rb[a]), row.xb, 0, int(w[a:b].sum()), *((None, None) if rb[a] % 2 else (_bytes(r[a:b]), _bytes(w[a:b])))))
                yield pd.DataFrame(rows, columns=[*own, "rb", "xb", "below", "n", "r", "w"])

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rb, below = pdf.sort_values("xb"), int(key[-1]), int(pdf["below"].sum())
        if rb >= 0 and rb % 2 == 0:
            r = [_doubles(raw) for raw in pdf["r"]]
            below = inversions(np.concatenate(r), np.concatenate([_counts(raw, len(v)) for raw, v in zip(pdf["w"], r, strict=True)]))
        sizes = [[], []] if rb < 0 else [pdf["xb"].tolist(), pdf["n"].tolist()]
        return pd.DataFrame([(*key, below, *sizes)], columns=[*own, "rb", "below", "xb", "n"])

    def crossings(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        of = pdf[pdf["rb"] >= 0]
        xb, at = np.unique(np.concatenate(of["xb"].tolist()), return_inverse=True)
        grid = np.zeros((len(xb), int(of["rb"].max()) + 1), np.int64)
        grid[at, np.repeat(of["rb"].to_numpy(), of["n"].map(len).to_numpy())] = np.concatenate(of["n"].tolist())
        after = np.cumsum(grid[::-1], 0)[::-1] - grid  # further blocks of x
        return pd.DataFrame([(*key, int(pdf["below"].sum()) + int((grid * (np.cumsum(after, 1) - after)).sum()))], columns=[*own, "below"])

    rows = sent.mapInPandas(residuals, f"{kind}, rb int, xb long, below long, n long, r binary, w binary")
    sums = rows.groupBy(*own, "rb").applyInPandas(across, f"{kind}, rb int, below long, xb array<long>, n array<long>")
    return sums.groupBy(*own).applyInPandas(crossings, f"{kind}, below long")


def _merged(df: DataFrame, by: list[str], x: Column, y: Column) -> tuple[DataFrame, list[str]]:
    """(key0 .., x, y, w): the distinct points with finite x and y, and how often each is there; and the names of the keys."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    keys = [f"key{k}" for k in range(len(by))]  # fields of rows in tasks
    points = df.filter(finite(x) & finite(y)).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], x.alias("x"), y.alias("y"))
    return points.groupBy(*keys, "x", "y").agg(F.count("*").alias("w")), keys


def median_slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, slope): the median over all pairs of points of a key with different x of the slope between them; null without such a pair.

    The mean of both middle slopes where their number is even. Points without finite x and y are left out; equal points count as often as
    they stand there."""
    points, own = _merged(df, keys, F.col(x).cast("double"), F.col(y).cast("double"))
    return _median_slope(materialize(points, "slope-points"), own).withColumnsRenamed(dict(zip(own, keys, strict=True)))


def _median_slope(points: DataFrame, keys: list[str]) -> DataFrame:
    same = points.groupBy(*keys, "x").agg(F.count("*").alias("n"), F.sum("w").alias("m"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    of = same.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(F.expr("m * (m - 1) div 2")).alias("ties"), F.try_divide(F.max("y1") - F.min("y0"), F.max("x") - F.min("x")).alias("unit"),
    )
    of = of.select(*keys, "n", F.expr("m * (m - 1) div 2 - ties").alias("pairs"), F.when(F.col("unit") > 0, F.col("unit")).otherwise(F.lit(1e-9)).alias("unit"))
    of = materialize(of, "slope-keys")
    kind = _kind(of, keys)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        x, y, w = (pdf[c].to_numpy() for c in ("x", "y", "w"))
        pairs, unit = int(pdf["pairs"].iloc[0]), float(pdf["unit"].iloc[0])
        ends = [slope_at(x, y, w, rank, pairs, unit, MOST) for rank in sorted({(pairs - 1) // 2, pairs // 2})]
        return pd.DataFrame([(*key, sum(ends) / len(ends))], columns=[*keys, "slope"])

    few = (F.col("n") <= SAMPLE) & (F.col("pairs") > 0)
    slopes = points.join(of.filter(few), keys).groupBy(*keys).applyInPandas(solve, f"{kind}, slope double")
    large = of.filter(F.col("n") > SAMPLE).filter("pairs > 0")
    if not large.isEmpty():
        slopes = slopes.unionByName(_large_median_slope(points, keys, large))
    return of.select(*keys).join(slopes, keys, "left")


def _large_median_slope(points: DataFrame, keys: list[str], of: DataFrame) -> DataFrame:
    """(keys, slope) of keys with more points than a sample."""
    kind = _kind(of, keys)
    inside = points.join(of.select(*keys, "n"), keys)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        return pd.DataFrame([(*key, *(_bytes(pdf[c].to_numpy()) for c in ("x", "y", "w")))], columns=[*keys, "x", "y", "w"])

    drawn = F.pmod(F.xxhash64("x", "y"), F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) / F.col("n")
    sample = materialize(inside.filter(drawn).select(*keys, "x", "y", "w").groupBy(*keys).applyInPandas(pack, f"{kind}, x binary, y binary, w binary"), "slope-sample")
    ordered = inside.select(*keys, "x", "y", "w").repartitionByRange(*keys, "x", "y").sortWithinPartitions(*keys, "x", "y")
    blocks = materialize(ordered.mapInPandas(_cut(keys), f"{kind}, xb long, x binary, y binary, w binary"), "slope-blocks")

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf.itertuples(index=False):
                x, y, w = _points(s)
                slopes, number = (np.empty(0), 0) if s.stuck else _drawn(x, y, w, s.lo, s.hi)
                low, high = ((rank + 0.5 - s.clo) / (s.chi - s.clo) for rank in (s.a, s.b))
                margin = 1.5 * (len(x) ** -0.5 + max(1, min(number, DRAWN)) ** -0.5)
                ts = _probes(slopes, low, high, margin, s.lo, s.hi, s.unit, s.step)
                yield pd.DataFrame([(*(getattr(s, c) for c in own), k, t, _edges(x, y, t, s.blocks)) for k, t in enumerate(ts)], columns=[*own, "probe", "t", "edges"])

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in pdf.itertuples(index=False):
                parts = [s._asdict()]
                for t, n in ((s.t0, s.c0), (s.t1, s.c1)):
                    new = []
                    for p in parts:
                        if not p["lo"] < t < p["hi"]:
                            new.append(p)
                        elif n <= p["a"]:
                            new.append(p | {"lo": t, "clo": n})
                        elif n > p["b"]:
                            new.append(p | {"hi": t, "chi": n})
                        else:  # between both middle slopes: each goes on alone
                            new += [p | {"hi": t, "chi": n, "b": p["a"], "part": 1}, p | {"lo": t, "clo": n, "a": p["b"], "part": 2}]
                    parts = new
                for p in parts:
                    left, found = p["chi"] - p["clo"], np.isfinite(p["lo"]) and np.isfinite(p["hi"])
                    tight = _tight(p["lo"], p["hi"], s.unit)
                    rows.append(p | {"step": s.step + 1, "stuck": not s.stuck and 2 * left > s.chi - s.clo, "tight": tight, "done": bool(found and (tight or left <= MOST))})
            yield pd.DataFrame(rows, columns=columns)

    own = [*keys, "part"]
    state = of.select(
        *keys, F.lit(0).alias("part"), F.least(F.lit(RESIDUAL_BLOCKS), F.floor(F.col("n") / SIZE) + 1).cast("int").alias("blocks"), "unit", F.expr("(pairs - 1) div 2").alias("a"), F.expr("pairs div 2").alias("b"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
        F.lit(0).cast("long").alias("clo"), F.col("pairs").alias("chi"), F.lit(0).alias("step"), F.lit(False).alias("stuck"), F.lit(False).alias("tight"), F.lit(False).alias("done"),
    )
    columns = state.columns
    for _ in range(ROUNDS):
        live = state.filter("NOT done")
        if live.isEmpty():
            break
        probes = materialize(live.join(sample, keys).mapInPandas(propose, f"{kind}, part int, probe int, t double, edges array<double>"), "slope-probes")
        each = slopes_below(blocks, keys, probes).join(probes.select(*own, "probe", "t"), [*own, "probe"])
        pick = lambda c, k: F.max(F.when(F.col("probe") == k, F.col(c)))
        counts = each.groupBy(*own).agg(*[pick(c, k).alias(f"{name}{k}") for k in (0, 1) for name, c in (("t", "t"), ("c", "below"))])
        state = materialize(state.filter("done").unionByName(live.join(counts, own).mapInPandas(narrow, _kind(state, columns))), "slope-state")
    else:
        raise RuntimeError("the bracket of a median slope doesn't narrow")
    ends = _in_bracket(blocks, keys, state.filter("NOT tight"), sample)
    middle = F.when(F.expr("lo <= 0 AND hi >= 0"), F.lit(0.0)).otherwise((F.col("lo") + F.col("hi")) / 2)  # equal but for rounding
    return state.join(ends, own, "left").groupBy(*keys).agg(F.avg(F.coalesce("s", middle)).alias("slope"))


def _in_bracket(blocks: DataFrame, keys: list[str], state: DataFrame, sample: DataFrame) -> DataFrame:
    """(keys, part, s): the middle of the slopes of the ranks a and b, from the slopes in each bracket.

    A pair in the bracket changes its order from the residuals at ``lo`` to those at ``hi``. It meets in a block of the first, in a block of the
    second, or else all pairs of the two crossings of blocks are in the bracket, so that no more pairs are made than there are."""
    own = [*keys, "part"]
    kind = _kind(state, own)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf.itertuples(index=False):
                x, y, _ = _points(s)
                yield pd.DataFrame([(*(getattr(s, c) for c in own), s.lo, s.hi, _edges(x, y, s.lo, s.blocks), _edges(x, y, s.hi, s.blocks))], columns=[*own, "lo", "hi", "elo", "ehi"])

    brackets = materialize(state.join(sample, keys).mapInPandas(part, f"{kind}, lo double, hi double, elo array<double>, ehi array<double>"), "slope-brackets")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf.itertuples(index=False):
                x, y, w = _points(s)
                bl, bh = (_block(y - t * x, np.asarray(e, float)) for t, e in ((s.lo, s.elo), (s.hi, s.ehi)))
                order = np.lexsort((bh, bl))
                ends = [0, *(np.flatnonzero(np.diff(bl[order]) | np.diff(bh[order])) + 1), len(x)]
                cells = [order[a:b] for a, b in zip(ends, ends[1:])]
                key = [getattr(s, c) for c in own]
                yield pd.DataFrame([(*key, s.lo, s.hi, int(bl[c[0]]), int(bh[c[0]]), *(_bytes(v[c]) for v in (x, y, w))) for c in cells], columns=[*own, "lo", "hi", "bl", "bh", "x", "y", "w"])

    cells = materialize(blocks.join(brackets, keys).mapInPandas(spread, f"{kind}, lo double, hi double, bl int, bh int, x binary, y binary, w binary"), "slope-cells")
    made = f"{kind}, s double, w long"

    def meet(by: str):
        def inside(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            xs, ys, ws = zip(*(_points(row) for row in pdf.itertuples(index=False)), strict=True)
            other = np.repeat(pdf["bl"].to_numpy(), [len(v) for v in xs])
            x, y, w = (np.concatenate(v) for v in (xs, ys, ws))
            order = np.lexsort((y, x))
            x, y, w, other = x[order], y[order], w[order], other[order]
            right, left = _pairs(_between(x, y, float(pdf["lo"].iloc[0]), float(pdf["hi"].iloc[0])))
            if by == "bh":  # the others met before
                keep = other[right] != other[left]
                right, left = right[keep], left[keep]
            s, n = _made(x, y, w, right, left)
            return pd.DataFrame(dict(zip(own, key)) | {"s": s, "w": n}, columns=[*own, "s", "w"])

        return inside

    def crossing(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bl, bh = pdf["bl"].to_numpy(), pdf["bh"].to_numpy()
        found = [(i, j) for i in range(len(pdf)) for j in np.flatnonzero((bl > bl[i]) & (bh < bh[i]))]
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pd.DataFrame(dict(zip(own, key)) | {"bl": bl[i], "bh": bh[i], "bl2": bl[j], "bh2": bh[j]}, columns=[*own, "bl", "bh", "bl2", "bh2"])

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                (x, y, w), x2 = _points(row), _doubles(row.x2)
                right, left = (v.ravel() for v in np.meshgrid(np.arange(len(x2)) + len(x), np.arange(len(x))))
                s, n = _made(np.concatenate([x, x2]), np.concatenate([y, _doubles(row.y2)]), np.concatenate([w, _counts(row.w2, len(x2))]), right, left)
                yield pd.DataFrame(dict(zip(own, (getattr(row, c) for c in own))) | {"s": s, "w": n}, columns=[*own, "s", "w"])

    pairs = cells.select(*own, "bl", "bh").distinct().groupBy(*own).applyInPandas(crossing, f"{kind}, bl int, bh int, bl2 int, bh2 int")
    packed = cells.drop("lo", "hi")
    second = packed.withColumnsRenamed({c: f"{c}2" for c in ("bl", "bh", "x", "y", "w")})
    met = pairs.join(packed, [*own, "bl", "bh"]).join(second, [*own, "bl2", "bh2"])
    slopes = [cells.groupBy(*own, by).applyInPandas(meet(by), made) for by in ("bl", "bh")] + [met.mapInPandas(product, made)]

    def middle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ends = [_at(pdf["s"].to_numpy(), pdf["w"].to_numpy(), int(pdf[c].iloc[0] - pdf["clo"].iloc[0])) for c in ("a", "b")]
        return pd.DataFrame([(*key, sum(ends) / 2)], columns=[*own, "s"])

    found = reduce(DataFrame.unionByName, slopes).join(state.select(*own, "a", "b", "clo"), own)
    return found.groupBy(*own).applyInPandas(middle, f"{kind}, s double")


def crosstalk_k(sites: DataFrame, keys: list[str], source: str, target: str, least: int = 20, most: float = 0.25) -> DataFrame:
    """(keys, k, n_sites, rho, mode, fitted_slope): how much of the source channel bleeds into the target, from amplitudes at bright sites.

    Sites with finite amplitudes and a positive source count. k is the median slope, 0 where it is negative; with fewer than ``least`` sites it is 0
    (insufficient-sites, without a slope and rho), and where the slope is above ``most`` (implausible-slope). rho is Spearman's; null where one
    side is constant. A key without any usable site has a row too."""
    s, t = F.col(source).cast("double"), F.col(target).cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = finite(s) & finite(t) & (s > 0)
    count = sites.groupBy(*keys).agg(F.count_if(usable).alias("n_sites"))
    points, own = _merged(sites.filter(usable), keys, s, t)
    enough = count.filter(F.col("n_sites") >= least).select(*[F.col(c).alias(k) for c, k in zip(keys, own, strict=True)], "n_sites")
    fitted = materialize(points.join(enough, own), "crosstalk-sites")
    ranked = average_ranks(average_ranks(fitted, own, "x", "rx", F.col("w")), own, "y", "ry", F.col("w"))
    dx, dy, w = F.col("rx") - (F.col("n_sites") + 1) / 2, F.col("ry") - (F.col("n_sites") + 1) / 2, F.col("w")  # the mean rank
    spread = F.when((F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry")), F.sum(w * dx * dy) / F.sqrt(F.sum(w * dx * dx)) / F.sqrt(F.sum(w * dy * dy)))
    fit = _median_slope(fitted.drop("n_sites"), own).join(ranked.groupBy(*own).agg(spread.alias("rho")), own, "left")
    out = count.join(fit.withColumnsRenamed(dict(zip(own, keys, strict=True))), keys, "left")
    mode = F.when(F.col("n_sites") < least, "insufficient-sites").when(F.col("slope") > most, "implausible-slope").otherwise("auto")
    k = F.when(mode == "auto", F.greatest(F.coalesce("slope", F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    return out.select(*keys, k.alias("k"), "n_sites", "rho", mode.alias("mode"), F.col("slope").alias("fitted_slope"))
