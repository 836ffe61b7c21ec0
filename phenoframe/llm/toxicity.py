"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..worktable import materialize
from . import textops as T
from .sampling import held_out, stratified

BITS = 20
#: Bytes of terms: letters, digits and everything above ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEM = 4


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each term of a block and of each term's first ``_STEM`` bytes, not yet distinct."""
    data = T.lower_ascii(data)
    start, end = T.spans(_TERM[data], offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    whole = T.span_hashes(data, start, end)
    stem = T.mix(T.span_hashes(data, start, np.minimum(end, start + _STEM)) + np.uint64(1))
    h = np.concatenate([whole, stem]) >> np.uint64(64 - BITS)
    return np.concatenate([row, row]), h.astype(np.int64)


def distinct_terms(row: np.ndarray, bucket: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets row by row, and where each row's begin."""
    both = np.unique((row.astype(np.int64) << BITS) | bucket)
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(rows + 1))


class FactorizationMachine:
    """y = w0 + sum w_i + sum over pairs <v_i, v_j> over the distinct terms of a text, fitted by AdaGrad."""

    def __init__(self, bias: float, index: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.index, self.w, self.v = bias, index.astype(np.int64), w, v  # index: the terms seen, sorted
        self.place = None

    @classmethod
    def fit(
        cls, docs: list[np.ndarray], labels: np.ndarray, prior_shift: float, k: int = 4, least: int = 4, apart: float = 4.0, epochs: int = 8, decay: float = 2e-4,
        seed: int = 3,
    ):
        """``docs``: distinct buckets of each text. Only terms of fewer than ``least`` texts are left out.

        The first ``epochs`` rounds fit the terms that go with a class (whose share of toxic texts is ``apart`` standard errors from all
        texts' or more) and frequent ones; as many more rounds fit every term to what these leave, the others in small steps. Each round
        deals the texts anew: with steps of the same texts every time, some samples leave a tenth of the toxic texts unrecognised."""
        if not docs or not (0 < labels.sum() < len(labels)):
            rate = float(labels.mean()) if len(labels) else 0.0
            return cls(4.0 if rate > 0.5 else -4.0, np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, k), np.float32))
        values, counts = np.unique(np.concatenate(docs), return_counts=True)
        bad = np.bincount(np.searchsorted(values, np.concatenate([d for d, y in zip(docs, labels, strict=True) if y > 0])), minlength=len(values))
        rate = labels.mean()
        z = np.abs(bad - counts * rate) / np.sqrt(counts * rate * (1 - rate))
        often = counts >= least
        index, told = values[often], (z >= apart)[often]
        clear = told | (counts[often] >= 0.2 * len(docs))
        every = [np.searchsorted(index, d[np.isin(d, index, assume_unique=True)]).astype(np.int32) for d in docs]
        rng = np.random.default_rng(seed)
        n = len(index)
        w, v = np.zeros(n, np.float64), rng.normal(0, 0.01, (n, k))
        # Large first sums keep the steps of terms in proportion to their evidence. Of single terms only those that tell a class go without: first steps of
        # all frequent ones together would drown them, and what pairs then made up for held for the sample alone.
        gw, gv, bias, gb = np.where(told, 1e-6, 1e-2), np.where(clear[:, None], np.full(k, 1e-6), 0.3), 0.0, 1e-6
        rate_w, rate_v = np.where(told, 0.3, 0.03), np.where(clear, 0.02, 0.1)[:, None]
        number = np.zeros(n, np.int64)  # of a step's terms
        for own in ([x[clear[x]] for x in every], every):
            length = np.array([len(x) for x in own])
            for _ in range(epochs):
                order = rng.permutation(len(own))
                for at in range(0, len(order), 32):
                    part = order[at : at + 32]
                    x, row = np.concatenate([own[i] for i in part]), np.repeat(np.arange(len(part)), length[part])
                    u = np.flatnonzero(np.bincount(x, minlength=n))  # counting is cheaper here than sorting
                    number[u] = np.arange(len(u))
                    place, wu, vu = number[x], w[u], v[u]
                    vx = vu[place]
                    sums = np.stack([np.bincount(row, vx[:, f], len(part)) for f in range(k)], 1)
                    linear = np.bincount(row, wu[place], len(part))
                    square = np.bincount(row, (vu**2).sum(1)[place], len(part))
                    y = bias + linear + 0.5 * ((sums**2).sum(1) - square)
                    err = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]
                    g = err[row] / len(part)
                    dw = np.bincount(place, g, len(u)) + decay * wu
                    gx = g[:, None] * (sums[row] - vx)
                    dv = np.stack([np.bincount(place, gx[:, f], len(u)) for f in range(k)], 1) + decay * vu
                    gw[u] += dw**2
                    gv[u] += dv**2
                    gb += err.mean() ** 2
                    w[u] = wu - rate_w[u] * dw / np.sqrt(gw[u])
                    v[u] = vu - rate_v[u] * dv / np.sqrt(gv[u])
                    bias -= 0.1 * err.mean() / np.sqrt(gb)
        return cls(bias + prior_shift, index, w.astype(np.float32), v.astype(np.float32))

    def score(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        if self.place is None:
            self.place = np.full(1 << BITS, -1, np.int32)
            self.place[self.index] = np.arange(len(self.index))
        at = self.place[bucket]
        known = at >= 0
        x, first = distinct_terms(row[known], bucket[known], rows)
        at, owner = self.place[x], np.repeat(np.arange(rows), np.diff(first))
        linear = np.bincount(owner, self.w[at], rows)
        pairs = np.zeros(rows)
        for f in range(self.v.shape[1]):
            vf = self.v[at, f].astype(np.float64)
            pairs += np.bincount(owner, vf, rows) ** 2 - np.bincount(owner, vf**2, rows)
        y = self.bias + linear + 0.5 * pairs
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = T.column(b, "text")
        out = []
        for i, j, data, offsets in T.blocks(text):
            x, first = distinct_terms(*terms(data, offsets), j - i)
            out += [x[a:z].astype(np.uint32).tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["id", "label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, most_terms: int, seed: int = 3) -> FactorizationMachine:
    """Fit on about ``per_class`` toxic labelled texts and twice as many others outside the held-out fold (a documented, bounded sample).

    Its terms stay in a table first. Texts come to the driver in a seeded order until they have ``most_terms`` distinct terms together (four bytes each), so a sample of
    very long texts is of fewer texts; the numbers of terms that decide this are small rows."""
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = stratified(known, "label", "id", {1: per_class, 0: 2 * per_class})
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = texts.join(F.broadcast(sample), "id").select("id", "label", "text")  # 4 * per_class small rows at most
    rows = materialize(own.mapInArrow(_featurise, "id long, label int, terms binary"), "toxicity-terms")
    draw = F.xxhash64(F.lit(seed), "id", "label", "terms")
    rows = sorted(taken_rows(rows, draw, 4 * most_terms), key=lambda r: (r["id"] is None, r["id"], r["label"], r["terms"]))
    y = np.array([r["label"] for r in rows], float)
    took = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    shift = 0.0
    if counts.get(0) and counts.get(1):  # from the classes' shares in the sample to those in the labels
        shift = float(np.log(counts[1] / took[1]) - np.log(counts[0] / took[0]))
    return FactorizationMachine.fit([np.frombuffer(r["terms"], np.uint32) for r in rows], y, shift, seed=seed)


def taken_rows(rows: DataFrame, draw: Column, most_bytes: int) -> list[Row]:
    """Rows of a bounded sample by ``draw`` until their terms take ``most_bytes``."""
    sizes = sorted((r["draw"], r["bytes"]) for r in rows.select(draw.alias("draw"), F.octet_length("terms").alias("bytes")).collect())  # two numbers a row
    last, total = None, 0
    for key, size in sizes:
        total += size
        if total > most_bytes:
            break
        last = key
    return rows.filter(draw <= last).collect() if last is not None else []


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.3, per_class: int = 2500, most_terms: int = 24_000_000,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The machine is fitted on about ``per_class`` toxic labelled texts and twice as many others (with ``most_terms`` terms in all), never on held-out ids, and
    scores every whole text, however long, without a shuffle. Null and empty texts get the score of the bias. Labels other than 0 and 1
    are ignored; with no label of one class all scores are near the other. Repeated rows score alike; no documents give no rows; further
    columns are ignored, whatever their names."""
    model = fit(docs, labels, id_col, text_col, label_col, per_class, most_terms)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            parts = [m.score(*terms(data, offsets), j - i) for i, j, data, offsets in T.blocks(T.column(b, "text"))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["doc_id", "held_out", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = own.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
