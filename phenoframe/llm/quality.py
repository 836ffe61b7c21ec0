"""Quality: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..worktable import materialize
from . import textops as T
from .sampling import stratified

BITS = 18
#: Words of the longest n-gram of words, and of shapes.
WORDS, SHAPES = 2, 3
#: Tasks that fit side by side; their models are averaged after each round.
SHARDS = 4
#: Classes of bytes in a word's shape: small letters and everything above ASCII, capitals, digits; other bytes stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_REPEATED = np.uint64(1)


def fold(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words' shapes: classes of their bytes with runs of one class taken once."""
    kinds = _CLASS[data]
    turn = np.ones(len(kinds), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    turn[start] = True
    place = np.concatenate([[0], np.cumsum(turn)])
    return T.span_hashes(kinds[turn], place[start], place[end], lane=1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the texts of a block, by row: n-grams of words and of their shapes, where a word equal to the one before
    it has a shape of its own. The values of each kind and length of n-gram are roots of their shares, so a text's sum of squares is
    the same however long it is."""
    start, end, first = T.words(data, offsets)
    whole, form = T.span_hashes(data, start, end), shapes(data, start, end)
    owner = np.searchsorted(first, np.arange(len(start)), "right") - 1
    again = np.zeros(len(start), bool)
    again[1:] = (whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])
    form = np.where(again, _REPEATED, form)
    found = []
    for kind, (hashes, longest) in enumerate(((whole, WORDS), (form, SHAPES))):
        for n in range(1, longest + 1):
            h = T.ngrams(hashes, n, kind)
            row = owner[: len(h)]
            inside = row == owner[n - 1 :] if len(h) else np.zeros(0, bool)
            row = row[inside]
            bucket = (T.mix(h[inside] + np.uint64(8 * kind + n)) >> np.uint64(64 - BITS)).astype(np.int64)
            both, count = np.unique((row << BITS) | bucket, return_counts=True)
            row = both >> BITS
            found.append((row, both & ((1 << BITS) - 1), np.sqrt(count / np.bincount(row, count, len(offsets))[row])))
    row, bucket, value = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order], value[order]


class Leader:
    """Weights of follow-the-regularised-leader: z and n of each coordinate; the last one is the bias and isn't shrunk."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.2, l2: float = 1e-3):
        size = (1 << BITS) + 1
        self.z, self.n = (np.zeros(size) if z is None else z.copy()), (np.zeros(size) if n is None else n.copy())
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, bucket: np.ndarray, value: np.ndarray, label: int) -> None:
        """One text: its buckets may repeat."""
        at, place = np.unique(np.append(bucket, 1 << BITS), return_inverse=True)
        x = np.bincount(place, np.append(value, 1.0), len(at))
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        old = self.n[at]
        self.n[at] = old + g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - np.sqrt(old)) / self.alpha * w


def score(w: np.ndarray, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Probabilities of a block's texts: sparse dot products with the weights, bias last."""
    y = w[-1] + np.bincount(row, w[bucket] * value, rows)
    return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offsets in T.blocks(T.column(b, "text")):
            row, bucket, value = features(data, offsets)
            cut = np.searchsorted(row, np.arange(j - i + 1))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            packed = [pa.array([x[a:z].tobytes() for a, z in spans], pa.binary()) for x in (bucket.astype("<u4"), value.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([b.column(k).slice(i, j - i) for k in range(3)] + packed, ["shard", "place", "label", "buckets", "values"])


def _round(z: np.ndarray, n: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, Leader] = {}
        for b in batches:
            for shard, label, x, v in zip(*(b.column(c).to_pylist() for c in ("shard", "label", "buckets", "values")), strict=True):
                models.setdefault(shard, Leader(z, n)).learn(np.frombuffer(x, "<u4").astype(np.int64), np.frombuffer(v, "<f4"), label)
        for shard, m in sorted(models.items()):
            at = np.flatnonzero(m.n)
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (at, m.z[at], m.n[at])]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())] + packed, ["shard", "at", "z", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, rounds: int, seed: int = 13) -> np.ndarray:
    """Weights, bias last, from about ``per_class`` texts of label 0 and twice as many of label 1 outside the held-out fold.

    The sample's features stay in a table. A round streams each shard through the updates, in an order drawn by ``seed``, and brings
    back the shards' z and n, of 2^18 coordinates at most; their means begin the next round."""
    known = labels.filter(F.col(label_col).isin(0, 1) & ~fold(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    bad, good = counts.get(0, 0), counts.get(1, 0)
    if not bad or not good:
        return np.append(np.zeros(1 << BITS), np.log((good + 1) / (bad + 1)))
    sample = stratified(known, "label", "id", {0: per_class, 1: 2 * per_class})
    draw = F.xxhash64(F.lit(seed), "id", "text")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # about 3 * per_class small rows
    rows = texts.select(F.pmod(draw, F.lit(SHARDS)).cast("int").alias("shard"), draw.alias("place"), "label", "text")
    rows = materialize(rows.mapInArrow(_featurise, "shard int, place long, label int, buckets binary, values binary"), "quality-features")
    took = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    dealt = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", "place", "label")
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(rounds):
        ends = dealt.mapInArrow(_round(z, n), "shard int, at binary, z binary, n binary").collect()
        z, n = np.zeros_like(z), np.zeros_like(n)
        for r in sorted(ends, key=lambda r: r["shard"]):
            at = np.frombuffer(r["at"], np.int64)
            z[at] += np.frombuffer(r["z"]) / len(ends)
            n[at] += np.frombuffer(r["n"]) / len(ends)
    w = Leader(z, n).weights(np.arange(len(z)))
    # From the classes' shares in the sample to those in the labels.
    w[-1] += np.log(good / max(1, took.get(1, 0))) - np.log(bad / max(1, took.get(0, 0)))
    return w


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3,
    per_class: int = 4000, rounds: int = 4,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The model is fitted on a bounded sample (``fit``), never on ids of the held-out fold, and scores every whole text, however long,
    without a shuffle. Null and empty texts get the score of the bias. Labels other than 0 and 1 are ignored; where one class has no
    label, all scores are the labels' share with one label of each class added. Repeated rows score alike, no documents give no rows and
    further columns are ignored, whatever their names."""
    weights = fit(docs, labels, id_col, text_col, label_col, per_class, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            parts = [score(w, *features(data, offsets), j - i) for i, j, data, offsets in T.blocks(T.column(b, "text"))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "held_out", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = own.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
