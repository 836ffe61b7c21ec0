"""Language ID: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .sampling import held_out, stratified

#: Texts that the network is fitted on at most, about.
MAX_SAMPLE = 100_000
WINDOW = 48
LETTER = r"\p{L}"


def _soft(a: np.ndarray) -> np.ndarray:
    """a / (1 + |a|) in place: the squashing function; gates are (1 + that) / 2. Far cheaper than tanh."""
    d = np.abs(a)
    d += 1
    a /= d
    return a


def _gate(a: np.ndarray) -> np.ndarray:
    a = _soft(a)
    a *= 0.5
    a += 0.5
    return a


class Direction:
    """One gated recurrent layer: update gate z, reset gate r and candidate c, with byte inputs read from tables."""

    def __init__(self, hidden: int, rng):
        self.h = hidden
        self.p = {"x" + k: rng.normal(0, 0.5, (256, hidden)).astype(np.float32) for k in "zrc"}
        self.p |= {"u" + k: (rng.normal(0, 1.0, (hidden, hidden)) / np.sqrt(hidden)).astype(np.float32) for k in "zrc"}

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, row, hidden) of bytes x (time, row)."""
        p, own = self.p, np.zeros((x.shape[1], self.h), np.float32)
        out = np.empty((len(x), x.shape[1], self.h), np.float32)
        for t in range(len(x)):
            z, r, c = (p["x" + k].take(x[t], axis=0) for k in "zrc")
            z += own @ p["uz"]
            z = _gate(z)
            r += own @ p["ur"]
            r = _gate(r)
            held = r * own
            c += held @ p["uc"]
            c = _soft(c)
            if keep is not None:
                keep.append((own, z, r, c, held))
            step = c - own
            step *= z
            own = np.add(own, step, out=out[t])
        return out

    def back(self, x: np.ndarray, keep: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time: gradients from those of the states."""
        p = self.p
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        d = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            own, z, r, c, held = keep[t]
            d = d + d_out[t]
            dc = d * z * (1 - np.abs(c)) ** 2
            dz = d * (c - own) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dh = dc @ p["uc"].T
            dr = dh * own * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            for k, g, of in (("z", dz, own), ("r", dr, own), ("c", dc, held)):
                grad["u" + k] += of.T @ g
                np.add.at(grad["x" + k], x[t], g)
            d = d * (1 - z) + dh * r + dz @ p["uz"].T + dr @ p["ur"].T
        return grad


class ByteTagger:
    """Labels every byte of a window from a forward and a backward layer; the label probabilities of a text's bytes are pooled by their mean."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.forward, self.backward = Direction(hidden, rng), Direction(hidden, rng)
        self.head = rng.normal(0, 0.3, (2 * hidden, max(1, len(labels)))).astype(np.float32)
        self.bias = np.zeros(max(1, len(labels)), np.float32)

    def fit(self, windows: np.ndarray, targets: np.ndarray, steps: int, batch: int = 128, rate: float = 0.02, seed: int = 2) -> None:
        """Adam over random batches. windows: (rows, WINDOW) bytes, 0 where the text has ended."""
        rng = np.random.default_rng(seed)
        names = list(self.forward.p)
        flat = [d.p[k] for d in (self.forward, self.backward) for k in names] + [self.head, self.bias]
        m, s = [np.zeros_like(a) for a in flat], [np.zeros_like(a) for a in flat]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            x, y = windows[pick].T, targets[pick]
            live = (x > 0).astype(np.float32)
            kf, kb = [], []
            f, b = self.forward.run(x, kf), self.backward.run(x[::-1], kb)[::-1]
            both = np.concatenate([f, b], 2)
            logits = both @ self.head + self.bias
            q = np.exp(logits - logits.max(2, keepdims=True))
            q /= q.sum(2, keepdims=True)
            q[:, np.arange(batch), y] -= 1
            q *= live[:, :, None] / max(1.0, live.sum())
            d = q @ self.head.T
            n = self.hidden
            gf = self.forward.back(x, kf, d[:, :, :n])
            gb = self.backward.back(x[::-1], kb, d[::-1, :, n:])
            grads = [g[k] for g in (gf, gb) for k in names] + [np.einsum("tnh,tnl->hl", both, q), q.sum((0, 1))]
            lr = rate * (1 - step / (steps + 1))
            for a, g, mm, ss in zip(flat, grads, m, s, strict=True):
                mm += 0.1 * (g - mm)
                ss += 0.01 * (g * g - ss)
                a -= lr * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.99**step)) + 1e-7)

    def tag(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (time, row, label) of bytes (time, row)."""
        n, labels = self.hidden, len(self.labels)
        logits = self.forward.run(x).reshape(-1, n) @ self.head[:n]
        logits += self.backward.run(x[::-1])[::-1].reshape(-1, n) @ self.head[n:]
        logits += self.bias
        np.clip(logits, -40, 40, out=logits)
        np.exp(logits, out=logits)
        logits /= logits @ np.ones((labels, 1), np.float32)
        return logits.reshape(*x.shape, labels)

    def pool(self, data: np.ndarray, offsets: np.ndarray, rows: int = 2048) -> np.ndarray:
        """Mean label probabilities of each document over all of its bytes."""
        windows, owner, length = cut(data, offsets)
        sums = np.zeros((len(offsets) - 1, len(self.labels)))
        for at in range(0, len(owner), rows):
            x = np.ascontiguousarray(windows[at : at + rows].T)
            live = np.arange(WINDOW)[:, None] < length[at : at + rows]
            p = np.einsum("tnl,tn->nl", self.tag(x), live.astype(np.float32))
            for k in range(len(self.labels)):
                sums[:, k] += np.bincount(owner[at : at + rows], p[:, k], len(sums))
        return sums / np.maximum(1, np.diff(offsets))[:, None]


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of WINDOW bytes over whole documents, in order: bytes (0 after the end), document, length."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    start = offsets[:-1][owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    length = np.minimum(WINDOW, offsets[1:][owner] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)], np.uint8(0)), owner, length


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, steps: int) -> ByteTagger | None:
    """Fit on about ``per_label`` texts a label, MAX_SAMPLE at most in all (a documented, bounded sample), one piece of 512 characters of each from a seeded place."""
    known = docs.filter(F.col(label_col).isNotNull() & ~held_out(id_col) & F.coalesce(F.col(text_col), F.lit("")).rlike(LETTER))
    size = F.length(text_col)
    place = F.pmod(F.xxhash64(F.lit(9), F.col(id_col).cast("string")), F.greatest(F.lit(1), size - 512)) + 1
    piece = F.substring(F.col(text_col), place.cast("int"), F.lit(512))
    own = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), piece.alias("text"))
    rows = stratified(own, "label", "id", per_label, max_rows=MAX_SAMPLE).collect()  # MAX_SAMPLE rows, about, at most
    rows.sort(key=lambda r: (r["label"], r["id"] is None, r["id"], r["text"]))
    labels = sorted({r["label"] for r in rows})
    if not labels:
        return None
    windows, targets = [], []
    for k, label in enumerate(labels):
        texts = [r["text"].encode() for r in rows if r["label"] == label]
        size = np.cumsum([0, *map(len, texts)])
        w, _, length = cut(np.frombuffer(b"".join(texts), np.uint8), size)
        w = w[length >= min(16, length.max())]
        w = w[np.random.default_rng(4).permutation(len(w))[: 8 * per_label]]
        windows.append(w)
        targets += [k] * len(w)
    share = max(map(len, windows))  # every label as often
    pick = np.concatenate([np.resize(np.arange(len(w)), share) + at for w, at in zip(windows, np.cumsum([0, *map(len, windows)])[:-1], strict=True)])
    tagger = ByteTagger(labels)
    if len(labels) > 1:
        tagger.fit(np.concatenate(windows)[pick], np.array(targets)[pick], steps)
    return tagger


def language_id(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 600, steps: int = 350,
    key_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from about ``per_label`` texts of each label outside the held-out fold, however many labels there are (beyond MAX_SAMPLE texts in all they share
    that number, rarer ones giving fewer), then tags every byte of
    every whole text in windows of WINDOW bytes and averages. ``und`` with score 0 for null texts, texts without a letter, and when
    there is nothing to learn from. Ties go to the smaller label. Repeated rows get the same answer; extra columns are ignored but
    for ``key_col``, of any type, which goes along with its row. Long texts are read whole. No shuffle."""
    more = [key_col] if key_col else []
    tagger = fit(docs, id_col, text_col, label_col, per_label, steps)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            n = b.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            letters = np.array(b.column(2).to_pylist(), bool)
            for i, j, data, offsets in T.blocks(T.column(b, "text")) if m else ():
                p = m.pool(data, offsets)
                best = p.argmax(1)
                pred[i:j] = np.array(m.labels, object)[best]
                score[i:j] = np.clip(p[np.arange(j - i), best], 0, 1)
            pred[~letters], score[~letters] = "und", 0.0
            out = [b.column(0), b.column(1), pa.array(pred.tolist(), pa.string()), pa.array(score), *b.columns[4:]]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "lang_pred", "score", *more])

    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
        F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False)).alias("letters"), F.col(text_col).alias("text"), *more,
    )
    return own.mapInArrow(T.releasing(run), "doc_id long, held_out boolean, lang_pred string, score double" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more))
