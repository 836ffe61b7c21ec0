"""Substring dedup by prefix-partitioned suffix trees that are cut off at the length of a repeat.

Every start of a window of WINDOW words is a suffix, of which the first WINDOW words matter. Suffixes are split into groups by
a prefix whose length varies: it is longer where a prefix is so frequent that its group would not fit into a bucket (packing.BUCKET_BYTES). The label of a
suffix is a row of symbols, each standing for STEP words, and a 128-bit digest of the whole window. A group sorts its suffixes by their labels, takes the lengths of the
common prefixes of neighbours, and reads the internal nodes off them as runs; those as deep as a window hold its copies, and all
but the earliest of their leaves start a repeat. Neighbouring repeats of a document merge to maximal ones.

Two things keep the exchange small. Only suffixes that may repeat are sent: the least hashed ANCHOR-gram of a window (the same in every copy of
it) must occur twice. And each task sends only the first of its equal suffixes; the others already are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..worktable import materialize
from . import packing as P
from . import textops as T

ANCHOR = 10
#: Words a symbol stands for; prefix lengths are its multiples, a window's whole length being the last resort.
STEP = 4
#: Documents whose prefixes are counted to choose the lengths; this steers balance only, never the result.
SAMPLE_DOCS = 2000
#: Bytes of a suffix on its way, about.
SUFFIX_BYTES = 30


def steps_of(length: int) -> list[int]:
    """The depths at which the symbols of a label end."""
    return [*range(STEP, length, STEP), length]


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = pick(a[: len(a) - step], a[step:])
        have += step
    return a


def windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(word hashes, first word of each document, anchor-gram hashes, least anchor of each window, whether the window is inside a document, spans of the words)."""
    start, end, first = T.words(data, offsets)
    h = T.span_hashes(data, start, end)
    anchor = min(ANCHOR, length)
    g = T.ngrams(h, anchor)
    count = max(0, len(h) - length + 1)
    low = _slide(g, length - anchor + 1, np.minimum) if count else np.zeros(0, np.uint64)
    last = np.repeat(first[1:], np.diff(first))
    ok = np.arange(count) + length <= last[:count]
    return h, first, g, low, ok, (start, end)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 46-bit id) of the anchors of each document, twice where one occurs more than once."""
    _, first, g, low, ok, _ = windows(data, offsets, length)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    reach = len(g) - len(low)  # a gram is an anchor if it is the least of some window around it
    shown = np.where(ok, low, np.uint64(0))
    padded = np.concatenate([np.zeros(reach, np.uint64), shown, np.zeros(reach, np.uint64)])
    at = np.flatnonzero((_slide(padded, reach + 1, np.maximum) == g) & (g > 0))
    row = np.searchsorted(first, at, "right") - 1
    both, count = np.unique((row.astype(np.uint64) << np.uint64(P.ID_BITS)) | (g[at] >> np.uint64(64 - P.ID_BITS)), return_counts=True)
    both = np.repeat(both, np.minimum(count, 2))
    return (both >> np.uint64(P.ID_BITS)).astype(np.int64), both & np.uint64((1 << P.ID_BITS) - 1)


def prefix_keys(h: np.ndarray, at: np.ndarray, length: int, heavy: dict[int, np.ndarray]) -> np.ndarray:
    """The hash of each suffix's prefix, of the least length at which it isn't heavy."""
    key, left = np.zeros(len(at), np.uint64), np.arange(len(at))
    for p in steps_of(length):
        own = T.ngrams(h, p)[at[left]]
        key[left] = own
        if p == length or not len(heavy.get(p, ())):
            break
        left = left[np.isin(own, heavy[p])]
        if not len(left):
            break
    return key


def labels(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """16-bit symbols of the suffixes, one column for each STEP words."""
    out, done = [], 0
    for p in steps_of(length):
        out.append((T.ngrams(h, p - done)[at + done] >> np.uint64(48)).astype(np.uint16))
        done = p
    return np.stack(out, 1)


def tree(symbols: np.ndarray, f1: np.ndarray, f2: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A suffix tree as (its leaves in order, words in common with the leaf before); of equal suffixes the earliest comes first.

    Leaves are sorted by symbols, then by digest; only equal digests have the whole window in common."""
    order = np.lexsort((at, doc, f2, f1, *symbols.T[::-1]))
    if not len(order):
        return order, np.zeros(0, np.int64)
    a, b = order[1:], order[:-1]
    depth = np.concatenate([[0], steps_of(length)])
    equal = np.logical_and.accumulate(symbols[a] == symbols[b], axis=1).sum(1)
    whole = (f1[a] == f1[b]) & (f2[a] == f2[b])
    return order, np.insert(np.where(whole, length, depth[np.minimum(equal, len(depth) - 2)]), 0, 0)


def nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The internal nodes of at least this depth: their first leaves and the leaves after their last."""
    inside = np.append(common >= depth, False)
    after = np.append(inside[1:], False)
    return np.flatnonzero(after & ~inside), np.flatnonzero(inside & ~after) + 1


def heavy_prefixes(docs: DataFrame, length: int, partitions: int) -> tuple[float, int, dict[int, np.ndarray]]:
    """(bytes of all suffixes, bits of the number of groups, prefixes that hold over 1 / (4 * groups) of the suffixes of a sample of documents, 4 * groups a length at most)."""
    sample, total = P.sampled(docs, SAMPLE_DOCS)
    steps = steps_of(length)[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in T.blocks(T.column(b, "text")):
                h, _, _, _, ok, _ = windows(data, offsets, length)
                for p in steps:
                    value, n = np.unique(T.ngrams(h, p)[: len(ok)][ok], return_counts=True)
                    often = n > 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(often.sum(), p, np.int32)), pa.array(value[often].view(np.int64)), pa.array(n[often])], ["p", "value", "n"]
                    )
                yield pa.RecordBatch.from_arrays([pa.array([0, -1], pa.int32()), pa.array([0, 0], pa.int64()), pa.array([int(ok.sum()), j - i])], ["p", "value", "n"])

    counts = materialize(sample.mapInArrow(count, "p int, value long, n long").groupBy("p", "value").agg(F.sum("n").alias("n")), "dedup-prefixes")
    seen = {r["p"]: r["n"] for r in counts.filter("p <= 0").collect()}
    every = seen.get(0, 0)
    size = every / max(1, seen.get(-1, 0)) * total * SUFFIX_BYTES
    bits = P.bucket_bits(partitions, size)
    # Each length has fewer than 4 * groups prefixes with so large a share.
    found = counts.filter((F.col("p") > 0) & (F.col("n") * (4 << bits) > every)).collect()
    return size, bits, {p: np.array([r["value"] for r in found if r["p"] == p], np.int64).view(np.uint64) for p in steps}


def repeats(own: DataFrame, length: int = 20) -> DataFrame:
    """(doc, starts) of documents (doc, text) of unique, non-null keys: for each with repeats the numbers of the words at which a window of ``length`` words that
    also starts earlier begins, packed (see packing.unpack_numbers)."""
    partitions = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size, bits, heavy = heavy_prefixes(own, length, partitions)
    width = len(steps_of(length))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, i, held = [], [], 0

        def flush():
            # Two of a task's equal anchors tell the bucket that they repeat; the others go straight to their documents.
            docs_, ids = np.concatenate(d), np.concatenate(i)
            order = np.lexsort((docs_, ids))
            docs_, ids = docs_[order], ids[order]
            more = np.zeros(len(ids), bool)
            more[2:] = ids[2:] == ids[:-2]
            out = P.send_ids(docs_[~more], ids[~more], bits)
            for b, x, y in P.by_bucket(P.bucket_of(docs_[more], bits), docs_[more], ids[more]):
                out.append((b, 1, P.pack_numbers(x), b"", y.astype("<u8").tobytes()))
            return P.rows(out, P.SCHEMA).to_batches()

        for b in batches:
            doc = b.column(0).to_numpy()
            for a, z, data, offsets in T.blocks(T.column(b, "text")):
                row, ids = anchors(data, offsets, length)
                d.append(doc[a:z][row])
                i.append(ids)
                held += len(ids)
                if held > P.GATHER:
                    yield from flush()
                    d, i, held = [], [], 0
        if held:
            yield from flush()

    def often(table: pa.Table) -> pa.Table:
        d, i = P.received_ids(table, bits)
        order = np.argsort(i, kind="stable")
        d, i = d[order], i[order]
        same = i[1:] == i[:-1]
        keep = np.append(same, False) | np.insert(same, 0, False) if len(i) else np.zeros(0, bool)
        source = table.column("b")[0].as_py()
        out = [(b, source + 2, P.pack_numbers(x), P.pack_ids(y), b"") for b, x, y in P.by_bucket(P.bucket_of(d[keep], bits), d[keep], i[keep])]
        passing = table.filter(pa.compute.equal(table.column("kind"), 1))
        return pa.concat_tables([P.rows(out, P.SCHEMA), passing.select(P.SCHEMA.names).cast(P.SCHEMA)])

    def to_docs(table: pa.Table) -> pa.Table:
        d, i = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for kind, x, y, whole in zip(*(table.column(c).to_pylist() for c in ("kind", "docs", "ids", "more")), strict=True):
            d.append(P.unpack_numbers(x))
            i.append(np.frombuffer(whole, "<u8") if kind == 1 else P.unpack_ids(y, kind - 2, bits))
        d, i = np.concatenate(d), np.concatenate(i)
        order = np.lexsort((i, d))
        d, i = d[order], i[order]
        doc, first = np.unique(d, return_index=True)
        ids = [i[a:z].tobytes() for a, z in zip(first.tolist(), np.append(first, len(d))[1:].tolist(), strict=True)]
        return pa.table({"doc": pa.array(doc, pa.int64()), "anchors": pa.array(ids, pa.binary())})

    def send_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0

        def flush():
            doc, at, f1, f2, key, symbols = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((at, doc))
            doc, at, f1, f2, key, symbols = (x[order] for x in (doc, at, f1, f2, key, symbols))
            first = np.zeros(len(doc), bool)
            first[T.distinct(np.zeros(len(doc), np.int64), f1, f2)] = True
            bucket = (key[first] >> np.uint64(64 - bits)).astype(np.int64)
            out = [
                (b, 0, P.pack_numbers(x), P.pack_unsigned(y), p.astype("<u8").tobytes() + q.astype("<u8").tobytes() + s.astype("<u2").tobytes())
                for b, x, y, p, q, s in P.by_bucket(bucket, doc[first], at[first], f1[first], f2[first], symbols[first])
            ]
            out += _starts(doc[~first], at[~first], bits)
            return P.rows(out, P.SCHEMA).to_batches()

        for b in batches:
            doc, some = b.column(0).to_numpy(), b.column(2)
            for a, z, data, offsets in T.blocks(T.column(b, "text")):
                h, first, _, low, ok, (start, end) = windows(data, offsets, length)
                known = [np.frombuffer(some[k].as_buffer(), "<u8") | np.uint64((k - a) << P.ID_BITS) for k in range(a, z)]
                at = np.flatnonzero(ok)
                row = np.searchsorted(first, at, "right") - 1
                mine = (row.astype(np.uint64) << np.uint64(P.ID_BITS)) | (low[at] >> np.uint64(64 - P.ID_BITS))
                hit = np.isin(mine, np.concatenate(known))
                at, row = at[hit], row[hit]
                if not len(at):
                    continue
                second = T.ngrams(T.span_hashes(data, start, end, 1), length, 1)[at]
                parts.append((doc[a:z][row], at - first[row], T.ngrams(h, length)[at], second, prefix_keys(h, at, length, heavy), labels(h, at, length)))
                held += len(at)
                if held > P.GATHER // 2:
                    yield from flush()
                    parts, held = [], 0
        if held:
            yield from flush()

    def subtree(table: pa.Table) -> pa.Table:
        d, s, f1, f2, symbols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros((0, width), np.uint16)]
        for kind, x, y, p in zip(*(table.column(c).to_pylist() for c in ("kind", "docs", "ids", "more")), strict=True):
            if kind == 0:
                d.append(P.unpack_numbers(x))
                s.append(P.unpack_unsigned(y))
                n = len(s[-1])
                f1.append(np.frombuffer(p, "<u8", n))
                f2.append(np.frombuffer(p, "<u8", n, 8 * n))
                symbols.append(np.frombuffer(p, "<u2", n * width, 16 * n).reshape(n, width))
        d, s = np.concatenate(d), np.concatenate(s)
        leaves, common = tree(np.concatenate(symbols), np.concatenate(f1), np.concatenate(f2), d, s, length)
        first, last = nodes(common, length)
        again = leaves[T.ranges(first + 1, last - first - 1)]
        passing = table.filter(pa.compute.equal(table.column("kind"), 1))
        return pa.concat_tables([P.rows(_starts(d[again], s[again], bits), P.SCHEMA), passing.select(P.SCHEMA.names).cast(P.SCHEMA)])

    def to_starts(table: pa.Table) -> pa.Table:
        d, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in zip(*(table.column(c).to_pylist() for c in ("docs", "ids")), strict=True):
            d.append(P.unpack_numbers(x))
            s.append(P.unpack_unsigned(y))
        d, s = np.concatenate(d), np.concatenate(s)
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        doc, first = np.unique(d, return_index=True)
        packed = [P.pack_numbers(np.unique(s[a:z])) for a, z in zip(first.tolist(), np.append(first, len(d))[1:].tolist(), strict=True)]
        return pa.table({"doc": pa.array(doc, pa.int64()), "starts": pa.array(packed, pa.binary())})

    some = P.by_buckets(own.mapInArrow(T.releasing(send_anchors), P.DDL), size).applyInArrow(often, P.DDL)
    some = P.by_buckets(some, size).applyInArrow(to_docs, "doc long, anchors binary")
    sent = own.join(some.hint("shuffle_hash"), "doc").select("doc", "text", "anchors").mapInArrow(T.releasing(send_suffixes), P.DDL)
    found = P.by_buckets(sent, size).applyInArrow(subtree, P.DDL)
    return P.by_buckets(found, size).applyInArrow(to_starts, "doc long, starts binary")


def _starts(doc: np.ndarray, at: np.ndarray, bits: int) -> list[tuple]:
    """Rows of kind 1: (document, start) pairs on their way to the document's bucket."""
    return [(b, 1, P.pack_numbers(x), P.pack_unsigned(y), b"") for b, x, y in P.by_bucket(P.bucket_of(doc, bits), doc, at)]


def covered(starts: np.ndarray, length: int, words: int) -> np.ndarray:
    """Which words lie in a window that begins at one of the starts."""
    mark = np.zeros(words + 1, np.int32)
    s = starts[starts + length <= words]
    mark[s] = 1
    np.add.at(mark, s + length, -1)
    return np.cumsum(mark[:words]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``text`` the kept words joined by one space.

    A word goes if a window of ``length`` words that covers it also starts earlier: in a document of smaller id, or
    earlier in the same one. Null and empty texts have no words. A row without an id, and a row that repeats an id, are documents of their own,
    which come after all others. Extra columns are ignored. An empty table gives an empty result."""
    own, keys = P.keyed(docs, id_col, text_col)
    own = own.filter("doc IS NOT NULL")  # never null; so that both joins below share one exchange of the texts
    spans = repeats(own, length)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            total, gone, digest, kept_text = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            for i, j, data, offsets in T.blocks(T.column(b, "text")):
                start, end, first = T.words(data, offsets)
                for k in range(i, j):
                    a, z = first[k - i], first[k - i + 1]
                    total[k] = z - a
                    keep = np.ones(z - a, bool)
                    if b.column(2)[k].is_valid:
                        keep = ~covered(P.unpack_numbers(b.column(2)[k].as_py()), length, int(z - a))
                    gone[k] = (z - a) - keep.sum()
                    s, e = start[a:z][keep], end[a:z][keep]
                    # The words one after another with a space after each, less the last.
                    spaced = np.full(int((e - s + 1).sum()), 0x20, np.uint8)
                    spaced[T.ranges(np.cumsum(e - s + 1) - (e - s + 1), e - s)] = data[T.ranges(s, e - s)]
                    left = spaced[:-1].tobytes()
                    digest.append(hashlib.sha256(left).hexdigest())
                    if text:
                        kept_text.append(left.decode())
            out = [b.column(0), pa.array(total), pa.array(gone), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(kept_text, pa.string())] if text else []), names)

    names = ["doc", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + text]
    joined = own.join(spans.hint("shuffle_hash"), "doc", "left").select("doc", "text", "starts")
    out = joined.mapInArrow(T.releasing(drop), "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * text)
    return P.unkeyed(out.withColumnRenamed("doc", "doc_id"), keys, "doc_id").select("doc_id", *names[1:])
