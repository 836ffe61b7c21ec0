"""BPE encoding and decoding with content-defined chunks that are encoded once and reused.

A text is cut in two levels, both by its content alone, so the same passage is cut alike in every document:
*pieces* begin where white space follows other text; *chunks* are runs of pieces whose end is chosen by a
rolling hash over the last pieces. A chunk seen before, in whatever document, is looked up; otherwise it is
put together from its pieces, of which only new ones reach the tokenizer. What a hash finds is compared byte by byte before it is used. A join between pieces is safe when the
tokenizer's pattern cannot reach across it. Other joins are repaired: both sides are re-encoded together
and stay joined unless this agrees exactly with the two sides apart.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: A chunk ends after a piece where the rolling hash of the last ROLL pieces is 0 modulo CHUNK: CHUNK pieces on average.
ROLL, CHUNK = 3, 12
#: Ids held for reuse by a Python worker, of pieces and of chunks; beyond it the store starts anew.
STORE_IDS = 2_000_000
BLOCK = 1 << 21
#: Bytes around a join up to which it is tried; a longer stretch stays one piece, which costs time only.
REPAIR = 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    while size > len(a):
        a = np.concatenate([a, np.zeros_like(a)])
    return a


class Store:
    """Id sequences by content: sorted 64-bit hashes beside growing arrays of the ids and of the bytes that they stand for."""

    def __init__(self, limit: int = STORE_IDS):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bytes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 18, np.uint8)
        self.first, self.first_byte = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.used_bytes = 0

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """``keys``: sorted and not yet here; the ids of each and the span of data that they stand for."""
        n, size = len(self.keys), end - start
        total, total_bytes = self.used + len(ids), self.used_bytes + int(size.sum())
        self.ids, self.bytes = _grown(self.ids, total), _grown(self.bytes, total_bytes)
        self.first, self.first_byte = (_grown(a, n + len(keys) + 1) for a in (self.first, self.first_byte))
        self.ids[self.used : total] = ids
        self.bytes[self.used_bytes : total_bytes] = data[T.ranges(start, size)]
        self.first[n + 1 : n + 1 + len(keys)] = self.used + np.cumsum(lengths)
        self.first_byte[n + 1 : n + 1 + len(keys)] = self.used_bytes + np.cumsum(size)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, np.arange(n, n + len(keys)))
        self.used, self.used_bytes = total, total_bytes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def unlike(self, slots: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which spans of data are not the bytes of their slot."""
        a, size = self.first_byte[slots], end - start
        other = self.first_byte[slots + 1] - a != size
        same = np.flatnonzero(~other)
        if len(same):
            wrong = self.bytes[T.ranges(a[same], size[same])] != data[T.ranges(start[same], size[same])]
            if wrong.any():
                owner = np.repeat(same, size[same])
                other[owner[wrong]] = True
        return other

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slots one after another, and the number of each."""
        first = self.first[slots]
        length = self.first[slots + 1] - first
        return self.ids[T.ranges(first, length)], length


class ChunkEncoder:
    """Encodes blocks of documents exactly as the tokenizer does each whole text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pieces, self.chunks = Store(), Store()
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        alphabet = _byte_alphabet()
        text = []
        for i in range(self.tokenizer.get_vocab_size()):
            word = self.tokenizer.id_to_token(i) or ""
            text.append(special[i].encode() if i in special else bytes(alphabet[c] for c in word))
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.byte_length = np.array([len(t) for t in text], np.int64)
        self.byte_first = np.cumsum(self.byte_length) - self.byte_length
        digits = [f"{i},".encode() for i in range(len(text))]
        self.digit_length = np.array([len(d) for d in digits], np.int64)
        width = max(map(len, digits), default=1)
        self.digits = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), np.uint8).reshape(-1, width)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        length = np.array([len(g) for g in got], np.int64)
        return np.fromiter((i for g in got for i in g), np.uint32, int(length.sum())), length

    def _encode_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of pieces. Those that begin with white space and end in a visible ASCII character are
        safe to join to one another in any order, so the tokenizer gets them in long runs; the ids are dealt out again by their bytes."""
        tail = data[end - 1]
        easy = T.IS_SPACE[data[start]] & (tail > 0x20) & (tail < 0x7F)
        size = end - start
        length = np.zeros(len(start), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * 2
        which = np.flatnonzero(easy)
        if len(which):
            joined = data[T.ranges(start[which], size[which])].tobytes()
            stop = np.cumsum(size[which])
            runs = np.append(np.flatnonzero(np.diff(stop // 8192, prepend=-1)), len(which))
            edge = np.concatenate([[0], stop])[runs]
            parts[0], _ = self._encode([joined[a:z] for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])
            ends = np.searchsorted(np.cumsum(self.byte_length[parts[0]]), stop) + 1
            length[which] = np.diff(ends, prepend=0)
        which = np.flatnonzero(~easy)
        if len(which):
            raw = data.tobytes()
            parts[1], length[which] = self._encode([raw[a:z] for a, z in zip(start[which].tolist(), end[which].tolist(), strict=True)])
        # Back into the order of the pieces.
        first = np.zeros(len(start), np.int64)
        first[easy] = np.cumsum(length[easy]) - length[easy]
        first[~easy] = np.cumsum(length[~easy]) - length[~easy] + len(parts[0])
        return np.concatenate(parts)[T.ranges(first, length)], length

    def _agrees(self, left: bytes, right: bytes) -> bool:
        ids, length = self._encode([left, right, left + right])
        return int(length[0] + length[1]) == int(length[2]) and bool((ids[: length[2]] == ids[length[2] :]).all())

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pieces of a block, in order; every document that isn't empty starts one."""
        if not len(data):
            return np.zeros(0, np.int64)
        space = T.IS_SPACE[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = space[1:] & ~space[:-1]
        at = np.flatnonzero(cut)
        # White space of Unicode ends in C2 85, C2 A0 or is a character of three bytes from E1 to E3; so are other characters.
        lead2, lead3 = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        odd = (lead2 == 0xC2) | ((lead3 >= 0xE1) & (lead3 <= 0xE3)) | (data[at - 1] < 0x20)
        start = np.zeros(len(data), bool)
        start[at[~odd]] = True
        start[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        if odd.any():
            border = np.flatnonzero(start)
            for x in at[odd]:  # repair: encode both sides together, from the last safe start to the next one
                if start[x]:
                    continue
                k = np.searchsorted(border, x, "right")
                a, z = border[k - 1], border[k] if k < len(border) else len(data)
                if z - a <= REPAIR and self._agrees(data[a:x].tobytes(), data[x:z].tobytes()):
                    start[x] = True
                    border = np.insert(border, k, x)
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, first id of each document: n + 1 values)."""
        start = self.cut(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        h = T.span_hashes(data, start, end)
        # Chunks: content-defined runs of pieces.
        roll = T.ngrams(h, ROLL) if len(h) >= ROLL else np.zeros(0, np.uint64)
        last = np.zeros(len(h), bool)
        last[ROLL - 1 :] = roll % np.uint64(CHUNK) == 0
        heads = np.searchsorted(start, offsets[:-1][offsets[1:] > offsets[:-1]])
        first = np.zeros(len(h), bool)
        first[1:] = last[:-1]
        first[heads] = True
        c_at = np.flatnonzero(first)  # first piece of each chunk
        c_start, c_end = start[c_at], np.append(start[c_at[1:]], len(data))
        c_hash = T.span_hashes(data, c_start, c_end)
        if self.chunks.used > self.chunks.limit:
            self.chunks.clear()
        distinct, where, inverse = np.unique(c_hash, return_index=True, return_inverse=True)
        slots = self.chunks.find(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            a = c_at[where[new]]
            count = np.append(c_at[1:], len(h))[where[new]] - a
            ids, length = self._pieces(data, start, end, h, T.ranges(a, count))
            per = np.add.reduceat(length, np.cumsum(count) - count)
            self.chunks.add(distinct[new], ids, per, data, c_start[where[new]], c_end[where[new]])
            slots = self.chunks.find(distinct)
        slots = slots[inverse]
        ids, length = self.chunks.gather(slots)
        ids, length = self._mended(ids, length, self.chunks.unlike(slots, data, c_start, c_end), data, c_start, c_end)
        # Tokens before each document: the chunks before its first byte.
        before = np.searchsorted(c_start, offsets)
        return ids, np.concatenate([[0], np.cumsum(length)])[before]

    def _mended(self, ids, length, wrong, data, start, end) -> tuple[np.ndarray, np.ndarray]:
        """The ids of spans with those encoded anew whose bytes are not the ones that their hash found."""
        if not wrong.any():
            return ids, length
        parts = np.split(ids, np.cumsum(length)[:-1])
        for k in np.flatnonzero(wrong).tolist():
            parts[k], _ = self._encode([data[start[k] : end[k]].tobytes()])
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _pieces(self, data, start, end, h, which) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of the pieces ``which``, the new ones encoded by the tokenizer."""
        if self.pieces.used > self.pieces.limit:
            self.pieces.clear()
        distinct, where, inverse = np.unique(h[which], return_index=True, return_inverse=True)
        slots = self.pieces.find(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            at = which[where[new]]
            ids, length = self._encode_pieces(data, start[at], end[at])
            self.pieces.add(distinct[new], ids, length, data, start[at], end[at])
            slots = self.pieces.find(distinct)
        slots = slots[inverse]
        return self._mended(*self.pieces.gather(slots), self.pieces.unlike(slots, data, start[which], end[which]), data, start[which], end[which])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8, with broken sequences replaced."""
        raw = self.bytes[T.ranges(self.byte_first[ids], self.byte_length[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode()

    def digits_of(self, ids: np.ndarray) -> bytes:
        """The decimal ids joined by commas."""
        rows = self.digits[ids]
        return rows[rows > 0].tobytes()[:-1]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder a Python worker, kept between tasks with what it has encoded."""
    return ChunkEncoder(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, decode: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array of int), and with ``decode`` the decoded text too.

    Null texts count as empty and give no ids. Long texts are encoded whole. No rows give none. Repeated rows give repeated rows; extra columns are ignored. Nothing shuffles."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for i, j, data, offsets in T.blocks(T.column(b, "text"), BLOCK):
                ids, first = e.encode(data, offsets)
                out = [b.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))]
                if decode:
                    out.append(pa.array([e.decode(ids[a:z]).decode() for a, z in zip(first[:-1], first[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "n_tokens", "ids", "decoded"][: 3 + decode]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(T.releasing(run), "doc_id long, n_tokens long, ids array<int>" + ", decoded string" * decode)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, made while the ids are at hand.

    Null texts count as empty. Long texts are taken whole. No rows give none. Repeated rows give repeated rows; extra columns are ignored."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for i, j, data, offsets in T.blocks(T.column(b, "text"), BLOCK):
                ids, first = e.encode(data, offsets)
                parts = [ids[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]
                out = [
                    b.column(0).slice(i, j - i), pa.array(np.diff(first)),
                    pa.array([hashlib.sha256(e.digits_of(p)).hexdigest() for p in parts]),
                    pa.array([hashlib.sha256(e.decode(p)).hexdigest() for p in parts]),
                ]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(T.releasing(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
