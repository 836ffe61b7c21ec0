"""Conversation prefix trie: a count-min screen parts prefixes of one conversation from those that may be shared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..worktable import materialize
from . import textops as T
from .skew import HOT_SHARE

#: Turns that a conversation may take over from another one at most.
HEAD = 3
#: A prefix of turns x1 ... xd has the state x1 B^(d-1) + ... + xd modulo a prime of 127 bits; the factor is an arbitrary fixed value.
PRIME = (1 << 127) - 1
FACTOR = 0x2545F4914F6CDD1D9E3779B97F4A7C15
_LOW = (1 << 64) - 1
#: Rows of the count-min sketch, cells a prefix in each, and cells a row at most (both rows' bits take 32 MB then).
SKETCH_ROWS, CELLS, MOST_CELLS = 2, 4, 1 << 27
#: Cells of a slice of the sketch that is merged at once, and prefixes whose cells a task holds.
SLICE, HELD = 1 << 16, 1 << 20
#: Bytes of ids a piece.
PIECE = 1 << 20


class Trie(NamedTuple):
    """``shared`` and ``tails``: conv_id (the smallest member; with depth it names the node), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens. Nodes of ``tails`` have one member; ``ends_here`` says whether it ends there.
    ``ends``: conv_id and depth of a shared node, and ``member``, a conversation that ends there."""

    shared: DataFrame
    tails: DataFrame
    ends: DataFrame


def _halves(states: list[int]) -> list[pa.Array]:
    return [pa.array(np.array([s >> 64 for s in states], np.int64)), pa.array(np.array([s & _LOW for s in states], np.uint64).view(np.int64))]


def _states(b: pa.RecordBatch, name: str) -> list[int]:
    high, low = (b.column(b.schema.get_field_index(f"{name}{k}")).to_pylist() for k in (1, 2))
    return [(h << 64) | (v & _LOW) for h, v in zip(high, low, strict=True)]


_SCANNED = "conv_id long, part int, rank long, s1 long, s2 long, p1 long, p2 long, before long, words long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted turns of each conversation, with the states after and before each and the words before it, as if the conversation
    began with the partition."""
    conv, rank, state, words = None, 0, 0, 0
    for b in batches:
        ranks, states, last, before = [], [], [], []
        for c, x, w in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if c != conv:
                conv, rank, state, words = c, 0, 0, 0
            rank += 1
            last.append(state)
            before.append(words)
            state = (state * FACTOR + int.from_bytes(x, "big")) % PRIME
            words += w
            ranks.append(rank)
            states.append(state)
        out = [b.column(0), b.column(1), pa.array(ranks, pa.int64()), *_halves(states), *_halves(last), pa.array(before, pa.int64()), b.column(3)]
        yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in _SCANNED.split(", ")])


def scanned(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Every turn with its rank, states and words before it in its conversation: ``_SCANNED`` without part.

    Turns are dealt by ranges of (conversation, turn), so a conversation of any length is spread. A range's first conversation goes on
    from the range before: what it needs, one row a range, is added up on the driver."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    slim = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("x"), words.cast("long").alias("words"))
    dealt = slim.repartitionByRange("conv_id", "turn", "x").sortWithinPartitions("conv_id", "turn", "x")
    rows = materialize(dealt.select("conv_id", F.spark_partition_id().alias("part"), "x", "words").mapInArrow(_scan, _SCANNED), "trie-turns")
    edges = rows.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("z")).orderBy("part").collect()
    spread = sorted({y["a"] for x, y in zip(edges, edges[1:]) if x["z"] == y["a"]})
    carried: dict[tuple[int, int], tuple[int, int, int]] = {}
    if spread:
        last = F.max(F.struct("rank", "s1", "s2", F.col("before") + F.col("words"))).alias("last")
        conv, rank, state, words = None, 0, 0, 0
        for r in rows.filter(F.col("conv_id").isin(spread)).groupBy("conv_id", "part").agg(last).orderBy("conv_id", "part").collect():
            if r["conv_id"] != conv:
                conv, rank, state, words = r["conv_id"], 0, 0, 0
            carried[r["conv_id"], r["part"]] = (rank, state, words)
            n, s1, s2, w = r["last"]
            rank, state, words = rank + n, (state * pow(FACTOR, n, PRIME) + ((s1 << 64) | (s2 & _LOW))) % PRIME, words + w
    names = [c.split()[0] for c in _SCANNED.split(", ")]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            if carried and any(k in carried for k in keys):
                rank, before = b.column(2).to_pylist(), b.column(7).to_pylist()
                after, last = _states(b, "s"), _states(b, "p")
                for i, k in enumerate(keys):
                    if k in carried:
                        n, s, w = carried[k]
                        step = s * pow(FACTOR, rank[i] - 1, PRIME)
                        last[i] = (last[i] + step) % PRIME
                        after[i] = (after[i] + step * FACTOR) % PRIME
                        rank[i], before[i] = rank[i] + n, before[i] + w
                out = [b.column(0), b.column(1), pa.array(rank, pa.int64()), *_halves(after), *_halves(last), pa.array(before, pa.int64()), b.column(8)]
                b = pa.RecordBatch.from_arrays(out, names)
            yield b

    return (rows.mapInArrow(carry, _SCANNED) if carried else rows).drop("part")


_PREFIX = "conv_id long, depth long, s1 long, s2 long, p1 long, p2 long, before long, words long, len long, total long"


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of own turns after the turns taken over, instead of after the own turns that these replace."""
    for b in batches:
        after, last, head, cut = (_states(b, c) for c in ("s", "p", "h", "c"))
        for i, n in enumerate(b.column(b.schema.get_field_index("steps")).to_pylist()):
            if head[i] != cut[i]:
                step = (head[i] - cut[i]) * pow(FACTOR, n - 1, PRIME)
                last[i] = (last[i] + step) % PRIME
                after[i] = (after[i] + step * FACTOR) % PRIME
        rest = {c: b.column(b.schema.get_field_index(c)) for c in ("conv_id", "depth", "before", "words", "len", "total")}
        out = [rest["conv_id"], rest["depth"], *_halves(after), *_halves(last), *(rest[c] for c in ("before", "words", "len", "total"))]
        yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in _PREFIX.split(", ")])


def prefixes(turns: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """(prefixes of depth 1 and more, roots): a row per prefix and conversation, where a conversation's first ``taken`` turns (up to three) are
    replaced by those of conversation ``base``: all if it has fewer, none if there is none."""
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= HEAD, F.struct("rank", "s1", "s2", "p1", "p2", "before", "words"))))
    convs = turns.groupBy("conv_id").agg(F.max("rank").alias("own"), F.sum("words").alias("own_words"), first.alias("first"))
    convs = materialize(convs.withColumn("base", base).withColumn("h", F.least(taken.cast("long"), F.lit(HEAD))), "trie-conversations")
    other = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("theirs"))
    head = F.slice(F.coalesce("theirs", F.array().cast(convs.schema["first"].dataType)), 1, F.col("h").cast("int"))
    forks = convs.join(other, "base", "left").withColumn("head", head).withColumn("cut", F.slice("first", 1, F.col("h").cast("int")))

    def ends(c: str, field: str) -> Column:
        last = F.when(F.size(c) > 0, F.element_at(c, -1))
        return F.coalesce(last["before"] + last["words"] if field == "words" else last[field], F.lit(0))

    k = F.size("head").cast("long")
    forks = forks.select(
        "conv_id", "h", "head", k.alias("k"), *[ends(c, f"s{i}").alias(f"{c[0]}{i}") for c in ("head", "cut") for i in (1, 2)],
        ends("head", "words").alias("head_words"), ends("cut", "words").alias("cut_words"), "own_words", (k + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"),
    )
    forks = materialize(forks.withColumn("total", F.col("head_words") + F.col("own_words") - F.col("cut_words")), "trie-forks")
    columns = [c.split()[0] for c in _PREFIX.split(", ")]
    taken_over = forks.select("conv_id", "len", "total", F.explode("head").alias("x")).select("conv_id", F.col("x.rank").alias("depth"), "x.*", "len", "total").select(columns)
    own = turns.join(forks.drop("head", "own_words"), "conv_id").filter("rank > h").withColumn("steps", F.col("rank") - F.col("h"))
    own = own.withColumn("depth", F.col("k") + F.col("steps")).withColumn("before", F.col("head_words") + F.col("before") - F.col("cut_words"))
    rows = materialize(own.mapInArrow(_moved, _PREFIX).unionByName(taken_over), "trie-prefixes")
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "s1", "s2", "p1", "p2", "before", "words")]
    return rows, forks.select("conv_id", *zero, "len", "total")


def _cells(high: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """The cell of each state in each row of the sketch, rows one after the other."""
    mask = np.uint64(width - 1)
    return np.stack([(T.mix(x.view(np.uint64)) & mask).astype(np.int64) + k * width for k, x in enumerate((low, high))])


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """For every cell of the count-min sketch whether it counts two or more: all that telling an estimate of one takes.

    A task counts its own cells and hands on the touched ones, by slices; slices are added up by tasks and their bits come to the driver,
    ``SKETCH_ROWS * MOST_CELLS`` of them at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            held.clear()
            cell = np.repeat(cell, np.minimum(n, 2))
            part, first = np.unique(cell // SLICE, return_index=True)
            pieces = np.split((cell % SLICE).astype("<u2"), first[1:]) if len(part) else []
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array([p.tobytes() for p in pieces], pa.binary())], ["slice", "cells"])

        for b in batches:
            held.append(_cells(b.column(0).to_numpy(), b.column(1).to_numpy(), width).ravel())
            if sum(map(len, held)) > SKETCH_ROWS * HELD:
                yield flush()
        yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = np.frombuffer(cells.as_buffer(), "<u2")
                n = np.bincount(at, minlength=SLICE).astype(np.uint8)  # at most two of one cell
                counts[part] = np.minimum(counts[part] + n, 2) if part in counts else n
        bits = [np.packbits(c >= 2, bitorder="little").tobytes() for c in counts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(bits, pa.binary())], ["slice", "bits"])

    counted = rows.select("s1", "s2").mapInArrow(count, "slice long, cells binary").repartition("slice").mapInArrow(add, "slice long, bits binary")
    out = np.zeros(SKETCH_ROWS * width // 8, np.uint8)
    for r in counted.toLocalIterator():
        out[r["slice"] * SLICE // 8 :][: SLICE // 8] = np.frombuffer(r["bits"], np.uint8)[: len(out)]
    return out


def screened(rows: DataFrame) -> DataFrame:
    """The rows with ``single``: the estimate of the prefix, or of the one before it, is one, so no other conversation has it; and ``top``: that
    can't be told of the one before it."""
    width = max(SLICE, 1 << int(CELLS * max(1, rows.count()) - 1).bit_length())
    width = min(width, MOST_CELLS)  # past that, more prefixes take the exact way
    shared = rows.sparkSession.sparkContext.broadcast(sketch(rows, width))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            depth = b.column(1).to_numpy()
            one = []
            for i in (2, 4):
                cells = _cells(b.column(i).to_numpy(), b.column(i + 1).to_numpy(), width)
                one.append(((bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 0).any(0))
            before = one[1] & (depth > 1)
            single = one[0] | before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(single), pa.array(single & ~before)], [*b.schema.names, "single", "top"])

    return rows.mapInArrow(flag, _PREFIX + ", single boolean, top boolean")


def prefix_trie(
    turns: DataFrame, base: Column | None = None, taken: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> Trie:
    """The trie of all conversations: a node for each distinct sequence of a conversation's first turns (role, text).

    ``base`` and ``taken`` (columns over ``conv_id``) say that conversations are stored as forks, see ``prefixes``. Turns are ordered by
    ``turn``, nulls first, equal ones by a digest of role and text; null roles and texts count as empty, repeated rows are turns of their own.
    Rows without a conversation's id belong to none and are left out. Texts are taken whole; no conversations give no nodes; further
    columns are ignored, whatever their names.

    A conversation owns the nodes of which it is the smallest member: from some depth to its end. So what a subtree adds up is a sum over the
    members of its top, one aggregate for all nodes, and no pairs of nodes and ancestors are made. Members: n_convs. Owners of the
    next node: n_children. Owners of a childless end: n_leaves. saved_tokens: words from the node's depth on, less those owned."""
    base = F.col("conv_id") if base is None else base
    rows, roots = prefixes(scanned(turns, conv_col, turn_col, role_col, text_col), base, F.lit(0) if taken is None else taken)
    judged = screened(rows)
    sent = materialize(judged.filter("NOT single OR top"), "trie-shared")
    tops = sent.filter("single")
    shared = sent.filter("NOT single").drop("single", "top").unionByName(roots)
    key = ["depth", "s1", "s2"]
    least = shared.groupBy(*key).agg(F.min("conv_id").alias("least"), F.max("len").alias("longest"), F.max("before").alias("before"))
    least = materialize(least, "trie-least")
    owned = least.select(F.col("least").alias("conv_id"), "depth", "before", (F.col("longest") == F.col("depth")).alias("leaf"))
    owned = owned.unionByName(tops.select("conv_id", "depth", "before", F.lit(True).alias("leaf")))
    owners = owned.groupBy("conv_id").agg(F.min("depth").alias("since"), F.min_by("before", "depth").alias("own_before"), F.max("leaf").alias("leaf"))
    member = shared.join(owners, "conv_id", "left")
    deep, to_end = F.coalesce("since", F.col("len") + 1), F.col("total") - F.col("before")
    own = F.coalesce(F.col("total") - F.col("own_before"), F.lit(0))
    nodes = member.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if((F.col("len") > F.col("depth")) & (deep <= F.col("depth") + 1)).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"), F.sum(F.when(F.col("depth") < deep, to_end - own).otherwise(0)).alias("saved_tokens"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    nodes = materialize(nodes, "trie-nodes")
    alone = [F.lit(1).cast("long").alias("n_convs"), (F.col("len") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")]
    here = (F.col("len") == F.col("depth")).alias("ends_here")
    seek = nodes.drop("s1", "s2").withColumn("ends_here", F.lit(None).cast("boolean"))
    seek = seek.unionByName(tops.select("conv_id", "depth", "p1", "p2", *alone, here))
    # Nodes of many children are few, so their numbers are sent along; the rest meet their parents by key.
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = sent.count() // HOT_SHARE + 1
    to = ["depth", "p1", "p2"]
    looked = seek.join(F.broadcast(parent.filter(F.col("n_children") > many).drop("n_children")), to, "left")
    rest = looked.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(parent.filter(F.col("n_children") <= many).drop("n_children"), to, "left")
    found = looked.filter("parent_conv_id IS NOT NULL").unionByName(rest)
    # A parent that isn't among the shared nodes was a tail's.
    found = found.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    tails = judged.filter("single AND NOT top").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *alone, here)
    ends = shared.filter("len = depth").select(*key, F.col("conv_id").alias("member")).join(least.select(*key, "least"), key)
    return Trie(
        found.filter("ends_here IS NULL").select(columns), found.filter("ends_here IS NOT NULL").select(*columns, "ends_here").unionByName(tails),
        ends.select(F.col("least").alias("conv_id"), "depth", "member"),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined members of each node, in pieces of about ``PIECE`` bytes."""
    node, held, size = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*node, held[0])] + [pa.array([",".join(map(str, held))])], ["conv_id", "depth", "first", "ids"])

    for b in batches:
        for c, d, m in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if held and ((c, d) != node or size > PIECE):
                yield piece()
                held, size = [], 0
            node = (c, d)
            held.append(m)
            size += 20
    if held:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, running = None, None
    for b in batches:
        out = []
        for c, d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
            if (c, d) == node:
                running.update(b",")
            else:
                if node is not None:
                    out.append((*node, running.hexdigest()))
                node, running = (c, d), hashlib.sha256()
            running.update(ids.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([running.hexdigest()])], ["conv_id", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: SHA-256 of a node's ascending decimal members joined by commas.

    Ranges of (node, member) join their ids by many tasks, so a node of a third of all conversations is a few long pieces to the task that
    runs the digest over them, which has to go from first to last."""
    pieces = ends.repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    pieces = pieces.mapInArrow(_pieces, "conv_id long, depth long, first long, ids string")
    dealt = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return dealt.mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def with_digests(trie: Trie) -> DataFrame:
    """All nodes with ends_sha256; that of a node where no conversation ends is the empty string's."""
    none = F.sha2(F.lit("").cast("binary"), 256)
    shared = trie.shared.join(ends_digests(trie.ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    own = F.when(F.col("ends_here"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none)
    return shared.unionByName(trie.tails.withColumn("ends_sha256", own).drop("ends_here"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY i) AS ms FROM t GROUP BY conv_id
), crc AS (
  SELECT conv_id, conv_id::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS v FROM own
  UNION ALL
  SELECT conv_id, s, k + 1, xor(w >> 1, CASE WHEN w & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(s[k // 8 + 1])::BIGINT) ELSE v END AS w FROM crc WHERE k < 8 * length(s)) AS stepped
), fork AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, (xor(v, 4294967295) % 4)::INT AS h FROM crc WHERE k = 8 * length(s)
), conv AS (
  SELECT fork.conv_id, list_concat(coalesce(b.ms[1:h], []), own.ms[h + 1:]) AS ms
  FROM fork JOIN own USING (conv_id) LEFT JOIN own b ON b.conv_id = fork.base
), prefix AS (
  SELECT conv_id, len(ms) AS n, d AS depth, md5(to_json(ms[1:d])::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(to_json(ms[1:d - 1])::VARCHAR) END AS parent,
    CASE WHEN d > 0 THEN len([w FOR w IN string_split_regex(ms[d].x, '[\x20\x09-\x0D]+') IF w <> '']) ELSE 0 END AS words
  FROM conv, unnest(range(0, len(ms) + 1)) u(d)
), nodes AS (
  SELECT node, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefix GROUP BY node, depth
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), above AS (
  SELECT a.node AS top, b.node AS node FROM nodes b JOIN prefix a ON a.conv_id = b.conv_id AND a.depth <= b.depth
), sums AS (
  SELECT top, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM above JOIN nodes USING (node) LEFT JOIN children USING (node) GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node JOIN sums s ON s.top = n.node
"""
