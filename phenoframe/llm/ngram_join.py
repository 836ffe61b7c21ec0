"""N-gram Jaccard join by prefix filters under several global token orders.

Candidates come from posting lists of the rarest-first prefixes, of which only pairs go on that may reach the similarity by
their sizes, their places and parity sketches, and whose prefixes meet under the other orders too. The texts of what is left are
then compared by 128-bit shingle hashes; 46-bit ids only find candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..worktable import materialize
from . import packing as P
from . import textops as T
from .skew import components, with_group

#: Document frequencies are kept as SCALE times their binary logarithm, in a byte; ties go by the id.
SCALE = 8
HOT = 255
#: Multipliers that give the second and third token order; fixed values.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Documents in which tokens of a hundredth of all documents or more are looked for (about so many).
SAMPLE_DOCS = 2000
#: The members of open lists meet one member a round, until meeting each other takes this many comparisons a member at most, a round links
#: fewer than one in so many of them, or so many rounds have passed. This is a matter of cost; the result is the same.
FEW, HUB_ROUNDS = 64, 6
SIGNATURE = ("s0", "s1", "s2", "s3")


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, second hash) of the distinct n-word shingles of each document; a shorter one's whole sequence is one."""
    data = T.lower_ascii(data)
    start, end, first = T.words(data, offsets)
    size = np.diff(first)
    last, owner = np.repeat(first[1:], size), np.repeat(np.arange(len(size)), size)
    lanes = []
    for lane in (0, 1):
        h = T.span_hashes(data, start, end, lane)
        g = T.ngrams(h, n, lane)
        ok = np.arange(len(g)) + n <= last[: len(g)]
        parts, rows = [g[ok]], [owner[: len(g)][ok]]
        for k in range(1, n):
            short = np.flatnonzero(size == k)
            if len(short):
                parts.append(T.mix(T.ngrams(h, k, lane)[first[:-1][short]] + np.uint64(k)))
                rows.append(short)
        lanes.append(np.concatenate(parts))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    row, a, b = row[order], lanes[0][order], lanes[1][order]
    keep = T.distinct(row, a, b)
    return row[keep], a[keep], b[keep]


def least_overlap(n: int | np.ndarray, percent: int):
    """The fewest common shingles with which a set of n can reach the similarity."""
    return -(-n * percent // 100)


def prefix(ids: np.ndarray, df: np.ndarray, n: int, percent: int, order: int) -> np.ndarray:
    """The shared tokens in the prefix of a set of n under a global order; tokens of no other document come first in all.

    order 0: rarest first, then by id; others: by another scramble of the id."""
    rank = np.lexsort((ids, df)) if order == 0 else np.argsort(ids * np.uint64(ORDERS[order - 1]), kind="stable")
    length = n - int(least_overlap(n, percent)) + 1 - (n - len(ids))
    return ids[rank[: max(0, length)]]


def sketches(ids: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Parities of 256 cells into which the tokens of each set fall, as four longs a set: sets differ in as many tokens as these differ in bits, or more."""
    cell = owner * 256 + (T.mix(ids ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(56)).astype(np.int64)
    odd = (np.bincount(cell, minlength=rows * 256) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(rows, 4)


def common_tokens(own: DataFrame, n: int) -> tuple[np.ndarray, float]:
    """(ids in a hundredth of the documents of a sample or more, about how many bytes the pairs of all documents take)."""
    sample, total = P.sampled(own, SAMPLE_DOCS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in T.blocks(T.column(b, "text")):
                _, h, _ = shingles(data, offsets, n)
                value, times = np.unique(h >> np.uint64(64 - P.ID_BITS), return_counts=True)
                often = times > 1
                yield pa.RecordBatch.from_arrays([pa.array(value[often].astype(np.int64)), pa.array(times[often])], ["id", "times"])
                yield pa.RecordBatch.from_arrays([pa.array([-1, -2]), pa.array([j - i, len(h)])], ["id", "times"])

    counts = materialize(sample.mapInArrow(T.releasing(count), "id long, times long").groupBy("id").agg(F.sum("times").alias("times")), "join-common")
    seen = {r["id"]: r["times"] for r in counts.filter("id < 0").collect()}
    rows = max(1, seen.get(-1, 0))
    # A sample of bounded size holds few ids that stand in so many of its documents.
    hot = [r["id"] for r in counts.filter(F.col("times") >= max(20, rows // 100)).filter("id >= 0").select("id").collect()]
    return np.sort(np.array(hot, np.uint64)), seen.get(-2, 0) / rows * total * 7.0


def shared_sets(own: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per document: its key, set size, 128-bit digest of the set (m1, m2), and for those that can be linked at all
    shared (tokens that other documents have), central (how frequent its tokens are), the sketch, and the prefix under each order.

    One exchange brings the ids of all documents together by id, which gives document frequencies; a second one brings those of two
    or more documents back. A task sends the ids of the smallest of its documents of equal sets only, and ids known to be common go straight
    to their documents, so that no bucket grows with a group of copies or a common passage."""
    spark = own.sparkSession
    hot, size = common_tokens(own, n)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = P.bucket_bits(partitions, size)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0

        def flush():
            doc, count, m1, m2 = (np.concatenate(c) for c in zip(*(p[:4] for p in parts), strict=True))
            d, i = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
            out = []
            for b, x, c, y, z in P.by_bucket(P.bucket_of(doc, bits), doc, count, m1, m2):
                out.append((b, 1, P.pack_numbers(x), P.pack_unsigned(c), y.astype("<u8").tobytes() + z.astype("<u8").tobytes()))
            order = np.lexsort((doc, count, m2, m1))
            a, z = order[:-1], order[1:]
            again = np.sort(doc[z[(m1[a] == m1[z]) & (m2[a] == m2[z]) & (count[a] == count[z])]])
            keep = ~_in_sorted(d, again)
            d, i = d[keep], i[keep]
            common = _in_sorted(i, hot)
            out += P.send_ids(d[~common], i[~common], bits)
            for b, x, y in P.by_bucket(P.bucket_of(d[common], bits), d[common], i[common]):
                out.append((b, 2, P.pack_numbers(x), b"", y.astype("<u8").tobytes()))
            return P.rows(out, P.SCHEMA).to_batches()

        for b in batches:
            doc = b.column(0).to_numpy()
            for i, j, data, offsets in T.blocks(T.column(b, "text")):
                row, g, g2 = shingles(data, offsets, n)
                first = np.searchsorted(row, np.arange(j - i + 1))
                sums = [np.diff(np.concatenate([[np.uint64(0)], np.cumsum(T.mix(x), dtype=np.uint64)])[first]) for x in (g, g2)]
                parts.append((doc[i:j], np.diff(first), *sums, doc[i:j][row], g >> np.uint64(64 - P.ID_BITS)))
                held += len(g) + j - i
                if held > P.GATHER:
                    yield from flush()
                    parts, held = [], 0
        if held:
            yield from flush()

    def count(table: pa.Table) -> pa.Table:
        d, i = P.received_ids(table, bits)
        order = np.argsort(i, kind="stable")
        d, i = d[order], i[order]
        first = np.flatnonzero(np.diff(i, prepend=i[:1] ^ np.uint64(1))) if len(i) else np.zeros(0, np.int64)
        df = np.repeat(np.diff(np.append(first, len(i))), np.diff(np.append(first, len(i))))
        keep = df > 1
        d, i, df = d[keep], i[keep], np.minimum(np.log2(df[keep]) * SCALE, HOT - 1)
        # The bucket that the ids came from goes along as kind - 3.
        own_bucket = table.column("b")[0].as_py()
        out = [(b, own_bucket + 3, P.pack_numbers(x), P.pack_ids(y), z.astype(np.uint8).tobytes()) for b, x, y, z in P.by_bucket(P.bucket_of(d, bits), d, i, df)]
        passing = table.filter(pa.compute.greater(table.column("kind"), 0))
        return pa.concat_tables([P.rows(out, P.SCHEMA), passing.select(P.SCHEMA.names).cast(P.SCHEMA)])

    def gather(table: pa.Table) -> pa.Table:
        docs_, ids_, dfs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        every = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
        for kind, d, i, f in zip(*(table.column(c).to_pylist() for c in ("kind", "docs", "ids", "more")), strict=True):
            if kind == 1:
                marks = np.frombuffer(f, "<u8").reshape(2, -1)
                for to, x in zip(every, (P.unpack_numbers(d), P.unpack_unsigned(i), marks[0], marks[1]), strict=True):
                    to.append(x)
                continue
            docs_.append(P.unpack_numbers(d))
            ids_.append(np.frombuffer(f, "<u8") if kind == 2 else P.unpack_ids(i, kind - 3, bits))
            dfs.append(np.full(len(ids_[-1]), HOT, np.uint8) if kind == 2 else np.frombuffer(f, np.uint8))
        d, i, f = np.concatenate(docs_), np.concatenate(ids_), np.concatenate(dfs)
        order = np.lexsort((i, d))
        d, i, f = d[order], i[order], f[order]
        doc, size, m1, m2 = (np.concatenate(x) for x in every)
        a, z = np.searchsorted(d, doc), np.searchsorted(d, doc, "right")
        can = (z - a >= np.maximum(1, least_overlap(size, percent))) & (size > 0)
        shared, central = np.where(can, z - a, 0), np.zeros(len(doc), np.int64)
        prefixes: list[list] = [[], [], []]
        marks = np.zeros((len(doc), 4), np.int64)
        for k in range(len(doc)):
            if not can[k]:
                for p in prefixes:
                    p.append(None)
                continue
            x, fx, nx = i[a[k] : z[k]], f[a[k] : z[k]], int(size[k])
            central[k] = int(fx.sum(dtype=np.int64)) // nx
            marks[k] = sketches(x, np.zeros(len(x), np.int64), 1)[0]
            prefixes[0].append(prefix(x, fx, nx, percent, 0).astype(np.int64))
            for order in (1, 2):
                prefixes[order].append(prefix(x, fx, nx, percent, order).astype(np.uint32).view(np.int32))
        columns = [pa.array(doc), pa.array(size), pa.array(m1.view(np.int64)), pa.array(m2.view(np.int64)), pa.array(shared), pa.array(central)]
        columns += [pa.array(np.ascontiguousarray(marks[:, k])) for k in range(4)]
        columns += [pa.array(prefixes[0], pa.list_(pa.int64())), *(pa.array(p, pa.list_(pa.int32())) for p in prefixes[1:])]
        return pa.table(columns, names=["doc", "n", "m1", "m2", "shared", "central", *SIGNATURE, "p0", "p1", "p2"])

    ddl = "doc long, n long, m1 long, m2 long, shared long, central long, s0 long, s1 long, s2 long, s3 long, p0 array<long>, p1 array<int>, p2 array<int>"
    counted = P.by_buckets(own.mapInArrow(T.releasing(send), P.DDL), size).applyInArrow(count, P.DDL)
    return P.by_buckets(counted, size).applyInArrow(gather, ddl)


def _in_sorted(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], percent: int) -> bool:
    """Whether two sets, given by both lanes of their hashes, reach the similarity."""
    x, y = len(a[0]), len(b[0])
    if 100 * min(x, y) < percent * max(x, y):
        return False
    both, i, j = np.intersect1d(a[0], b[0], return_indices=True)
    common = int((a[1][i] == b[1][j]).sum())
    if common < len(both) or len(np.unique(a[0])) < x or len(np.unique(b[0])) < y:  # one lane doesn't tell them apart
        common = len(set(zip(*(v.tolist() for v in a), strict=True)) & set(zip(*(v.tolist() for v in b), strict=True)))
    return 100 * common >= percent * (x + y - common)


def verified(pairs: DataFrame, own: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (x, y) that are links, by their whole texts."""
    need = materialize(pairs.select(F.col("x").alias("doc")).union(pairs.select("y")).distinct(), "join-need")
    texts = materialize(own.join(need, "doc", "left_semi"), "join-texts")
    left, right = (texts.select(F.col("doc").alias(c), F.col("text").alias("t" + c)) for c in "xy")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(b.schema.get_field_index(c)).to_numpy() for c in "xy")
            docs, first, place = np.unique(np.concatenate([x, y]), return_index=True, return_inverse=True)
            text = pa.concat_arrays([T.column(b, "tx"), T.column(b, "ty")]).take(pa.array(first))
            sets = []
            for i, j, data, offsets in T.blocks(text):
                row, g, g2 = shingles(data, offsets, n)
                at = np.searchsorted(row, np.arange(j - i + 1))
                sets += [(g[u:v], g2[u:v]) for u, v in zip(at[:-1], at[1:], strict=True)]
            ok = np.array([similar(sets[u], sets[v], percent) for u, v in zip(place[: len(x)], place[len(x) :], strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok])], ["a", "b"])

    return pairs.join(left, "x").join(right, "y").mapInArrow(T.releasing(check), "a long, b long")


def _differ(a: str, b: str, percent: int) -> str:
    """SQL: by their sketches and the tokens that no other set has, two sets may differ in few enough tokens."""
    bits = " + ".join(f"bit_count({a}{s} ^ {b}{s})" for s in SIGNATURE)
    return f"{100 + percent} * ({a}n - {a}shared + {b}n - {b}shared + {bits}) <= {100 - percent} * ({a}n + {b}n)"


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id (smallest id of the documents with an equal set), component_id.

    Texts are lower-cased A-Z and split at ASCII white space. Documents link when the Jaccard similarity of their shingle sets is
    ``percent`` or more. Empty and null texts have an empty set, and stand alone. A row without an id, and a row that repeats an id, are
    documents of their own; a component or class has an id of null only if none of its rows has one. Extra columns are ignored.

    Equal sets are one class, and only its representative is joined. Candidates share a token in the prefix under every order. The posting
    lists of the rarest-first order are first joined with one member each, the most central one; what is then in one component needs no further check. Lists
    that still span components meet another member, and after some rounds the members of different components meet each other, where only pairs that
    may be similar by their sketches come out of the join. So no link between components is lost."""
    own, names = P.keyed(docs, id_col, text_col)
    sets = materialize(shared_sets(own, n, percent), "join-sets")
    total = max(1, sets.count())
    marked = sets.filter("n > 0").select("doc", F.struct("n", "m1", "m2").alias("mark"))
    classes = materialize(with_group(marked, "mark", total, low=F.min("doc")).filter("low <> doc").select("doc", F.col("low").alias("class")), "join-classes")
    reps = materialize(sets.filter("p0 IS NOT NULL").join(classes, "doc", "left_anti").drop("m1", "m2"), "join-reps")

    posts = reps.select("doc", "n", "shared", "central", F.posexplode("p0").alias("place", "token"))
    posts = posts.select("token", "doc", "n", "central", (F.col("shared") - F.col("place")).alias("rest"))
    lists = posts.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token")
    posts = materialize(posts.join(materialize(lists, "join-lists"), "token"), "join-posts")
    # A similar pair has all it shares at or after the first token that it shares: enough must be left on both sides there.
    fits = f"100 * least({{0}}n, {{1}}n) >= {percent} * greatest({{0}}n, {{1}}n) AND {100 + percent} * least({{0}}rest, {{1}}rest) >= {percent} * ({{0}}n + {{1}}n)"
    sides = [reps.select(F.col("doc").alias(c), *(F.col(k).alias(c + k) for k in ("n", "shared", *SIGNATURE, "p1", "p2"))) for c in "xy"]

    def links_of(pairs: DataFrame) -> DataFrame:
        """Links among pairs (x, y) of the first order: the other orders are met before texts are."""
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        met = materialize(pairs, "join-pairs").join(sides[0], "x").join(sides[1], "y")
        met = met.filter(F.expr(_differ("x", "y", percent))).filter("arrays_overlap(xp1, yp1) AND arrays_overlap(xp2, yp2)")
        return materialize(verified(materialize(met.select("x", "y"), "join-pairs"), own, n, percent), "join-links")

    links, roots, still, few = None, None, posts.withColumn("root", F.col("doc")), False
    for k in range(HUB_ROUNDS + 1):
        if few or k == HUB_ROUNDS:
            full = materialize(still.join(reps.select("doc", "shared", *SIGNATURE), "doc"), "join-still")
            l, r = full.alias("l"), full.alias("r")
            across = l.join(r, F.expr("l.token = r.token AND l.doc > r.doc AND l.root <> r.root AND " + fits.format("l.", "r.") + " AND " + _differ("l.", "r.", percent)))
            found = links_of(across.select(F.col("l.doc").alias("x"), F.col("r.doc").alias("y")))
        else:
            hub = F.max(F.struct("central", (-F.col("doc")).alias("minus"), "root", F.col("doc").alias("hub"), F.col("n").alias("hub_n"), F.col("rest").alias("hub_rest")))
            hubs = materialize(still.groupBy("token").agg(hub.alias("h")).select("token", "h.hub", "h.hub_n", "h.hub_rest", F.col("h.root").alias("hub_root")), "join-hubs")
            near = still.join(hubs, "token").filter(F.expr(fits.format("", "hub_")) & (F.col("root") != F.col("hub_root")))
            found = links_of(near.select(F.col("doc").alias("x"), F.col("hub").alias("y")))
            still = still.join(hubs.select(F.col("token"), F.col("hub").alias("doc")), ["token", "doc"], "left_anti")
        links = found if links is None else links.union(found)
        if roots is None or not found.isEmpty():
            roots = materialize(components(links), "join-roots")
        if few or k == HUB_ROUNDS:
            break
        # Lists whose members are in different components, without those that have met all others.
        placed = still.drop("root").join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        placed = materialize(placed, "join-placed")
        spread = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).filter("low < high")
        spread = materialize(spread.select("token", "m"), "join-open")
        members, work = spread.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.col("m") * F.col("m").cast("double")), F.lit(0.0))).first()
        if not members:
            break
        few = work <= FEW * members or found.count() * FEW < members
        still = materialize(placed.join(spread.select("token"), "token"), "join-still")

    of_class = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("doc", "class", F.coalesce("root", "class").alias("root"))
    members = of_class.select("doc", "class", "root").unionByName(roots.select(F.col("node").alias("doc"), F.col("node").alias("class"), "root"))
    out = sets.select("doc", "n").join(materialize(members, "join-members"), "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("class", "doc").alias("class_id"), F.coalesce("root", "doc").alias("component_id"),
    )
    return P.unkeyed(out, names, "doc_id", "class_id", "component_id")
