"""Filter interaction audit: truth-table survival words and positional popcounts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..worktable import materialize

#: Words that one row of carry-save adders takes: 2^4 - 1, so that four bit planes hold any count.
ADDED = 15
#: Parts whose counts a task holds before it hands them on.
PARTS_HELD = 4096


def word_filters(words: Column, text: Column) -> dict[str, Column]:
    """Failure conditions on a text that isn't null: short, repetitive, shouting, with marks of markup."""
    n, size = F.size(words), F.length(text)
    capitals = size - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals > 2 * size, "D": text.rlike("[#$%&*|]")}


def truth_words(filters: int) -> list[int]:
    """For each set of failed filters the word whose bit s stands where a document survives the filters of subset s."""
    return [sum(1 << s for s in range(1 << filters) if not s & failed) for failed in range(1 << filters)]


def positional_popcounts(words: np.ndarray, group: np.ndarray, groups: int, bits: int) -> np.ndarray:
    """How often each bit stands in the words of each group: an int64 array (groups, bits).

    Each group's words are laid out in rows of 15. Full adders turn a row into four bit planes, so bits are counted plane by
    plane and not word by word."""
    total = np.zeros((groups, bits), np.int64)
    if not len(words):
        return total
    order = np.argsort(group, kind="stable")
    size = np.bincount(group, minlength=groups)
    rows = -(-size // ADDED)
    laid = np.zeros(int(rows.sum()) * ADDED, words.dtype)
    first = np.repeat((np.cumsum(rows) - rows) * ADDED - (np.cumsum(size) - size), size)
    laid[first + np.arange(len(words))] = words[order]
    level, planes = list(laid.reshape(-1, ADDED).T), []
    while level:
        carries = []
        while len(level) > 1:
            a, b, c = level.pop(), level.pop(), level.pop()
            half = a ^ b
            level.append(half ^ c)
            carries.append((a & b) | (half & c))
        planes.append(level[0])
        level = carries
    owner = np.repeat(np.arange(groups), rows)
    one = words.dtype.type(1)
    for weight, plane in enumerate(planes):
        for bit in range(bits):
            total[:, bit] += np.bincount(owner, (plane >> words.dtype.type(bit)) & one, groups).astype(np.int64) << weight
    return total


def weighted_popcounts(words: np.ndarray, times: np.ndarray, group: np.ndarray, groups: int, bits: int) -> np.ndarray:
    """As above where each word counts ``times``: once for every binary digit of the numbers, so that nothing is repeated."""
    total = np.zeros((groups, bits), np.int64)
    for digit in range(int(times.max()).bit_length() if len(times) else 0):
        has = (times >> digit) & 1 == 1
        total += positional_popcounts(words[has], group[has], groups, bits) << digit
    return total


def survival_words(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, good, toxic, word, n): one row for all rows of equal id, part and text, with their number.

    Texts are read once, and only ids, parts, digests and failure bits shuffle. A row fails the last filter (E) if its text has a smaller
    id: the least id of each digest, found by an aggregate that combines inside tasks, meets rows by digest and id together,
    so copies of one text don't share a task; neither do rows without an id, which have no smaller text and no label."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    read = read.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    fails = sum((F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(word_filters(F.col("words"), F.col("text")).values())), F.lit(0))
    digest = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)
    rows = read.select("doc_id", "part", fails.alias("fails"), digest.alias("digest")).groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    rows = materialize(rows, "audit-rows")
    least = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    marked = marked.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without an id get a spread second key, so that none of the joins gathers them.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0))
    rows = rows.join(least, ["digest", "doc_id"], "left").withColumn("salt", salt).join(marked.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    late = F.col("doc_id").isNotNull() & F.col("first").isNull()
    word = F.element_at(F.lit(truth_words(5)), F.col("fails") + F.when(late, 16).otherwise(0) + 1)
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return rows.select("doc_id", "part", *flags, word.cast("long").alias("word"), "n")


def survivors(words: DataFrame, filters: int = 5) -> DataFrame:
    """(part, subset, kept, good, toxic): how many documents of the part survive the filters of each subset, in all and by label."""
    bits = 1 << filters

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            totals = np.stack(list(held.values())) if held else np.zeros((0, 3, bits), np.int64)
            parts = np.repeat(np.array(list(held), object), bits)
            subset = np.tile(np.arange(bits, dtype=np.int32), len(held))
            out = [pa.array(parts, pa.string()), pa.array(subset)] + [pa.array(totals[:, k].ravel()) for k in range(3)]
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["part", "subset", "kept", "good", "toxic"])

        for b in batches:
            names, group = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            good, toxic = (b.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (1, 2))
            word, n = b.column(3).to_numpy().astype(np.uint32), b.column(4).to_numpy()
            every = np.ones(len(word), bool)
            counted = np.stack([weighted_popcounts(word[m], n[m], group[m], len(names), bits) for m in (every, good, toxic)], 1)
            for name, totals in zip(names.tolist(), counted, strict=True):
                held[name] = held[name] + totals if name in held else totals
            if len(held) > PARTS_HELD:
                yield flush()
        yield flush()

    counted = words.select("part", "good", "toxic", "word", "n").mapInArrow(count, "part string, subset int, kept long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def audit(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from the survivors of all subsets.

    Everything follows from the survivors: those of the filters so far less those of one filter more are removed here."""
    full = (1 << len(names)) - 1
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(names[i] for i in order), k + 1, before, 1 << f))
            before |= 1 << f
    columns = [F.lit([s[k] for s in steps]).alias(c) for k, c in enumerate(("filter_order", "step", "before", "bit"))]

    def by_subset(c: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("subset", c))), lambda x: x[c]).alias(c)

    def at(c: str, subset: Column) -> Column:
        return F.element_at(c, subset + 1)

    rows = counts.groupBy("part").agg(*[by_subset(c) for c in ("kept", "good", "toxic")])
    rows = rows.withColumn("s", F.explode(F.arrays_zip(*columns))).select("part", "kept", "good", "toxic", "s.*")
    here = F.col("before").bitwiseOR(F.col("bit"))
    removed = at("kept", F.col("before")) - at("kept", here)
    rows = rows.select(
        "part", "filter_order", "step", "bit", at("kept", here).alias("kept"), removed.alias("removed"),
        (at("kept", F.lit(0)) - at("kept", F.col("bit")) - removed).alias("redundant"),
        (at("kept", full - F.col("bit")) - at("kept", F.lit(full))).alias("unique_fails"),
        *[(at(c, F.col("before")) - at(c, here)).alias(f"{c}_lost") for c in ("good", "toxic")],
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """How five filters overlap, per part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    Null texts count as empty, null parts as the empty string. Texts are read whole. Repeated rows count as often as they stand there;
    rows of one id and one text don't precede each other, so both pass E. Rows without an id pass E and have no label. A document is good
    (toxic) if any label of its id is 1. No documents give no rows. Further columns are ignored, whatever their names."""
    return audit(survivors(survival_words(docs, labels, id_col, text_col, part_col)))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS ws
  FROM documents
), f AS (
  SELECT doc_id, part, (len(ws) < 200)::INT AS a, (100 * len(list_distinct(ws)) < 50 * len(ws))::INT AS b,
    (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e
  FROM d
), l AS (
  SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id
), g AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2
), x AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)
), o AS (
  SELECT x1.name || x2.name || x3.name || x4.name || x5.name AS filter_order, [x1.bit, x2.bit, x3.bit, x4.bit, x5.bit] AS bits
  FROM x x1, x x2, x x3, x x4, x x5 WHERE x1.bit + x2.bit + x3.bit + x4.bit + x5.bit = 31 AND len(list_distinct([x1.bit, x2.bit, x3.bit, x4.bit, x5.bit])) = 5
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, unnest([1, 2, 3, 4, 5]) u(step)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
