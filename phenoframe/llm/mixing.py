"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..worktable import materialize

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents of a source are dealt by a seeded hash into so many slots; only one slot is ever ordered.
SLOTS = 1 << 12
#: The table of sources is broadcast up to this many sources and shuffled beyond.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def targets(sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Target words per source, from one row (source, source_size) per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Water-filling in closed form: sources are
    clamped in the order of cap / weight; with the first j clamped, the rest share what is left by weight; the right j is the
    first at which the next source is not above its cap. The windows run over the sources, not the documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.select(
        "source", "source_size",
        ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double").alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
    ).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("clamped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("clamped")) / (F.sum("weight").over(every) - F.col("used")))
    )
    # The level with the sources before this one clamped holds if it doesn't lift this one above its cap.
    w = w.withColumn("fits", F.col("level") <= F.col("ratio"))
    w = w.withColumn("place", F.row_number().over(fill))
    w = w.withColumn("share", F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(every)["level"])
    target = F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight")))
    return w.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    max_epochs: float = 3.0, seed: int = 13, key_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    A source with target T and size S repeats all documents floor(T / S) times. Of the fraction that is left,
    documents are taken in seeded order until it is filled, the last of them in part. No document
    exceeds ``max_epochs`` times its size. Null texts have size 0; null sources are one source; sizes of 0
    only give target 0. Equal ids within a source are ordered by size. Reruns agree, whatever the partitioning. ``key_col`` is a
    column that goes along and tells rows of equal ids apart; it has no part in the seeded order but behind id and size."""
    more = [key_col] if key_col else []
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            key.alias("key"), F.pmod(F.shiftright(key, 20), F.lit(SLOTS)).cast("int").alias("slot"), *more,
        ),
        "mix-sizes",
    )
    per_slot = materialize(sized.groupBy("source", "slot").agg(F.sum("size").alias("n")), "mix-slots")
    totals = per_slot.groupBy("source").agg(F.sum("n").alias("source_size"))
    goal = targets(totals, max_epochs).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"),
    )
    goal = goal.withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long"))
    # The slot in which the rest of a source is used up.
    running = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = per_slot.withColumn("upto", F.sum("n").over(running))
    g, s = goal.alias("g"), slots.alias("s")
    cut = (
        s.join(g, F.expr("s.source <=> g.source AND s.upto >= g.rest"))
        .groupBy("g.source").agg(F.min_by(F.struct("slot", (F.col("upto") - F.col("n")).alias("before")), "slot").alias("c"))
        .select(F.col("source").alias("cut_source"), F.col("c.slot").alias("cut_slot"), F.col("c.before").alias("before"))
    )
    goal = materialize(goal.join(cut, F.expr("source <=> cut_source"), "left").drop("cut_source"), "mix-goals")
    n_sources = goal.count()
    side = goal.withColumnRenamed("source", "goal_source")
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side
    d = sized.join(side, F.expr("source <=> goal_source")).drop("goal_source")
    outside = d.filter("cut_slot IS NULL OR slot <> cut_slot").withColumn(
        "part", F.when(F.col("slot") < F.col("cut_slot"), F.col("size")).otherwise(F.lit(0))
    )
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = d.filter("slot = cut_slot").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - filled)))
    both = outside.unionByName(inside)
    return both.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), *more
    )
