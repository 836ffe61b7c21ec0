"""Exact percentiles of large groups: a sketch brackets the rank, rows below are counted, and only the values inside are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..worktable import materialize

#: Percentages beside the wanted one at which the sketch is asked; its own error is a twentieth of that.
NEAR, ACCURACY = 0.002, 10_000
#: Where no group has more rows than this, groups are one task's work each and Spark's own percentile is the shorter way to the same values.
ALONE = 200_000
#: In groups of up to so many values the bracket is the whole range: one rank would be more than half of NEAR.
SMALL = 1_000


def percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], *aggs: Column) -> DataFrame:
    """(keys, aggs, one column a name of ``wanted``): exact percentiles, interpolated between neighbours; null without values.

    ``wanted`` gives (column, share) for each name. Groups are counted first. If one has more than ``ALONE`` rows, no task holds a group: its rows are counted by value inside
    tasks, and a sort sees at most 2 * NEAR of its ranks. Keys of null are a group. A sketch that misses its documented error stops the job instead of giving another value."""
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= ALONE:
        plain = {name: F.percentile(F.col(c).cast("double"), F.lit(share)) for name, (c, share) in wanted.items()}
        return df.groupBy(*keys).agg(*aggs, *[v.alias(name) for name, v in plain.items()])
    columns = sorted({c for c, _ in wanted.values()})
    number = {c: F.col(c).cast("double") for c in columns}
    asked = {c: [q for own, share in wanted.values() if own == c for q in (max(share - NEAR, 0.0), min(share + NEAR, 1.0))] for c in columns}
    sketch = {c: F.percentile_approx(number[c], asked[c], ACCURACY) for c in columns}  # one a column for all its shares
    probes, seen = [], dict.fromkeys(columns, 0)
    for i, (c, _) in enumerate(wanted.values()):
        small, at = F.count(c) <= SMALL, seen[c]
        lo, hi = F.when(small, F.min(number[c])).otherwise(sketch[c][at]), F.when(small, F.max(number[c])).otherwise(sketch[c][at + 1])
        probes += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}"), F.count(c).alias(f"_n{i}")]
        seen[c] += 2
    # Written, so that its size is known: few groups are broadcast to the rows, many are joined by a shuffle.
    base = materialize(df.groupBy(*keys).agg(*aggs, *probes), "percentiles")
    sides = base.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[f"_{p}{i}" for i in range(len(wanted)) for p in ("lo", "hi", "n")])
    x = df.select(*keys, *[v.alias(f"_c{j}") for j, v in enumerate(number.values())])
    same = F.lit(True)
    for j, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    joined, options, below, hits = x.join(sides, same), [], [], F.lit(False)
    for i, (c, share) in enumerate(wanted.values()):
        v, at = F.col(f"_c{columns.index(c)}"), F.when(F.col(f"_n{i}") > 0, F.lit(share) * (F.col(f"_n{i}") - 1))
        hit = (v >= F.col(f"_lo{i}")) & (v <= F.col(f"_hi{i}"))
        hits = hits | hit
        options.append(F.when(hit, F.struct(F.lit(i).alias("i"), v.alias("v"), at.alias("at"))))
        below.append(F.struct(F.lit(i).alias("i"), F.count_if(v < F.col(f"_lo{i}")).alias("_n"), F.max(at).alias("at")))
    inside = joined.filter(hits).select(*keys, F.explode(F.array_compact(F.array(*options))).alias("o"))
    inside = inside.groupBy(*keys, "o.i", "o.v").agg(F.count("*").alias("_n"), F.max("o.at").alias("at"))
    under = joined.groupBy(*keys).agg(F.array(*below).alias("o")).select(*keys, F.explode("o").alias("o")).filter("o.at IS NOT NULL")
    counted = inside.unionByName(under.select(*keys, "o.i", F.lit(None).cast("double").alias("v"), "o._n", "o.at"))
    order = Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("upto", F.sum("_n").over(order))
    low, high = F.floor("at"), F.ceil("at")
    found = placed.groupBy(*keys, "i").agg(
        F.min(F.when(F.col("upto") > low, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > high, F.col("v"))).alias("b"),
        F.max("at").alias("at"), F.max(F.when(F.col("v").isNull(), F.col("upto"))).alias("below"),
    )
    missed = F.col("b").isNull() | (F.coalesce("below", F.lit(0)) > low)
    between = F.when((low == high) | (F.col("a") == F.col("b")), F.col("a")).otherwise((high - F.col("at")) * F.col("a") + (F.col("at") - low) * F.col("b"))
    found = found.withColumn("value", F.when(missed, F.raise_error("the sketch's bracket misses the rank").cast("double")).otherwise(between))
    values = found.groupBy(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)]).agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, name in enumerate(wanted)])
    drop = [f"_{p}{i}" for i in range(len(wanted)) for p in ("lo", "hi", "n")]
    return base.drop(*drop).join(values, same, "left").drop(*[f"_k{j}" for j in range(len(keys))])
