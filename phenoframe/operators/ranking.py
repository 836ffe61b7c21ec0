"""Rankings, curves and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are dealt into so many ranges; running counts go over the ranges first and then inside each.
RANGES = 128


SCOPES = ("all", "cross_gene", "replicate")


def rank_metrics(pairs: DataFrame, distance: str, groups: DataFrame, k: int, scope: str = "all") -> DataFrame:
    """Per profile: ap (mean precision at hits) and knn (share of hits among the k nearest candidates); profiles without a positive are left out.

    ``groups``: (id, grp), and for the other scopes key, the profile's gene. Scope ``all``: positives share the group. ``cross_gene``: profiles of the own key are no
    candidates, so positives are of other keys of the group. ``replicate``: positives share the key. Keys count trimmed and in any case. Rows without a
    group are dropped, as are groups of one row (of one key under ``cross_gene``)."""
    if scope not in SCOPES:
        raise ValueError(f"scope is one of {SCOPES}")
    key = F.lower(F.trim(F.col("key").cast("string"))) if scope != "all" else F.col("id").cast("string")
    keyed = groups.select("id", "grp", key.alias("key")).filter("grp IS NOT NULL")
    enough = F.countDistinct("key") if scope == "cross_gene" else F.count("*")
    counted = keyed.groupBy("grp").agg(enough.alias("_n")).filter("_n > 1").select("grp")
    g = keyed.join(counted, "grp", "left_semi")
    both = pairs.select("i", "j", distance).union(pairs.select("j", "i", distance))
    x = both.join(g.selectExpr("id AS i", "grp AS gi", "key AS ki"), "i").join(g.selectExpr("id AS j", "grp AS gj", "key AS kj"), "j")
    if scope == "cross_gene":
        x = x.filter("NOT ki <=> kj")
    hit = F.col("ki") == F.col("kj") if scope == "replicate" else F.col("gi") == F.col("gj")
    w = Window.partitionBy("i").orderBy(distance, "j")
    x = x.withColumn("hit", F.coalesce(hit, F.lit(False)).cast("int")).withColumn("rank", F.row_number().over(w))
    x = x.withColumn("hits", F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.groupBy(F.col("i").alias("id")).agg(
        F.avg(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("ap"), F.avg(F.when(F.col("rank") <= k, F.col("hit"))).alias("knn")
    ).filter("ap IS NOT NULL")


def benjamini_hochberg(df: DataFrame, p: str, family: list[str]) -> DataFrame:
    """Adds q = min over larger or equal p of p * n / rank, at most 1, within each family of tests, and ``significant`` (q <= 0.05).

    Equal p have one q, that of their last rank, so p are counted before they are sorted; ranges of a family's distinct p are sorted by a task each, and what
    goes on from range to range is a row a range. Without ``family`` all rows are one. Tests without p are not counted and have no q."""
    whole = F.to_json(F.struct(*family), {"ignoreNullFields": "false"}) if family else F.lit("")
    x = df.withColumn("_family", whole)
    by = x.filter(F.col(p).isNotNull()).groupBy("_family", F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_k"))
    edges = by.groupBy("_family").agg(F.percentile_approx("_p", [k / RANGES for k in range(1, RANGES)], 100 * RANGES).alias("_edges"))
    by = by.join(edges, "_family").withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("_p")))).drop("_edges")
    every = Window.partitionBy("_family")  # over ranges, RANGES a family
    before = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = by.groupBy("_family", "_range").agg(F.sum("_k").alias("_m"))
    sizes = sizes.select("_family", "_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(every).alias("_n"))
    inside = Window.partitionBy("_family", "_range").orderBy("_p")
    rank = F.col("_before") + F.sum("_k").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    raw = by.join(sizes, ["_family", "_range"]).withColumn("_raw", F.col("_p") * F.col("_n") / rank)
    after = every.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    least = raw.groupBy("_family", "_range").agg(F.min("_raw").alias("_least")).select("_family", "_range", F.min("_least").over(after).alias("_later"))
    here = F.min("_raw").over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    q = raw.join(least, ["_family", "_range"]).select("_family", "_p", F.least(F.lit(1.0), here, "_later").alias("q"))
    out = x.withColumn("_p", F.col(p).cast("double")).join(q, ["_family", "_p"], "left").drop("_family", "_p")
    return out.withColumn("significant", F.col("q") <= 0.05)


def roc_curve(df: DataFrame, y: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, score, p, n, all_p, all_n, tp, fp) at each distinct score, counting rows at or above it, and at +inf, where the curve starts with none.

    Scores are counted before they are sorted, and dealt into ranges of about as many distinct scores each, so no task sees all scores of a key,
    however they crowd."""
    keys = keys or []
    own, s = [*keys, "_all"], F.col(score).cast("double")
    by = df.filter(s.isNotNull()).groupBy(*keys, s.alias("score")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n")).withColumn("_all", F.lit(1))
    edges = by.groupBy(*own).agg(F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 100 * RANGES).alias("_edges"))
    by = by.join(edges, own).withColumn("range", F.size(F.filter("_edges", lambda e: e < F.col("score")))).drop("_edges")
    start = by.groupBy(*own).agg(F.max("range").alias("range")).select(*keys, F.lit(float("inf")).alias("score"), *[F.lit(0).cast("long").alias(c) for c in ("p", "n")], "_all", (F.col("range") + 1).alias("range"))
    by = by.unionByName(start)
    every = Window.partitionBy(*own)  # over the ranges, RANGES + 1 rows a key
    above = every.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    base = by.groupBy(*own, "range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn")).select(
        *own, "range", F.sum("rp").over(every).alias("all_p"), F.sum("rn").over(every).alias("all_n"), F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn")
    )
    inside = Window.partitionBy(*own, "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = by.join(base, [*own, "range"])
    return at.select(*keys, "score", "p", "n", "all_p", "all_n", (F.col("bp") + F.sum("p").over(inside)).alias("tp"), (F.col("bn") + F.sum("n").over(inside)).alias("fp"))


def auc(df: DataFrame, y: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """One row, or one a key: auc, average_precision, prevalence, youden (the largest score at which tpr - fpr is largest; +inf where none is above 0).

    Null where a class is missing, but for the prevalence."""
    c = roc_curve(df, y, score, keys)
    area = F.try_divide(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)), F.max(F.col("all_p") * F.col("all_n")))
    ap = F.try_divide(F.sum(F.coalesce(F.try_divide(F.col("p") * F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))), F.max("all_p"))
    gain = F.col("tp") * F.col("all_n") - F.col("fp") * F.col("all_p")
    best = F.max_by("score", F.struct(gain.alias("j"), "score"))
    share = F.try_divide(F.max("all_p"), F.max(F.col("all_p") + F.col("all_n")))
    return c.groupBy(*(keys or [])).agg(area.alias("auc"), ap.alias("average_precision"), share.alias("prevalence"), best.alias("youden"))


def draw_key(seed: int, key: Column) -> Column:
    """A seeded order that does not depend on partitions: md5 of "seed:key"."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def build_pool(
    df: DataFrame, key: str, mode: str, n: int, seed: int, score: str | None = None, exclude: DataFrame | None = None, threshold: float | None = None,
) -> DataFrame:
    """n candidates: at random, the most uncertain (least confident class first) or the best; ties keep the seeded order.

    ``exclude`` are keys seen already. Under uncertain, ``threshold`` leaves out rows of which the model is at least so sure."""
    if exclude is not None:
        df = df.join(exclude.select(key), key, "left_anti")
    sure = F.greatest(F.col(score), 1 - F.col(score)) if score else None
    if mode == "uncertain" and threshold is not None:
        df = df.filter(sure < threshold)
    order = {"random": [], "uncertain": [sure.asc()] if score else [], "good": [F.desc(score)] if score else []}[mode]
    return df.orderBy(*order, draw_key(seed, F.col(key)), key).limit(n)


def pool_counts(df: DataFrame, key: str, exclude: DataFrame | None = None) -> DataFrame:
    """One row: n_matching rows of the filtered table and n_candidates that were not seen yet."""
    if exclude is None:
        return df.agg(F.count("*").alias("n_matching"), F.count("*").alias("n_candidates"))
    seen = exclude.select(key).distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, key, "left").agg(F.count("*").alias("n_matching"), F.count_if(F.col("_seen").isNull()).alias("n_candidates"))


def stratified_cap(df: DataFrame, group: str, key: str, most: int, seed: int) -> DataFrame:
    """All rows if there are ``most`` or fewer; else of each group max(1, most // groups) rows by the seeded order. Rows whose group is null are left out then."""
    size = df.agg(F.count("*").alias("n"), F.countDistinct(group).alias("groups")).first()
    if size["n"] <= most:
        return df
    return cap_sample(df, group, key, max(1, most // max(1, size["groups"])), 1, seed)


def seeded_rank(df: DataFrame, groups: list[str], key: str, seed: int, most: int | None = None) -> DataFrame:
    """Adds ``_rank`` (from 1) and ``_size`` within each group, in the seeded order.

    Ranks are counted inside 4,096 ranges of the order and then shifted by the sizes of the ranges before, so a group that
    holds a third of all rows is still sorted by many tasks. With ``most``, ranges that begin behind that rank are left out before anything is
    sorted. Rows whose group is null are left out."""
    x = df.withColumn("_draw", draw_key(seed, F.col(key))).withColumn("_slot", F.substring("_draw", 1, 3))
    whole = Window.partitionBy(*groups)  # over ranges, 4,096 a group at most
    before = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = x.groupBy(*groups, "_slot").agg(F.count("*").alias("_n"))
    slots = slots.select(*groups, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_size"))
    slots = slots.filter(F.col("_before") < most) if most is not None else slots
    inside = Window.partitionBy(*groups, "_slot").orderBy("_draw", key)
    return x.join(slots, [*groups, "_slot"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside)).drop("_draw", "_slot", "_before")


def cap_sample(df: DataFrame, group: str, key: str, n: int, least: int, seed: int) -> DataFrame:
    """At most n rows of each group by the seeded order; groups of fewer than ``least`` rows are left out. Exact, whatever the sizes (``seeded_rank``)."""
    return seeded_rank(df, [group], key, seed, n).filter((F.col("_rank") <= n) & (F.col("_size") >= least)).drop("_rank", "_size").select(df.columns)


def review_sample(scenes: DataFrame, file: str, scene: str, n: int, seed: int, ids: list[int] | None = None) -> DataFrame:
    """(file, scene): ``n`` scenes of each file by the seeded order (all if it has fewer), or those of ``ids``; a file that lacks one of these is an error, and so
    is a table without scenes."""
    own = scenes.select(file, scene).distinct()
    if ids is None:
        keyed = own.withColumn("_key", F.concat_ws(":", F.col(file).cast("string"), F.col(scene).cast("string")))
        sample = cap_sample(keyed, file, "_key", n, 1, seed).select(file, scene)
        if own.isEmpty():
            raise ValueError("no scenes")
        return sample
    wanted = sorted(set(ids))
    missing = F.array_except(F.lit(wanted), F.collect_set(F.when(F.col(scene).isin(wanted), F.col(scene).cast("int"))))
    short = own.groupBy(file).agg(missing.alias("missing")).filter(F.size("missing") > 0).limit(1).collect()
    if short or own.isEmpty():
        raise ValueError(f"requested scenes not present in {short[0][file]}: {short[0]['missing']}" if short else "no scenes")
    return own.filter(F.col(scene).isin(wanted))


def top_spread(scores: DataFrame, feature: str, value: str, control: Column, n: int) -> DataFrame:
    """The n features with the largest spread over the profiles that aren't controls, with the controls' range beside it."""
    v, c = F.when(~control, F.col(value)), F.when(control, F.col(value))
    out = scores.groupBy(feature).agg((F.max(v) - F.min(v)).alias("spread"), F.min(c).alias("control_min"), F.max(c).alias("control_max"))
    return out.orderBy(F.desc("spread"), feature).limit(n)
