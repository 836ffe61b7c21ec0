"""Queries on group summaries, regions and stacks, with their SQL. Roles as in registry.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import focus, profiles, regions, summaries
from .registry import CELLS, PIXELS, PROFILE, SSCORE, cell_profiles, cell_scores, cells, query, r, table

PLAIN = "SELECT *, regexp_matches(cond, '\\bL0\\b') AS ctl FROM cells"


@query(f"""WITH {CELLS} SELECT run_id, cond, count(*) AS n, round(quantile_cont(length, 0.5), 3) AS length_median, round(quantile_cont(length, 0.75) - quantile_cont(length, 0.25), 3) AS length_iqr,
round(quantile_cont(width, 0.5), 3) AS width_median, round(quantile_cont(area, 0.5), 3) AS area_median, round(avg(area), 3) AS area_mean FROM cells GROUP BY ALL""")
def d3_summary_table(spark, d):
    return profiles.summary_table(cells(spark, d), ["run_id", "cond"], "length", "width", "area").drop("width_mean")


@query("""WITH p AS (SELECT o_orderpriority AS k, quantile_cont(o_totalprice, 0.05) AS p5, quantile_cont(o_totalprice, 0.95) AS p95 FROM orders GROUP BY ALL),
e AS (SELECT log10(greatest(min(p5) / 1.1, 1)) AS lo, log10(greatest(max(p95) * 1.1, 1)) AS hi FROM p), b AS (SELECT o_orderpriority AS k, floor((log10(o_totalprice) - lo) / (hi - lo) * 49) AS bin FROM orders, e),
c AS (SELECT k, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM b WHERE bin BETWEEN 0 AND 48 GROUP BY ALL) SELECT k, bin, round(n / max(n) OVER (PARTITION BY k), 6) AS share FROM c""")
def d5_log_histogram(spark, d):
    return summaries.log_histogram(table(spark, d, "orders").selectExpr("o_orderpriority AS k", "o_totalprice"), "o_totalprice", ["k"]).withColumn("share", r(F.col("share")))


@query(f"""WITH {PROFILE}, n AS (SELECT run_id, cond, count(*) AS n FROM cells GROUP BY ALL), long AS (SELECT p.run_id, p.cond, n, feature, value, regexp_matches(p.cond, '\\bL0\\b') AND p.run_id <> 'run3' AS ctl
FROM (SELECT * FROM prof UNPIVOT (value FOR feature IN (length, area, width))) p JOIN n ON n.run_id = p.run_id AND n.cond = p.cond)
SELECT run_id, cond, feature, round(value - coalesce(avg(value) FILTER (ctl) OVER (PARTITION BY run_id, feature), avg(value) FILTER (ctl) OVER (PARTITION BY feature)), 4) AS value FROM long""")
def d8_anchor(spark, d):
    n = cells(spark, d).groupBy("run_id", "cond").agg(F.count("*").alias("n"))
    p = cell_profiles(spark, d).join(n, ["run_id", "cond"])
    long = profiles.long_form(p, ["run_id", "cond", "n"], ["length", "area", "width"])
    control = L.is_control(F.col("cond"), ["l0"]) & (F.col("run_id") != "run3")
    return summaries.anchor(long, "run_id", "feature", "value", control, "n").select("run_id", "cond", "feature", r(F.col("value"), 4).alias("value"))


@query(f"""WITH {CELLS}, p AS ({PLAIN}), x AS (SELECT *, length - coalesce(avg(length) FILTER (ctl AND run_id <> 'run2') OVER (PARTITION BY run_id), 0) AS l, area - coalesce(avg(area) FILTER (ctl AND run_id <> 'run2') OVER (PARTITION BY run_id), 0) AS a FROM p)
SELECT run_id, cond, round(avg(l), 4) AS length, round(avg(a), 3) AS area FROM x GROUP BY ALL""")
def d8_anchor_cells(spark, d):
    control = L.is_control(F.col("cond"), ["l0"]) & (F.col("run_id") != "run2")
    x = summaries.anchor_cells(cells(spark, d), "run_id", ["length", "area"], control)
    return x.groupBy("run_id", "cond").agg(r(F.avg("length"), 4).alias("length"), r(F.avg("area"), 3).alias("area"))


@query(f"""WITH {CELLS}, p AS ({PLAIN}), k AS (SELECT CASE WHEN ctl THEN run_id || '::' || cond || '_R' || CAST(length AS INTEGER) % 2 ELSE cond END AS merge_key, run_id FROM p WHERE NOT (run_id = 'run1' AND cond LIKE 'R%'))
SELECT merge_key, count(*) AS n, CASE WHEN count(DISTINCT run_id) <= 3 THEN array_to_string(list_sort(list(DISTINCT run_id)), ', ') ELSE count(DISTINCT run_id) || ' runs' END AS runs FROM k GROUP BY ALL""")
def d9_merge_replicates(spark, d):
    c = cells(spark, d).filter("NOT (run_id = 'run1' AND cond LIKE 'R%')").withColumn("rep", F.concat("cond", F.lit("_R"), (F.col("length").cast("int") % 2).cast("string")))
    return summaries.merge_replicates(c, "run_id", "rep", L.is_control(F.col("cond"), ["l0"]))


@query("""SELECT o_orderpriority AS cond, min_by(o_orderstatus, o_orderkey) AS o_orderstatus, min_by(o_custkey, o_orderkey) AS o_custkey, count(*) AS n_cells, bool_or(o_custkey = 7) AS is_current FROM orders GROUP BY ALL""")
def d10_condition_meta(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "cond")
    return summaries.condition_meta(o, ["cond"], "o_orderkey", ["o_orderstatus", "o_custkey"], F.col("o_custkey") == 7)


@query("""WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 3) SELECT p_size, n, CAST(row_number() OVER (ORDER BY p_size) - 1 AS INTEGER) AS idx,
round(least(1.0 / n, 50.0 / n), 6) AS weight, round(1.0 / n / sum(1.0 / n) OVER () * count(*) OVER (), 6) AS balanced FROM c""")
def d12_class_weights(spark, d):
    w = summaries.class_weights(table(spark, d, "part"), "p_size", 3, 50)
    return w.withColumns({"weight": r(F.col("weight")), "balanced": r(F.col("balanced"))})


@query("""WITH m AS (SELECT md5(CAST(doc_id AS VARCHAR) || chr(9) || lang) AS h FROM documents) SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS h1, CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS BIGINT) AS h2 FROM m""")
def d15_fingerprint(spark, d):
    return summaries.fingerprint(table(spark, d, "documents"), ["doc_id", "lang"])


@query("""WITH g AS (SELECT DISTINCT p_brand, p_type, p_size, string_split(p_type, ' ')[1] AS gene FROM part) SELECT gene, count(*) AS n, '' AS family, '' AS pathway FROM g GROUP BY gene""")
def d16_gene_template(spark, d):
    return summaries.gene_template(table(spark, d, "part"), ["p_brand", "p_type", "p_size"], L.gene_of(F.col("p_type")), ["family", "pathway"])


@query("""WITH p AS (SELECT l_shipmode AS metric, l_orderkey AS scene, l_linenumber AS z FROM (SELECT 'm' || (l_suppkey % 3) AS l_shipmode, * FROM lineitem)), m AS (SELECT o_orderkey AS scene, CASE WHEN o_custkey % 9 = 0 THEN -1 ELSE o_custkey % 7 END AS c FROM orders),
s AS (SELECT metric, count(*) AS n, count(*) FILTER (z = c) AS exact, count(*) FILTER (abs(z - c) <= 1) AS within_1, avg(abs(z - c)) AS mae FROM p JOIN m ON p.scene = m.scene AND c >= 0 GROUP BY ALL)
SELECT metric, n, exact, within_1, round(mae, 6) AS mae, CAST(row_number() OVER (ORDER BY exact DESC, mae, metric) AS INTEGER) AS rank FROM s""")
def d17_evaluate_picks(spark, d):
    picks = table(spark, d, "lineitem").selectExpr("concat('m', l_suppkey % 3) AS metric", "l_orderkey AS scene", "l_linenumber AS z")
    manual = table(spark, d, "orders").selectExpr("o_orderkey AS scene", "CASE WHEN o_custkey % 9 = 0 THEN -1 ELSE o_custkey % 7 END AS chosen_z")
    return summaries.evaluate_picks(picks, manual, "scene", "metric").withColumn("mae", r(F.col("mae")))


@query("SELECT l_returnflag AS source, count(*) AS n, count(DISTINCT l_suppkey) AS runs, count(DISTINCT l_partkey) AS conditions, count(DISTINCT l_linenumber) AS genes FROM lineitem GROUP BY ALL")
def d18_coverage(spark, d):
    return summaries.coverage(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "source"), "source", "l_suppkey", "l_partkey", "l_linenumber")


@query("""SELECT l_suppkey AS run, count(DISTINCT l_partkey) FILTER (l_returnflag = 'A') AS "A", count(DISTINCT l_partkey) FILTER (l_returnflag = 'N') AS "N", count(DISTINCT l_partkey) FILTER (l_returnflag = 'Z') AS "Z" FROM lineitem GROUP BY ALL""")
def d18_coverage_matrix(spark, d):
    return summaries.coverage_matrix(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "run"), "l_returnflag", "run", "l_partkey", ["A", "N", "Z"])


REGIONS = f"{PIXELS}, rg AS (SELECT vec_id, y // 4 AS region, v FROM px)"


def pixels(spark, d, image="vec_id"):
    px = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v0"))
    return px.selectExpr(f"{image} AS image", "vec_id div 50 AS z", "label AS grp", "cast(i div 8 AS int) AS y", "cast(i % 8 AS int) AS x", "cast(v0 AS double) + 1 AS value")


@query(f"""WITH {REGIONS}, s AS (SELECT vec_id, region, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, median(v) AS med, stddev_pop(v) AS sd FROM rg GROUP BY ALL)
SELECT s.vec_id AS image, CAST(region AS INTEGER) AS region, round(p90, 5) AS cell_p90, round(p95, 5) AS cell_p95, round(med, 5) AS cell_median, round(sd, 5) AS cell_std,
round(CASE WHEN p90 > 0 THEN 2.0 / p90 ELSE 0 END, 5) AS prominence_p90, round(CASE WHEN med > 0 THEN 2.0 / med ELSE 0 END, 5) AS prominence_median FROM s""")
def d20_region_stats(spark, d):
    px = pixels(spark, d).withColumn("region", (F.col("y") / 4).cast("int"))
    s = summaries.region_stats(px, ["image", "region"], "value")
    spots = px.select("image", "region").distinct().withColumn("intensity", F.lit(2.0))
    p = summaries.prominence(spots, s, ["image", "region"], "intensity").drop("intensity")
    return p.select("image", "region", *[r(F.col(c), 5).alias(c) for c in p.columns if c not in ("image", "region")])


@query(f"""WITH {REGIONS}, c AS (SELECT vec_id % 50 AS image, CAST(region AS INTEGER) AS region, (vec_id // 50) % 2 AS ch, v FROM rg)
SELECT image, region, round(avg(v) FILTER (ch = 0), 5) AS intensity_mean_a, round(max(v) FILTER (ch = 0), 5) AS intensity_max_a, round(median(v) FILTER (ch = 1), 5) AS intensity_median_b, round(quantile_cont(v, 0.95) FILTER (ch = 1), 5) AS intensity_p95_b,
round(sum(v) FILTER (ch = 1), 4) AS intensity_total_b FROM c GROUP BY ALL""")
def d22_region_intensity(spark, d):
    px = pixels(spark, d, "vec_id % 50").selectExpr("image", "cast(y div 4 AS int) AS region", "CASE WHEN z % 2 = 0 THEN 'a' ELSE 'b' END AS channel", "value")
    w = summaries.region_intensity(px, ["image", "region"], "channel", ["a", "b"], "value")
    digits = {"intensity_mean_a": 5, "intensity_max_a": 5, "intensity_median_b": 5, "intensity_p95_b": 5, "intensity_total_b": 4}
    return w.select("image", "region", *[r(F.col(c), n).alias(c) for c, n in digits.items()])


@query(f"""WITH {PIXELS}, l AS (SELECT vec_id, y, x, CASE WHEN v > 1 THEN 1 ELSE 2 END AS label FROM px), m AS (SELECT vec_id, label, count(*) AS n, min(y) AS y0, max(x) + 1 AS x1, avg(y) AS cy, var_pop(y) + 1/12 AS yy, var_pop(x) + 1/12 AS xx, covar_pop(y, x) AS xy FROM l GROUP BY ALL)
SELECT vec_id AS image, label, n AS area_px, CAST(y0 AS INTEGER) AS bbox_y0, CAST(x1 AS INTEGER) AS bbox_x1, round(cy, 5) AS centroid_y, round(n / 100.0, 5) AS area_um2, round(4 * sqrt((yy + xx) / 2 + sqrt(((yy - xx) / 2) ** 2 + xy ** 2)) / 10, 5) AS major_axis_length_um,
round(sqrt(4 * n / pi()) / 10, 5) AS equivalent_diameter_um, round(CASE WHEN abs(yy - xx) < 1e-12 THEN CASE WHEN xy > 0 THEN pi() / 4 ELSE -pi() / 4 END ELSE atan2(2 * xy, yy - xx) / 2 END, 4) AS orientation FROM m""")
def d21_region_geometry(spark, d):
    px = pixels(spark, d).withColumn("label", F.when(F.col("value") > 1, 1).otherwise(2))
    g = summaries.region_geometry(px, ["image", "label"], 10.0)
    return g.select("image", "label", "area_px", "bbox_y0", "bbox_x1", *[r(F.col(c), 5).alias(c) for c in ("centroid_y", "area_um2", "major_axis_length_um", "equivalent_diameter_um")], r(F.col("orientation"), 4).alias("orientation"))


@query("""WITH m AS (SELECT l_returnflag AS k, median(l_quantity) AS m FROM lineitem GROUP BY ALL)
SELECT k, count(*) AS n, round(avg(greatest(l_extendedprice - 2.5 * greatest(l_quantity - m, 0), 0)), 4) AS corrected FROM lineitem JOIN m ON k = l_returnflag GROUP BY ALL""")
def d25_crosstalk_subtract(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_returnflag AS k", "l_quantity", "l_extendedprice")
    c = summaries.crosstalk_subtract(x, ["k"], "l_extendedprice", "l_quantity", 2.5)
    return c.groupBy("k").agg(F.count("*").alias("n"), r(F.avg("corrected"), 4).alias("corrected"))


@query(f"""WITH {CELLS}, g AS (SELECT avg(length) AS ml, stddev_pop(length) AS sl, avg(width) AS mw, stddev_pop(width) AS sw FROM cells)
SELECT run_id, cond, round(avg(greatest(least((length - ml) / sl, 1.2), -1.2)), 5) AS length, round(avg(greatest(least((width - mw) / sw, 1.2), -1.2)), 5) AS width FROM cells, g GROUP BY ALL""")
def d28_zclip(spark, d):
    z = summaries.zclip(cells(spark, d), ["length", "width"], 1.2)
    return z.groupBy("run_id", "cond").agg(r(F.avg("length"), 5).alias("length"), r(F.avg("width"), 5).alias("width"))


@query(f"""WITH {SSCORE}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, cond ORDER BY abs(score) DESC, feature) AS rank FROM scored)
SELECT run_id, cond, feature, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM k WHERE rank <= 2""")
def e10_top_abs(spark, d):
    return summaries.top_abs(cell_scores(spark, d), ["run_id", "cond"], "feature", "score", 2).select("run_id", "cond", "feature", "rank", r(F.col("score"), 4).alias("score"))


LABELLED = f"{PIXELS}, a AS (SELECT vec_id, y, x, CASE WHEN v > 0.9 THEN 1 + y // 4 ELSE 0 END AS label FROM px), b AS (SELECT vec_id, y, x, CASE WHEN v > 1 THEN 1 + (y * 8 + x) // 30 ELSE 0 END AS label FROM px)"


def labelled(spark, d):
    px = pixels(spark, d)
    a = px.selectExpr("image", "y", "x", "CASE WHEN value > 0.9 THEN 1 + y div 4 ELSE 0 END AS label")
    return a, px.selectExpr("image", "y", "x", "CASE WHEN value > 1 THEN 1 + (y * 8 + x) div 30 ELSE 0 END AS label")


@query(f"""WITH {LABELLED}, i AS (SELECT a.vec_id, a.label AS la, b.label AS lb, count(*) AS n FROM a JOIN b ON a.vec_id = b.vec_id AND a.y = b.y AND a.x = b.x WHERE a.label > 0 AND b.label > 0 GROUP BY ALL),
na AS (SELECT vec_id, label, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT vec_id, label, count(*) AS n FROM b GROUP BY ALL), u AS (SELECT i.vec_id, la, lb, i.n / (na.n + nb.n - i.n) AS iou FROM i JOIN na ON na.vec_id = i.vec_id AND na.label = la JOIN nb ON nb.vec_id = i.vec_id AND nb.label = lb),
ra AS (SELECT *, row_number() OVER (PARTITION BY vec_id, la ORDER BY iou DESC, lb) AS r FROM u WHERE iou >= 0.5), rb AS (SELECT *, row_number() OVER (PARTITION BY vec_id, lb ORDER BY iou DESC, la) AS s FROM ra WHERE r = 1)
SELECT vec_id AS image, la, lb, round(iou, 5) AS iou FROM rb WHERE s = 1""")
def c10_match_regions(spark, d):
    p = regions.overlaps(*labelled(spark, d), ["image"])
    return regions.match_regions(p, ["image"]).withColumn("iou", r(F.col("iou"), 5))


@query(f"""WITH {LABELLED}, i AS (SELECT a.vec_id, a.label AS la, b.label AS lb, count(*) AS n FROM a JOIN b ON a.vec_id = b.vec_id AND a.y = b.y AND a.x = b.x WHERE a.label > 0 AND b.label > 0 GROUP BY ALL),
na AS (SELECT vec_id, label, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT vec_id, label, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT vec_id, la FROM i JOIN nb USING (vec_id) WHERE nb.label = lb AND i.n >= 0.5 * nb.n GROUP BY ALL HAVING count(*) > 1), m AS (SELECT vec_id, lb FROM i JOIN na USING (vec_id) WHERE na.label = la AND i.n >= 0.5 * na.n GROUP BY ALL HAVING count(*) > 1),
t AS (SELECT vec_id, 1 AS s, 0 AS m FROM s UNION ALL SELECT vec_id, 0, 1 FROM m) SELECT vec_id AS image, CAST(sum(s) AS BIGINT) AS splits, CAST(sum(m) AS BIGINT) AS merges FROM t GROUP BY ALL""")
def c10_splits_merges(spark, d):
    return regions.splits_merges(regions.overlaps(*labelled(spark, d), ["image"]), ["image"])


@query(f"""WITH {LABELLED}, p AS (SELECT vec_id, (vec_id % 21) * 0.5 AS y, (vec_id % 13) * 0.75 AS x FROM embeddings)
SELECT p.vec_id AS image, coalesce(a.label, 0) AS label FROM p LEFT JOIN a ON a.vec_id = p.vec_id AND a.y = round_even(p.y, 0) AND a.x = round_even(p.x, 0)""")
def c13_label_at(spark, d):
    points = table(spark, d, "embeddings").selectExpr("vec_id AS image", "(vec_id % 21) * 0.5D AS y", "(vec_id % 13) * 0.75D AS x")
    return regions.label_at(points, labelled(spark, d)[0], ["image"]).select("image", "label")


STACK = "g AS (SELECT vec_id, vec_id % 50 AS image, vec_id // 50 AS z, (i // 8)::INT AS y, (i % 8)::INT AS x, embedding[i + 1]::DOUBLE + 1 AS v FROM embeddings, range(64) t(i))"
GRAD = f"""{STACK}, g1 AS (SELECT *, coalesce(lead(v) OVER c, v) AS yn, coalesce(lag(v) OVER c, v) AS yp, coalesce(lead(v) OVER r, v) AS xn, coalesce(lag(v) OVER r, v) AS xp FROM g WINDOW c AS (PARTITION BY vec_id, x ORDER BY y), r AS (PARTITION BY vec_id, y ORDER BY x)),
g2 AS (SELECT *, yn + yp + xn + xp - 4 * v AS lap, yn - yp AS dy, xn - xp AS dx FROM g1),
g3 AS (SELECT *, coalesce(lead(dy) OVER r, dy) + 2 * dy + coalesce(lag(dy) OVER r, dy) AS gy, coalesce(lead(dx) OVER c, dx) + 2 * dx + coalesce(lag(dx) OVER c, dx) AS gx FROM g2 WINDOW c AS (PARTITION BY vec_id, x ORDER BY y), r AS (PARTITION BY vec_id, y ORDER BY x))"""


@query(f"""WITH {GRAD} SELECT vec_id AS image, round(var_pop(lap), 4) AS laplacian_variance, round(sum(gx * gx + gy * gy), 3) AS tenengrad, round(avg(gx * gx + gy * gy), 4) AS tenengrad_mean, round(var_pop(v) / (avg(v) ** 2 + 1e-9), 5) AS relative_variance FROM g3 GROUP BY ALL""")
def h5_sharpness(spark, d):
    s = focus.sharpness(pixels(spark, d), ["image"])
    return s.select("image", r(F.col("laplacian_variance"), 4).alias("laplacian_variance"), r(F.col("tenengrad"), 3).alias("tenengrad"), r(F.col("tenengrad_mean"), 4).alias("tenengrad_mean"), r(F.col("relative_variance"), 5).alias("relative_variance"))


def stack_scores(spark, d):
    """Sharpness of each slice of 50 stacks."""
    return focus.sharpness(pixels(spark, d, "vec_id % 50"), ["image", "z"]).select("image", "z", "laplacian_variance", "tenengrad")


SCORES = f"{GRAD}, sc AS (SELECT image, z, var_pop(lap) AS lv, sum(gx * gx + gy * gy) AS tg FROM g3 GROUP BY ALL)"


@query(f"""WITH {SCORES}, m AS (SELECT *, max(lv) OVER (PARTITION BY image) AS best, (count(*) OVER (PARTITION BY image) - 1) / 2 AS mid FROM sc) SELECT image, min_by(z, (abs(z - mid), z)) AS z FROM m WHERE lv >= best - 1e-12 GROUP BY image""")
def e18_pick_slice(spark, d):
    return focus.pick_slice(stack_scores(spark, d), ["image"], "laplacian_variance")


@query(f"""WITH {SCORES}, w AS (SELECT image, z, CASE WHEN count(*) OVER (PARTITION BY image) < 3 THEN lv ELSE (coalesce(lag(lv) OVER o, lv) + 2 * lv + coalesce(lead(lv) OVER o, lv)) / 4 END AS lv, CASE WHEN count(*) OVER (PARTITION BY image) < 3 THEN tg ELSE (coalesce(lag(tg) OVER o, tg) + 2 * tg + coalesce(lead(tg) OVER o, tg)) / 4 END AS tg
FROM sc WINDOW o AS (PARTITION BY image ORDER BY z)), e AS (SELECT *, max(lv) OVER s - min(lv) OVER s AS dl, max(tg) OVER s - min(tg) OVER s AS dt, min(lv) OVER s AS ml, min(tg) OVER s AS mt FROM w WINDOW s AS (PARTITION BY image))
SELECT image, z, round((CASE WHEN dl < 1e-12 THEN 0 ELSE (lv - ml) / dl END + CASE WHEN dt < 1e-12 THEN 0 ELSE (tg - mt) / dt END) / 2, 5) AS ensemble FROM e""")
def e19_ensemble(spark, d):
    both = ["laplacian_variance", "tenengrad"]
    e = focus.ensemble(focus.smooth_z(stack_scores(spark, d), ["image"], both), ["image"], both)
    return e.select("image", "z", r(F.col("ensemble"), 5).alias("ensemble"))


@query(f"""WITH {STACK}, t AS (SELECT image, z, least(y // 3, 1) AS tile_y, least(x // 4, 1) AS tile_x, var_pop(v) / avg(v) AS s FROM g GROUP BY ALL), p AS (SELECT image, tile_y, tile_x, max_by(z, s) AS z FROM t GROUP BY ALL)
SELECT image, y, x, round(v, 5) AS value FROM g SEMI JOIN p ON p.image = g.image AND p.z = g.z AND p.tile_y = least(y // 3, 1) AND p.tile_x = least(x // 4, 1)""")
def h9_tiles(spark, d):
    px = focus.tile_id(pixels(spark, d, "vec_id % 50"), 2, 2, 7, 8)
    score = px.groupBy("image", "tile_y", "tile_x", "z").agg((F.var_pop("value") / F.avg("value")).alias("s"))
    picks = focus.pick_slice(score, ["image", "tile_y", "tile_x"], "s")
    return focus.stitch(px, picks, ["image", "tile_y", "tile_x"]).select("image", "y", "x", r(F.col("value"), 5).alias("value"))


@query(f"WITH {GRAD} SELECT image, y, x, max_by(z, (round(abs(lap), 9), -z)) AS z FROM g2 GROUP BY ALL")
def h10_best_z_per_pixel(spark, d):
    return focus.best_z_per_pixel(pixels(spark, d, "vec_id % 50"), ["image"])


@query(f"""WITH {STACK}, k AS (SELECT a.vec_id, a.y, a.x, a.v, max(b.v) AS m FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.v > 1 GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, y, x) AS rn FROM k WHERE v = m) SELECT vec_id AS image, y, x, round(v, 5) AS value FROM q WHERE rn <= 3""")
def h16_local_peaks(spark, d):
    return focus.local_peaks(pixels(spark, d).select("image", "y", "x", "value"), ["image"], 1, 1.0, 3).withColumn("value", r(F.col("value"), 5))
