"""Queries on bleed, outlines, spots, components, stored jobs and results, with their SQL. Roles as in registry.py."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import provenance
from ..operators import components, digests, evaluation, filters, focus, joins, layout, models, outlines, profiles, ranking, regions, robust, spots, transport_job
from ..operators import pixels as px_metrics
from ..sources import results, tables
from ..streaming import intake
from ..worktable import new_path
from .layouts import WELLS, wells
from .library import distances
from .measures import points
from .registry import PIXELS, RANKED, query, r, table
from .summaries import GRAD, LABELLED, labelled, pixels

BLEED = """s AS (SELECT o_orderpriority AS well, CASE WHEN o_orderpriority LIKE '5%' AND o_orderkey > 60 THEN -o_totalprice ELSE o_totalprice END AS src,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderpriority LIKE '1%' THEN 0.6 ELSE 0.03 END * CASE WHEN o_orderpriority LIKE '2%' THEN -o_totalprice ELSE o_totalprice END + o_custkey * 7 % 500 AS tgt FROM orders)"""


@query(f"""WITH {BLEED}, u AS (SELECT * FROM s WHERE tgt IS NOT NULL AND src > 0), n AS (SELECT well, count(*) FILTER (tgt IS NOT NULL AND src > 0) AS n_sites FROM s GROUP BY well),
f AS (SELECT u.* FROM u JOIN n USING (well) WHERE n_sites >= 20), m AS (SELECT a.well, median((b.tgt - a.tgt) / (b.src - a.src)) AS slope FROM f a JOIN f b ON a.well = b.well AND b.src > a.src GROUP BY a.well),
k AS (SELECT well, rank() OVER x + (count(*) OVER (PARTITION BY well, src) - 1) / 2 AS rx, rank() OVER y + (count(*) OVER (PARTITION BY well, tgt) - 1) / 2 AS ry FROM f WINDOW x AS (PARTITION BY well ORDER BY src), y AS (PARTITION BY well ORDER BY tgt)),
c AS (SELECT well, corr(rx, ry) AS rho FROM k GROUP BY well)
SELECT n.well, n_sites, round(rho, 6) AS rho, round(slope, 8) AS fitted_slope, CASE WHEN n_sites < 20 THEN 'insufficient-sites' WHEN slope > 0.25 THEN 'implausible-slope' ELSE 'auto' END AS mode,
CASE WHEN n_sites < 20 OR slope > 0.25 OR slope < 0 THEN 0 ELSE round(slope, 8) END AS k FROM n LEFT JOIN m USING (well) LEFT JOIN c USING (well)""")
def d24_crosstalk_k(spark, d):
    p, mine = F.col("o_orderpriority"), F.col("o_totalprice")
    src = F.when(p.startswith("5") & (F.col("o_orderkey") > 60), -mine).otherwise(mine)
    k = F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("double")).when(p.startswith("1"), 0.6).otherwise(0.03)
    tgt = k * F.when(p.startswith("2"), -mine).otherwise(mine) + F.col("o_custkey") * 7 % 500
    fit = robust.crosstalk_k(table(spark, d, "orders").select(p.alias("well"), src.alias("src"), tgt.alias("tgt")), ["well"], "src", "tgt")
    return fit.select("well", "n_sites", r(F.col("rho")).alias("rho"), r(F.col("fitted_slope"), 8).alias("fitted_slope"), "mode", r(F.col("k"), 8).alias("k"))


OUTLINE = """v AS (SELECT l_suppkey AS cell, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS m, l_quantity AS y, l_discount * 1000 AS x FROM lineitem WINDOW o AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)),
n AS (SELECT *, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yn, coalesce(lead(x) OVER w, first_value(x) OVER w) AS xn FROM v WHERE m >= 4 WINDOW w AS (PARTITION BY cell ORDER BY i)),
c AS (SELECT *, sqrt((yn - y) * (yn - y) + (xn - x) * (xn - x)) AS len FROM n),
g AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY cell ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, sum(len) OVER (PARTITION BY cell) AS total FROM c)"""


@query(f"""WITH {OUTLINE}, t AS (SELECT cell, k, k * any_value(total) / 100 AS pos FROM g, range(100) u(k) WHERE total > 0 GROUP BY cell, k),
s AS (SELECT t.cell, k, pos, max_by({{'y': y, 'x': x, 'yn': yn, 'xn': xn, 'cum': cum, 'len': len}}, cum) AS s FROM t JOIN g ON t.cell = g.cell AND g.cum <= t.pos AND g.len > 0 GROUP BY ALL)
SELECT cell, k::INT AS k, round(s.y + (pos - s.cum) / s.len * (s.yn - s.y), 5) AS y, round(s.x + (pos - s.cum) / s.len * (s.xn - s.x), 5) AS x FROM s""")
def e23_resample_closed(spark, d):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), (F.row_number().over(order) - 1).alias("i"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 1000).alias("x"))
    out = outlines.resample_closed(v, ["cell"], "i", "y", "x")
    return out.select("cell", "k", r(F.col("y"), 5).alias("y"), r(F.col("x"), 5).alias("x"))


@query("""WITH w AS (SELECT l_orderkey AS cell, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS m, l_quantity AS v, lead(l_quantity) OVER o AS n FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice)),
d AS (SELECT cell, m, k, v + (CASE WHEN m > 1 THEN k * (m - 1) / 199.0 - i ELSE 0 END) * (coalesce(n, v) - v) AS v FROM w, range(200) u(k) WHERE CASE WHEN m = 1 THEN k = 0 ELSE k * (m - 1) // 199 = i END)
SELECT cell, round(median(v), 5) AS width_median, round(avg(v), 5) AS width_mean, round(max(v), 5) AS width_max, round(min(v), 5) AS width_min, round(stddev_pop(v), 5) AS width_std,
round(least(arg_max(k, (v, -k)) / 199.0, 1 - arg_max(k, (v, -k)) / 199.0), 5) AS width_pos_max, round(least(arg_min(k, (v, k)) / 199.0, 1 - arg_min(k, (v, k)) / 199.0), 5) AS width_pos_min,
CASE WHEN max(m) > 1 THEN round(avg(v) FILTER (k < 20 OR k >= 180), 5) END AS pole_width, CASE WHEN max(m) > 1 THEN round(avg(v) FILTER (k < 20 OR k >= 180) / avg(v) FILTER (k BETWEEN 80 AND 119), 5) END AS pole_taper FROM d GROUP BY cell""")
def e24_width_profile(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), (F.row_number().over(order) - 1).alias("i"), F.col("l_quantity").alias("w"))
    p = outlines.width_profile(s, ["cell"], "i", "w")
    return p.select("cell", *[r(F.col(c), 5).alias(c) for c in p.columns[1:]])


def _atrous_sql(scales: int) -> str:
    """One pair of queries a scale: an image smoothed down, then across, mirrored at its borders of eight pixels."""
    parts = ["k AS (SELECT * FROM (VALUES (-2, 0.0625), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625)) k(o, w))"]
    for n in range(scales):
        def fold(c, n=n):
            at = f"((p.{c} + k.o * {2**n}) % 16 + 16) % 16"
            return f"CASE WHEN {at} < 8 THEN {at} ELSE 15 - {at} END"

        parts.append(f"h{n} AS (SELECT p.vec_id, p.y, p.x, sum(w * q.v) AS v FROM s{n} p, k JOIN s{n} q ON q.vec_id = p.vec_id AND q.x = p.x AND q.y = {fold('y')} GROUP BY ALL)")
        parts.append(f"s{n + 1} AS (SELECT p.vec_id, p.y, p.x, sum(w * q.v) AS v FROM h{n} p, k JOIN h{n} q ON q.vec_id = p.vec_id AND q.y = p.y AND q.x = {fold('x')} GROUP BY ALL)")
    return ", ".join(parts)


@query(f"""WITH {PIXELS}, pc AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.999) AS hi FROM px GROUP BY ALL), s0 AS (SELECT vec_id, y, x, greatest(0, least(1, (v - lo) / (hi - lo))) AS v FROM px JOIN pc USING (vec_id)), {_atrous_sql(3)},
pl AS (SELECT vec_id, y, x, 0 AS s, s0.v - s1.v AS p FROM s0 JOIN s1 USING (vec_id, y, x) UNION ALL SELECT vec_id, y, x, 1, s1.v - s2.v FROM s1 JOIN s2 USING (vec_id, y, x) UNION ALL SELECT vec_id, y, x, 2, s2.v - s3.v FROM s2 JOIN s3 USING (vec_id, y, x)),
m AS (SELECT vec_id, s, median(p) AS m FROM pl GROUP BY ALL), d AS (SELECT vec_id, s, 1.4826 * median(abs(p - m)) AS sd FROM pl JOIN m USING (vec_id, s) GROUP BY ALL)
SELECT vec_id AS image, y::INT AS y, x::INT AS x, round(sum(CASE WHEN p > 1.5 * sd THEN p ELSE 0 END), 6) AS response FROM pl JOIN d USING (vec_id, s) GROUP BY ALL""")
def h12_atrous_response(spark, d):
    out = spots.atrous_response(pixels(spark, d).select("image", "y", "x", "value"), ["image"], (0, 1, 2), 1.5)
    return out.select("image", "y", "x", r(F.col("response")).alias("response"))


@query(f"""WITH {PIXELS}, st AS (SELECT vec_id, 2 + vec_id % 5 AS sy, 1 + vec_id % 6 AS sx FROM embeddings), p AS (SELECT px.vec_id, y, x, sy, sx, v FROM px JOIN st ON st.vec_id = px.vec_id AND abs(y - sy) <= 2 AND abs(x - sx) <= 2),
e AS (SELECT *, lag(v) OVER d AS u, lead(v) OVER d AS b, lag(v) OVER a AS l, lead(v) OVER a AS r FROM p WINDOW d AS (PARTITION BY vec_id, x ORDER BY y), a AS (PARTITION BY vec_id, y ORDER BY x)),
g AS (SELECT *, CASE WHEN u IS NULL THEN b - v WHEN b IS NULL THEN v - u ELSE (b - u) / 2 END AS gy, CASE WHEN l IS NULL THEN r - v WHEN r IS NULL THEN v - l ELSE (r - l) / 2 END AS gx FROM e),
m AS (SELECT *, gx * gx + gy * gy AS m2 FROM g), z AS (SELECT vec_id, max(m2) AS top, sum(m2 * y) / sum(m2) AS cy, sum(m2 * x) / sum(m2) AS cx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM m GROUP BY ALL),
w AS (SELECT m.*, m2 / (sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) + 1) AS w, gx / sqrt(m2) AS a, gy / sqrt(m2) AS c FROM m JOIN z USING (vec_id) WHERE m2 > 0.0001 * top),
q AS (SELECT vec_id, sum(w * (1 - a * a)) AS uu, sum(w * (1 - c * c)) AS vv, sum(-w * a * c) AS uv, sum(w * (1 - a * a) * x - w * a * c * y) AS b1, sum(-w * a * c * x + w * (1 - c * c) * y) AS b2, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT z.*, CASE WHEN n >= 4 AND abs(uu * vv - uv * uv) >= 1e-12 THEN (uu * b2 - uv * b1) / (uu * vv - uv * uv) END AS fy, CASE WHEN n >= 4 AND abs(uu * vv - uv * uv) >= 1e-12 THEN (vv * b1 - uv * b2) / (uu * vv - uv * uv) END AS fx FROM q JOIN z USING (vec_id)),
bg AS (SELECT vec_id, median(v) AS bg FROM p JOIN z USING (vec_id) WHERE y IN (y0, y1) OR x IN (x0, x1) GROUP BY ALL)
SELECT p.vec_id AS image, round(any_value(fy), 4) AS y, round(any_value(fx), 4) AS x, round(sqrt(greatest(sum(greatest(v - bg, 0) * ((p.y - coalesce(fy, sy)) ** 2 + (p.x - coalesce(fx, sx)) ** 2)) / sum(greatest(v - bg, 0)) / 2, 1e-12)), 4) AS sigma
FROM p JOIN f USING (vec_id) JOIN bg USING (vec_id) GROUP BY p.vec_id""")
def h22_radial_centres(spark, d):
    c = spots.radial_centres(pixels(spark, d), points(spark, d), ["image"], 2)
    return c.select("image", *[r(F.col(k), 4).alias(k) for k in ("y", "x", "sigma")])


REGION = "CASE WHEN y = 7 THEN 0 WHEN (x + y) % 8 < 4 THEN 1 ELSE 2 END"


@query(f"""WITH {PIXELS}, l AS (SELECT vec_id, y, x, v, {REGION} AS region FROM px), s AS (SELECT vec_id, region, median(v) AS m, stddev_pop(v) AS sd FROM l WHERE region > 0 GROUP BY ALL)
SELECT a.vec_id AS image, a.region, a.y::INT AS y, a.x::INT AS x, round(a.v - m, 6) AS amplitude FROM l a JOIN s ON s.vec_id = a.vec_id AND s.region = a.region
WHERE sd >= 1e-9 AND a.v - m > 0.8 * sd AND NOT EXISTS (SELECT 1 FROM l b WHERE b.vec_id = a.vec_id AND b.region = a.region AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND b.v > a.v)""")
def h23_region_candidates(spark, d):
    px = pixels(spark, d).withColumn("region", F.expr(REGION))
    return spots.region_candidates(px, ["image"], "region", 1, 0.8).select("image", "region", "y", "x", r(F.col("amplitude")).alias("amplitude"))


OBJECTS = "CASE WHEN y < 3 AND x < 3 THEN 1 WHEN y < 3 AND x < 5 THEN 2 WHEN y = 7 AND x = 7 THEN 3 ELSE 0 END"


@query(f"""WITH {PIXELS}, l AS (SELECT vec_id, y, x, v, {OBJECTS} AS label FROM px), i AS (SELECT vec_id, label, median(v) AS m FROM l WHERE label > 0 GROUP BY ALL),
r AS (SELECT o.vec_id, o.label, median(b.v) AS m, count(*) AS n FROM (SELECT DISTINCT vec_id, label FROM l WHERE label > 0) o JOIN l b ON b.vec_id = o.vec_id AND b.label = 0
  AND EXISTS (SELECT 1 FROM l a WHERE a.vec_id = b.vec_id AND a.label = o.label AND abs(a.y - b.y) + abs(a.x - b.x) <= 2) GROUP BY ALL)
SELECT i.vec_id AS image, i.label, CASE WHEN n >= 5 THEN round(abs(i.m - r.m) / greatest(r.m, 1e-6), 6) END AS contrast FROM i LEFT JOIN r USING (vec_id, label)""")
def h24_object_contrast(spark, d):
    px = pixels(spark, d).withColumn("label", F.expr(OBJECTS))
    return spots.object_contrast(px, ["image"], "label", 2).withColumn("contrast", r(F.col("contrast")))


#: A symmetric 3 x 3 matrix's eigenvalues in closed form, and its eigenvectors as cross products of two rows less the eigenvalue.
PCA3 = """m AS (SELECT covar_samp(l_quantity, l_quantity) AS a, covar_samp(50 * l_discount, 50 * l_discount) AS b, covar_samp(l_linenumber * 3, l_linenumber * 3) AS c, covar_samp(l_quantity, 50 * l_discount) AS d,
  covar_samp(l_quantity, l_linenumber * 3) AS e, covar_samp(50 * l_discount, l_linenumber * 3) AS f, avg(l_quantity) AS ma, avg(50 * l_discount) AS mb, avg(l_linenumber * 3) AS mc FROM lineitem),
q AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM m),
t AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p)))) / 3 AS phi FROM q),
l AS (SELECT *, unnest([0, 1]) AS comp, unnest([q + 2 * p * cos(phi), 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3))]) AS lam FROM t),
v AS (SELECT *, d * f - e * (b - lam) AS vx, e * d - (a - lam) * f AS vy, (a - lam) * (b - lam) - d * d AS vz FROM l)"""


@query(f"""WITH {PCA3}, u AS (SELECT comp, lam / (a + b + c) AS share, vx / sqrt(vx * vx + vy * vy + vz * vz) AS x, vy / sqrt(vx * vx + vy * vy + vz * vz) AS y, vz / sqrt(vx * vx + vy * vy + vz * vz) AS z, ma, mb, mc FROM v)
SELECT l_suppkey AS grp, comp::INT AS component, round(any_value(share), 6) AS explains, round(avg(abs((l_quantity - ma) * x + (50 * l_discount - mb) * y + (l_linenumber * 3 - mc) * z)), 4) AS mean_score, count(*) AS n FROM lineitem, u GROUP BY ALL""")
def g5_components(spark, d):
    """Three measures and one that is never there, reduced to the components that explain more than 90 % of the variance."""
    x = table(spark, d, "lineitem").selectExpr("l_suppkey AS grp", "array(l_quantity, 50 * l_discount, cast(NULL AS double), l_linenumber * 3D) AS v")
    fitted = components.fit_components(x, "v", 0.9, 2, 2)
    out = components.reduce_vectors(x, "v", fitted, "scores").select("grp", F.posexplode("scores").alias("component", "score"))
    out = out.groupBy("grp", "component").agg(r(F.avg(F.abs("score")), 4).alias("mean_score"), F.count("*").alias("n"))
    share = F.element_at(F.lit([float(s) for s in fitted.explains]), F.col("component") + 1)
    return out.select("grp", "component", r(share).alias("explains"), "mean_score", "n")


@query("""WITH c AS (SELECT CASE WHEN label = 0 THEN 'run' || vec_id % 2 || '::c0' ELSE 'c' || label END AS key, CASE WHEN label = 0 THEN 'c0' ELSE 'c' || label END AS condition, 'run' || vec_id % 2 AS run_id FROM embeddings),
g AS (SELECT key, condition, string_agg(DISTINCT run_id, ',' ORDER BY run_id) AS run_id, least(count(*), 100) AS n_cells_used FROM c GROUP BY ALL HAVING count(*) >= 5)
SELECT key, condition, run_id, n_cells_used, count(*) OVER () - 1 AS n_pairs, count(*) OVER () * (count(*) OVER () - 1) // 2 AS added, 0 AS again, true AS apart FROM g""")
def g3_distance_job(spark, d):
    """Distances of all groups, stored, and asked for once more."""
    e = table(spark, d, "embeddings").selectExpr("vec_id", "concat('run', vec_id % 2) AS run", "concat('c', label) AS cond", "embedding")
    path = new_path(spark, "distances")
    first, second = (transport_job.distance_job(spark, e, path, "run", "cond", "vec_id", "embedding", F.col("cond") == "c0", "v1", merge=True, cap=100, dims=8) for _ in range(2))
    p = second.pairs
    ends = p.selectExpr("i AS key", "distance").union(p.selectExpr("j", "distance")).groupBy("key").agg(F.count("*").alias("n_pairs"), (F.min("distance") >= 0).alias("apart"))
    return second.groups.join(ends, "key").select("key", "condition", "run_id", "n_cells_used", "n_pairs", F.lit(first.added).cast("long").alias("added"), F.lit(second.added).cast("int").alias("again"), "apart")


@query("""WITH c AS (SELECT (c_acctbal > 3000)::INT AS y, count(*) AS n FROM customer WHERE c_custkey % 4 > 0 GROUP BY ALL), f AS (SELECT unnest([0.1, 0.55, 1.0]) AS f),
s AS (SELECT f, y, greatest(round_even(n * f, 0), least(8, n)) AS n FROM c, f WHERE (SELECT min(n) FROM c) >= 8)
SELECT round(f, 4) AS fraction, sum(n)::BIGINT AS n, (sum(n) FILTER (y = 0))::BIGINT AS n_good, (sum(n) FILTER (y = 1))::BIGINT AS n_bad, true AS scored FROM s GROUP BY f""")
def g10_learning_curve(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "cast(c_nationkey AS double) AS a", "c_acctbal + c_custkey * 7919 % 4000 AS b", "cast(c_acctbal > 3000 AS int) AS y", "CASE WHEN c_custkey % 4 > 0 THEN 'train' ELSE 'test' END AS split")
    curve = models.learning_curve(c, ["a", "b"], "y", "split", "c_custkey", 3, train=partial(models.train_feature_model, rounds=4, depth=2))
    sound = [F.col(m).between(0, 1) for m in ("roc_auc", "average_precision", "balanced_acc", "eval_acc")]
    return curve.select(r(F.col("fraction"), 4).alias("fraction"), "n", "n_good", "n_bad", (sound[0] & sound[1] & sound[2] & sound[3]).alias("scored"))


@query("""SELECT 'per_group' AS name, c_mktsegment AS k, count(*) AS n, round(avg(c_acctbal), 4) AS v FROM customer GROUP BY ALL UNION ALL SELECT 'summary', 'all', count(*), round(avg(c_acctbal), 4) FROM customer""")
def a16_result_tables(spark, d):
    """Two tables written, once over an older version, and read again from the manifest."""
    c, path = table(spark, d, "customer"), new_path(spark, "results")
    numbers = [F.count("*").alias("n"), r(F.avg("c_acctbal"), 4).alias("v")]
    summary, per_group = c.agg(*numbers).select(F.lit("all").alias("k"), "n", "v"), c.groupBy(F.col("c_mktsegment").alias("k")).agg(*numbers)
    results.write_results({"summary": summary.limit(0)}, path, {"species": "old"}, ("parquet",))
    results.write_results({"summary": summary, "per_group": per_group}, path, {"species": "new"})
    out = results.read_results(spark, path)
    return out["summary"].select(F.lit("summary").alias("name"), "k", "n", "v").unionByName(out["per_group"].select(F.lit("per_group").alias("name"), "k", "n", "v"))


@query("""WITH s AS (SELECT p_partkey, p_partkey % 6 AS i, p_partkey % 3 AS j, 'sha' || p_size || 'abcdefghijkl' AS sha FROM part)
SELECT p_partkey, CASE WHEN i IN (0, 1) THEN 'classify' WHEN i = 2 THEN 'segment' WHEN j = 0 THEN 'classify' WHEN j = 1 THEN 'segment' ELSE 'unknown' END AS input_stage,
CASE WHEN i = 0 THEN 'cnn' WHEN i = 1 THEN 'rules' WHEN i = 2 THEN 'none' WHEN j = 1 THEN 'none' ELSE 'unknown' END AS classifier_prefilter, CASE WHEN i = 0 THEN sha ELSE '' END AS sha,
CASE WHEN i = 0 THEN true WHEN i = 1 THEN false WHEN i = 3 THEN true END AS mask_background, CASE WHEN i = 0 THEN true WHEN i IN (1, 2) THEN false WHEN i = 3 THEN j <> 0 END AS classify_before,
concat_ws(';', CASE WHEN i IN (0, 3) THEN 'masked' END, CASE WHEN i = 0 THEN 'filtered_by_network:' || substr(sha, 1, 12) WHEN i = 3 AND j <> 0 THEN 'perhaps_filtered' END) AS warnings FROM s""")
def b25_crop_provenance(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_partkey % 6 AS i", "p_partkey % 3 AS j", "concat('sha', p_size, 'abcdefghijkl') AS sha")
    signature = F.expr("""CASE i WHEN 0 THEN concat('{"stage": "classify", "model": {"sha256": "', sha, '"}}') WHEN 1 THEN '{"stage": "classify", "model": null}' WHEN 2 THEN '{"stage": "segment", "model": {"sha256": "x"}}'
      WHEN 3 THEN '{"stage": "crops"}' WHEN 4 THEN '{broken' END""")
    folder = F.expr("CASE j WHEN 0 THEN '03_classify' WHEN 1 THEN '02_segment' ELSE 'other' END")
    manifest = F.expr("""CASE WHEN i = 3 THEN concat('{"stages": [{"name": "Classify", "skipped": ', j = 0, '}, {"name": "features", "opts": {"mask_background": true}}]}') WHEN i = 2 THEN '[1]' ELSE '{' END""")
    attributes = F.expr("""CASE i WHEN 0 THEN map('mask_background', 'TRUE', 'classifier_prefilter', ' CNN ', 'classifier_prefilter_model_sha256', sha) WHEN 1 THEN map('crop_opts', '{"mask_background": 0}', 'classifier_prefilter', 'rules')
      WHEN 2 THEN map('classifier_prefilter', 'none') ELSE map('classifier_prefilter', 'odd') END""")
    o = p.select("p_partkey", provenance.input_provenance(signature, folder).alias("p"), provenance.crop_options(manifest, attributes).alias("o"))
    return o.select("p_partkey", "p.input_stage", "p.classifier_prefilter", F.col("p.classifier_prefilter_model_sha256").alias("sha"), "o.mask_background", F.col("o.classify_before_features").alias("classify_before"), F.array_join(provenance.crop_warnings(F.col("o")), ";").alias("warnings"))


@query("""WITH s AS (SELECT DISTINCT o_custkey AS file, o_orderkey AS scene FROM orders) SELECT file, scene FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY md5('5:' || file || ':' || scene), file || ':' || scene) AS k FROM s) WHERE k <= 3""")
def h11_review_sample(spark, d):
    return ranking.review_sample(table(spark, d, "orders"), "o_custkey", "o_orderkey", 3, 5).select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("scene"))


@query(f"""WITH v AS (SELECT CASE WHEN label < 2 THEN 'nt' || label || ' x' ELSE 'c' || label END AS label, UNNEST(embedding)::DOUBLE AS x, UNNEST(range(len(embedding))) AS dim FROM embeddings),
m AS (SELECT label, dim, avg(x) AS m FROM v GROUP BY ALL), a AS (SELECT dim, avg(m) AS a FROM m WHERE label LIKE 'nt%' GROUP BY ALL) SELECT label, dim::INT AS dim, round(m - a, 6) AS value FROM m JOIN a USING (dim)""")
def d7_control_relative(spark, d):
    e = table(spark, d, "embeddings").withColumn("label", F.expr("CASE WHEN label < 2 THEN concat('nt', label, ' x') ELSE concat('c', label) END"))
    p = profiles.control_relative(profiles.embedding_profiles(e, "label", "embedding", centred=False), "label")
    return p.withColumn("value", r(F.col("value")))


@query("""SELECT l_returnflag AS k, count(*) FILTER (l_linestatus = 'F') AS n_bad, count(*) FILTER (l_linestatus = 'O') AS n_good, count(*) FILTER (l_linestatus = 'F') = 0 OR count(*) FILTER (l_linestatus = 'O') = 0 AS single_class FROM lineitem GROUP BY ALL
UNION ALL SELECT 'only', 0, count(*), true FROM orders""")
def d13_class_balance(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_returnflag AS k", "CASE l_linestatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END AS y")
    return profiles.class_balance(x.unionByName(table(spark, d, "orders").selectExpr("'only' AS k", "1 AS y")), "y", ["k"])


@query("""WITH n AS (SELECT unnest([0, 1]) AS a), p AS (SELECT x.a AS label, y.a AS again FROM n x, n y) SELECT label, again, (SELECT count(*) FROM labels WHERE quality = label AND toxic = again) AS n,
(SELECT count(*) FROM labels WHERE quality <> toxic AND quality = label AND toxic = again) AS listed FROM p""")
def d14_flips(spark, d):
    l = table(spark, d, "labels")
    apart = profiles.disagreements(l, "quality", "toxic", "doc_id").groupBy(F.col("quality").alias("label"), F.col("toxic").alias("again")).agg(F.count("doc_id").alias("listed"))
    return profiles.flips(l, "quality", "toxic", [0, 1]).join(apart, ["label", "again"], "left").fillna(0, ["listed"])


@query("""SELECT (SELECT sha256(string_agg(o_orderkey || chr(9) || o_orderpriority, chr(10) ORDER BY o_orderkey || chr(9) || o_orderpriority)) FROM (SELECT DISTINCT o_orderkey, o_orderpriority FROM orders)) AS by_text,
(SELECT sha256(string_agg(c_name, chr(10) ORDER BY c_custkey, c_name)) FROM customer) AS in_order""")
def d15_lines_sha256(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").distinct()
    by_text = digests.lines_sha256(o, F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority"))
    in_order = digests.lines_sha256(table(spark, d, "customer"), F.col("c_name"), F.col("c_custkey"))
    return table(spark, d, "region").limit(1).select(F.lit(by_text).alias("by_text"), F.lit(in_order).alias("in_order"))


@query(f"""WITH {PIXELS}, p AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.999) AS hi FROM px GROUP BY ALL) SELECT vec_id AS image, y::INT AS y, x::INT AS x, round(greatest(0, least(1, (v - lo) / (hi - lo))), 6) AS value FROM px JOIN p USING (vec_id)""")
def d19_rescale(spark, d):
    return spots.rescale(pixels(spark, d).select("image", "y", "x", "value"), ["image"]).withColumn("value", r(F.col("value")))


@query("""WITH c AS (SELECT o_orderkey, (o_custkey % 101) / 100.0 AS p FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)), n AS (SELECT (SELECT count(*) FROM orders) AS n_matching, (SELECT count(*) FROM c) AS n_candidates)
SELECT * FROM (SELECT o_orderkey, round(p, 6) AS p FROM c WHERE greatest(p, 1 - p) < 0.8 ORDER BY greatest(p, 1 - p), md5('7:' || o_orderkey), o_orderkey LIMIT 200), n""")
def e11_uncertain_pool(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "(o_custkey % 101) / 100.0D AS p")
    seen = table(spark, d, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    pool = ranking.build_pool(o, "o_orderkey", "uncertain", 200, 7, "p", seen, 0.8).select("o_orderkey", r(F.col("p")).alias("p"))
    return pool.join(F.broadcast(ranking.pool_counts(o, "o_orderkey", seen)), F.lit(True))  # one row


@query("""WITH g AS (SELECT count(DISTINCT o_orderpriority) AS g FROM orders), x AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('3:' || o_orderkey), o_orderkey) AS k FROM orders)
SELECT o_orderkey, o_orderpriority FROM x, g WHERE k <= greatest(1, 700 // g)""")
def e16_stratified_cap(spark, d):
    return ranking.stratified_cap(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 700, 3)


@query(f"""WITH {WELLS}, f AS (SELECT well, p_brand, min(p_partkey) AS first, count(DISTINCT p_size) AS n FROM w GROUP BY ALL) SELECT well, min_by(n, first)::INT AS n_positions, (row_number() OVER (ORDER BY left(well, 1), substr(well, 2)::INT))::INT AS place FROM f GROUP BY well""")
def e25_layout_template(spark, d):
    m = layout.merge_sources(wells(spark, d), "well", "p_brand", "p_partkey", "p_size")
    t = layout.layout_template(m, "well", "scenes")
    return t.select("well", "n_positions", F.row_number().over(Window.orderBy("order")).alias("place"))  # the wells of one plate


@query("""SELECT 'o_orderpriority' AS field, '9-NONE' AS value UNION ALL SELECT 'o_orderstatus', 'X'""")
def b16_unknown_values(spark, d):
    return filters.unknown_values(table(spark, d, "orders"), {"o_orderstatus": ["F", "X"], "o_orderpriority": ["1-URGENT", "9-NONE"]})


@query(f"""WITH {LABELLED}, i AS (SELECT a.vec_id, a.label AS la, b.label AS lb, count(*) AS n FROM a JOIN b ON a.vec_id = b.vec_id AND a.y = b.y AND a.x = b.x WHERE a.label > 0 AND b.label > 0 GROUP BY ALL),
na AS (SELECT vec_id, label, count(*) AS n FROM a WHERE label > 0 GROUP BY ALL), nb AS (SELECT vec_id, label, count(*) AS n FROM b WHERE label > 0 GROUP BY ALL), u AS (SELECT i.vec_id, la, lb, i.n / (na.n + nb.n - i.n) AS iou FROM i JOIN na ON na.vec_id = i.vec_id AND na.label = la JOIN nb ON nb.vec_id = i.vec_id AND nb.label = lb),
ra AS (SELECT *, row_number() OVER (PARTITION BY vec_id, la ORDER BY iou DESC, lb) AS r FROM u WHERE iou >= 0.5), rb AS (SELECT *, row_number() OVER (PARTITION BY vec_id, lb ORDER BY iou DESC, la) AS s FROM ra WHERE r = 1), mt AS (SELECT * FROM rb WHERE s = 1)
SELECT 'a' AS side, vec_id AS image, label FROM na WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.vec_id = na.vec_id AND la = label) UNION ALL SELECT 'b', vec_id, label FROM nb WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.vec_id = nb.vec_id AND lb = label)""")
def c10_unmatched(spark, d):
    a, b = labelled(spark, d)
    m = regions.match_regions(regions.overlaps(a, b, ["image"]), ["image"])
    parts = [regions.unmatched(px, m, ["image"], side).select(F.lit(name).alias("side"), "image", "label") for px, side, name in ((a, "la", "a"), (b, "lb", "b"))]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {WELLS}, one AS (SELECT well, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY well ORDER BY p_partkey) AS k FROM w) WHERE k = 1)
SELECT well, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN '' ELSE p_size || ';' || p_partkey END AS scenes, CASE WHEN p_partkey % 4 = 1 THEN 1 ELSE 0 END AS issues FROM one""")
def a9_clean_layout(spark, d):
    first = Window.partitionBy("well").orderBy("p_partkey")
    one = wells(spark, d).withColumn("k", F.row_number().over(first)).filter("k = 1")
    raw = one.selectExpr("concat(' ', lower(well), ' ') AS well", "'x' AS condition", "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'none' ELSE concat('[', p_size, ', ', p_partkey, ']') END AS scene_indices")
    clean, issues = layout.clean_layout(raw)
    n = issues.groupBy(F.split("detail", ": ")[0].alias("well")).agg(F.count("*").cast("int").alias("issues"))
    return clean.join(n, "well", "left").select("well", F.array_join("scene_indices", ";").alias("scenes"), F.coalesce("issues", F.lit(0)).alias("issues"))


@query(f"WITH {RANKED}, f AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS place FROM dist WHERE i < 4 AND j IN (2, 4, 5)) SELECT i AS query, 'run' || i % 3 AS query_run, place::INT AS rank, j AS match, 'run' || j % 3 AS match_run, round(d, 5) AS distance FROM f WHERE place <= 2")
def e4_matches_of_sets(spark, d):
    runs = table(spark, d, "embeddings").selectExpr("label AS id", "concat('run', label % 3) AS run").distinct()
    return joins.rank_matches(distances(spark, d), "euclidean", 2, [0, 1, 2, 3], [2, 4, 5], runs).withColumn("distance", r(F.col("distance"), 5))


@query(f"WITH {RANKED} SELECT i AS key, j AS other, round(d, 5) AS distance FROM dist WHERE i < j")
def a14_wide_distances(spark, d):
    """To the wide form, written, and back."""
    pairs, path = distances(spark, d), new_path(spark, "wide")
    groups = pairs.selectExpr("i AS key").union(pairs.selectExpr("j")).distinct().withColumn("place", F.col("key"))
    tables.wide_distances(pairs, groups, "place", "euclidean").write.parquet(path)
    back = tables.long_distances(spark.read.parquet(path), "place")
    return back.select(F.col("i").alias("key"), F.col("j").alias("other"), r(F.col("distance"), 5).alias("distance"))


@query("""SELECT c_mktsegment AS k, count(*) AS n, count(*) FILTER (c_custkey % 3 > 0) AS n_bal, round(avg(c_acctbal) FILTER (c_custkey % 3 > 0), 4) AS mean FROM customer GROUP BY ALL""")
def a1_read_features(spark, d):
    """The same table as Parquet and as CSV, NaN without a value in both; an error if they differ."""
    path = new_path(spark, "features")
    c = table(spark, d, "customer").selectExpr("c_custkey", "c_mktsegment AS k", "CASE WHEN c_custkey % 3 > 0 THEN c_acctbal ELSE double('NaN') END AS bal")
    c.write.parquet(f"{path}/f.parquet")
    c.write.option("header", True).csv(f"{path}/f.csv")
    a, b = tables.read_features(spark, f"{path}/f.parquet"), tables.read_features(spark, f"{path}/f.csv")
    both = a.selectExpr("c_custkey", "k", "bal").exceptAll(b.selectExpr("cast(c_custkey AS long) AS c_custkey", "k", "cast(bal AS double) AS bal"))
    out = a.groupBy("k").agg(F.count("*").alias("n"), F.count("bal").alias("n_bal"), r(F.avg("bal"), 4).alias("mean"))
    return out.join(both.select("k").distinct(), "k", "left_anti")


@query("""WITH p AS (SELECT p_partkey, p_brand, 'kind' || substr(p_brand, 7, 1) AS kind FROM part) SELECT p_brand AS run_id, kind AS experiment_type, count(*) AS n FROM p JOIN lineitem ON l_partkey = p_partkey WHERE kind = (SELECT min(kind) FROM p) GROUP BY ALL""")
def a4_load_library(spark, d):
    """Brands are runs, the first digit of their number the species."""
    p = table(spark, d, "part").withColumn("kind", F.concat(F.lit("kind"), F.substring("p_brand", 7, 1)))
    index = p.selectExpr("p_brand AS run_id", "kind AS species", "kind AS experiment_type").distinct()
    species = p.agg(F.min("kind")).first()[0]
    runs = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).selectExpr("p_brand AS run_id", "l_orderkey")
    own = tables.load_library(index, runs, species.upper())
    return own.groupBy(F.col("_library_run_id").alias("run_id"), F.col("_library_experiment_type").alias("experiment_type")).agg(F.count("*").alias("n"))


@query("""SELECT split, model_at_label, count(*) AS n, (SELECT count(*) FROM labels WHERE doc_id % 10 = 0) AS n_bad FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE 'm1' END AS model_at_label
FROM labels WHERE doc_id % 10 > 0) GROUP BY ALL""")
def a8_label_log(spark, d):
    """A CSV log with rows that don't hold a label, read, and appended to a table in which older files lack the later columns."""
    path = new_path(spark, "labels")
    raw = table(spark, d, "labels").selectExpr("doc_id AS cell_uid", "CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE cast(quality AS string) END AS label_idx", "'name' AS label_name", "'2024-01-01T00:00:00' AS labeled_at", "CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE ' ' END AS split")
    raw.write.option("header", True).csv(f"{path}/log")
    sound, counts = tables.valid_labels(tables.read_labels(spark, f"{path}/log"))
    old = sound.filter("cast(cell_uid AS long) % 2 = 0").drop("split").join(sound.select("cell_uid", "split"), "cell_uid")
    old.write.parquet(f"{path}/table")
    tables.append_labels(sound.filter("cast(cell_uid AS long) % 2 = 1").withColumn("model_at_label", F.lit("m1")), f"{path}/table")
    out = tables.read_label_table(spark, f"{path}/table").groupBy("split", "model_at_label").agg(F.count("*").alias("n"))
    return out.join(F.broadcast(counts.select("n_bad")), F.lit(True))  # one row


@query("SELECT n_name AS name, n_regionkey AS region, length(n_name) AS n FROM nation WHERE n_nationkey % 5 > 0")
def a12_scan_json(spark, d):
    """A file for each nation, of which every fifth is broken."""
    path = new_path(spark, "json")
    n = table(spark, d, "nation").withColumn("text", F.when(F.col("n_nationkey") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("at")))))
    n.select("n_nationkey", "text").repartition(25, "n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = tables.scan_json(spark, f"{path}/*/*.txt", "name string, at struct<region: long>")
    return found.select("name", F.col("at.region").alias("region"), F.length("name").cast("long").alias("n"))


@query("SELECT r_name AS name, sha256(r_name || chr(10)) AS sha256, length(r_name) + 1 AS length FROM region")
def a13_fingerprint_files(spark, d):
    path = new_path(spark, "files")
    table(spark, d, "region").select("r_regionkey", "r_name").repartition(5, "r_regionkey").write.partitionBy("r_regionkey").text(path)
    f = tables.fingerprint_files(spark, f"{path}/*/*.txt").withColumn("key", F.regexp_extract("path", "r_regionkey=([0-9]+)", 1).cast("long"))
    names = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return f.join(names, "key").select("name", "sha256", "length")


@query("""SELECT c_custkey AS session_id, CASE WHEN s_suppkey IS NULL THEN c_mktsegment ELSE s_name END AS note FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""")
def a18_record_session(spark, d):
    log = table(spark, d, "customer").selectExpr("c_custkey AS session_id", "c_mktsegment AS note")
    return tables.record_session(log, table(spark, d, "supplier").selectExpr("s_suppkey AS session_id", "s_name AS note"))


@query("""WITH m AS (SELECT p_partkey AS position, p_name AS model_name, p_brand AS model_type FROM part WHERE p_partkey > 1), n AS (SELECT p_name, p_brand FROM part WHERE p_partkey = 1)
SELECT model_type, max(position)::BIGINT AS position FROM (SELECT position, model_type FROM m WHERE model_name NOT IN (SELECT p_name FROM n) UNION ALL SELECT (SELECT max(position) FROM m) + 1, p_brand FROM n) WHERE model_type = (SELECT p_brand FROM n) GROUP BY ALL""")
def e20_model_registry(spark, d):
    """The first part registered again as the last model; the last of its type."""
    p = table(spark, d, "part").selectExpr("p_partkey AS position", "p_name AS model_name", "p_brand AS model_type")
    new = p.filter("position = 1").drop("position")
    registry = tables.register_model(p.filter("position > 1"), new)
    return tables.latest_model(registry, new.first()["model_type"]).select("model_type", F.col("position").cast("long").alias("position"))


@query("""WITH s AS (SELECT (c_acctbal > 3000)::INT AS y FROM customer WHERE c_custkey % 4 = 0) SELECT count(*) FILTER (y = 0) AS tn, 0 AS fp, 0 AS fn, count(*) FILTER (y = 1) AS tp, 1.0 AS accuracy, 1.0 AS auc, 'b' AS feature FROM s""")
def g11_evaluate_model(spark, d):
    """A model of a label that one measure gives: no error on the hold-out, and that measure alone matters."""
    c = table(spark, d, "customer").selectExpr("c_custkey", "cast(c_nationkey AS double) AS a", "CASE WHEN c_acctbal > 3000 THEN 2D ELSE 1D END AS b", "cast(c_acctbal > 3000 AS int) AS y", "CASE WHEN c_custkey % 4 > 0 THEN 'train' ELSE 'test' END AS split")
    model, used = models.train_feature_model(c, ["a", "b"], "y", "split", rounds=3, depth=2)
    held = c.filter("split = 'test'")
    e = models.evaluate_model(model, held, used, "y").select("tn", "fp", "fn", "tp", "accuracy", "auc")
    top = models.permutation_importance(model, held, used, "y", "c_custkey", 2).agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("feature"))
    return e.join(F.broadcast(top), F.lit(True))  # one row each


@query("SELECT user_id, max(value) AS value, count(*) OVER () AS n FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY user_id")
def s1_latest_labels(spark, d):
    """Events arrive in three batches of files; the table has the latest of each user."""
    path = new_path(spark, "stream")
    e = table(spark, d, "events").selectExpr("user_id", "cast(ts AS timestamp) AS ts", "event_id", "value")
    for part in (2, 0, 1):
        e.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{path}/in")
        intake.stream_latest_labels(spark, f"{path}/in", e.schema.simpleString()[7:-1].replace(":", " "), f"{path}/latest", "user_id", "ts", "event_id", f"{path}/checkpoint").awaitTermination()
    now = intake.current_labels(spark, f"{path}/latest")
    return now.select("user_id", "value").join(F.broadcast(now.agg(F.count("*").alias("n"))), F.lit(True))  # one row


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_nationkey >= 3")
def s2_sample_intake(spark, d):
    path = new_path(spark, "intake")
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    for part in (0, 1):
        c.filter(F.col("c_custkey") % 2 == part).write.mode("append").parquet(f"{path}/in")
        intake.stream_intake(spark, f"{path}/in", "c_custkey long, c_acctbal double, c_nationkey long", {"c_acctbal": 1000, "c_nationkey": 3}, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("c_custkey", "c_acctbal")


FOREGROUND = "(y * 3 + x * 5 + vec_id) % 7 < 4"


@query(f"""WITH {GRAD}, m AS (SELECT *, {FOREGROUND} AS m FROM g3), f AS (SELECT *, lead(v, 1) OVER c AS y1, lead(v, 2) OVER c AS y2, lag(v) OVER c AS y_1, lead(v) OVER r AS x1, lag(v) OVER r AS x_1, lead(m, 1) OVER c AS m1, lead(m, 2) OVER c AS m2
FROM m WINDOW c AS (PARTITION BY vec_id, x ORDER BY y), r AS (PARTITION BY vec_id, y ORDER BY x))
SELECT vec_id AS image, round(var_pop(v) FILTER (m) / avg(v) FILTER (m), 6) AS normalized_variance, round(sum((y2 - v) * (y2 - v)) FILTER (m1), 5) AS brenner, round(sum(v * y1) FILTER (m AND m1) - sum(v * y2) FILTER (m AND m2), 4) AS vollath_f4,
round(sum(abs(2 * v - y1 - y_1)) FILTER (m) + sum(abs(2 * v - x1 - x_1)) FILTER (m), 5) AS sml, round(var_pop(lap) FILTER (m), 4) AS laplacian_variance, round(sum(gx * gx + gy * gy) FILTER (m), 3) AS tenengrad FROM f GROUP BY vec_id""")
def h1_masked_metrics(spark, d):
    px = pixels(spark, d).withColumn("fg", F.expr(FOREGROUND.replace("vec_id", "image")))
    m = px_metrics.focus_metrics(px, ["image"], "fg").join(focus.sharpness(px, ["image"], "fg").select("image", "laplacian_variance", "tenengrad"), "image")
    digits = {"normalized_variance": 6, "brenner": 5, "vollath_f4": 4, "sml": 5, "laplacian_variance": 4, "tenengrad": 3}
    return m.select("image", *[r(F.col(c), n).alias(c) for c, n in digits.items()])


@query("""WITH k AS (SELECT DISTINCT 'w' || l_suppkey % 5 AS well, l_orderkey AS fov, l_linenumber AS channel_index, l_returnflag AS detector, l_partkey AS cell_id, l_suppkey AS focus_id FROM lineitem),
s AS (SELECT *, CASE WHEN focus_id % 3 = 0 THEN 'new' WHEN focus_id % 2 = 0 THEN 'old' END AS label FROM k) SELECT well, label, CASE label WHEN 'new' THEN '2024-02-01T00:00:00' WHEN 'old' THEN '2024-01-01T00:00:00' END AS labeled_at, count(*) AS n FROM s GROUP BY ALL""")
def b32_spot_labels(spark, d):
    """Every second spot has an old label, every third gets a new one."""
    names = {"well": "concat('w', l_suppkey % 5)", "fov": "l_orderkey", "channel_index": "l_linenumber", "detector": "l_returnflag", "cell_id": "l_partkey", "focus_id": "l_suppkey"}
    s = table(spark, d, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in names.items()]).distinct()
    old = s.filter("focus_id % 2 = 0").withColumn("label", F.lit("old")).withColumn("labeled_at", F.lit("2024-01-01T00:00:00"))
    labels = evaluation.save_spot_labels(old, s.filter("focus_id % 3 = 0").withColumn("label", F.lit("new")), F.lit("2024-02-01T00:00:00"))
    return evaluation.with_spot_labels(s, labels).groupBy("well", "label", "labeled_at").agg(F.count("*").alias("n"))
