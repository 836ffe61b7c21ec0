"""Queries on names, choices of columns, scores of representations and reports, with their SQL. Roles as in registry.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import naming as N
from ..operators import evaluation, focus, profiles
from ..operators import pixels as px_metrics
from ..worktable import materialize
from .library import distances
from .registry import CELLS, PIXELS, RANKED, SSCORE, BOXES, boxes, cell_profiles, cells, query, r, table
from .summaries import GRAD, pixels


@query("""WITH p AS (SELECT p_partkey, p_brand || ':' || p_size AS a, trim(p_type) AS b, CASE WHEN p_partkey % 5 = 0 THEN 'CON' ELSE 'x' END AS c FROM part),
s AS (SELECT *, regexp_replace(a, '[ <>:"/\\\\|?*]', '_', 'g') || '__' || regexp_replace(b, '[ <>:"/\\\\|?*]', '_', 'g') || '__' || CASE WHEN c = 'CON' THEN '_CON' ELSE c END AS stem FROM p)
SELECT p_partkey, stem || '__H' || substr(sha256('["' || a || '","' || b || '","' || c || '"]'), 1, 8) || '__W' || p_partkey AS stem FROM s""")
def b10_output_stem(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "concat(p_brand, ':', p_size, ' ') AS a", "p_type AS b", "CASE WHEN p_partkey % 5 = 0 THEN 'CON' ELSE 'x' END AS c")
    return p.select("p_partkey", N.output_stem(F.col("a"), F.col("b"), F.col("c"), stable_id=F.col("p_partkey")).alias("stem"))


@query("""WITH c AS (SELECT 'run' || (l_suppkey % 4) AS run_id, l_quantity AS length_um, l_extendedprice AS area_um2_subpixel, l_discount AS solidity, l_tax AS intensity_mean_mcherry FROM lineitem),
p AS (SELECT run_id, avg(length_um) AS length_um, avg(area_um2_subpixel) AS area_um2_subpixel, avg(solidity) AS solidity, avg(intensity_mean_mcherry) AS intensity_mean_mcherry FROM c GROUP BY ALL)
SELECT run_id, feature, round(value, 5) AS value FROM (UNPIVOT p ON length_um, area_um2_subpixel, solidity, intensity_mean_mcherry INTO NAME feature VALUE value)""")
def b11_column_selectors(spark, d):
    c = table(spark, d, "lineitem").selectExpr(
        "concat('run', l_suppkey % 4) AS run_id", "l_quantity AS length_um", "l_extendedprice AS area_um2_subpixel", "l_extendedprice + 1 AS area_um2", "l_discount AS solidity",
        "l_tax AS intensity_mean_mcherry", "l_tax + 1 AS intensity_mean_phase",
    )
    names = [*N.morphology_cols(c.columns), N.intensity_col(c.columns)]
    p = c.groupBy("run_id").agg(*[F.avg(n).alias(n) for n in names])
    return p.unpivot(["run_id"], names, "feature", "value").withColumn("value", r(F.col("value"), 5))


@query("""WITH b AS (SELECT p_brand AS brand, min((CASE WHEN lower(trim(p_type)) = 'eco' THEN 0 WHEN contains(lower(p_type), 'eco') THEN 1 END, p_size, p_type)) FILTER (contains(lower(p_type), 'eco')) AS m FROM part GROUP BY ALL),
i AS (SELECT p_brand AS brand, min(p_type) FILTER (p_size = 7) AS seventh FROM part GROUP BY ALL)
SELECT brand, m[2] AS idx, m[3] AS name, CASE m[1] WHEN 0 THEN 'exact' WHEN 1 THEN 'part' ELSE 'none' END AS how, seventh, CASE WHEN seventh IS NULL THEN 'none' ELSE 'index' END AS seventh_how FROM b JOIN i USING (brand)""")
def b24_resolve_channel(spark, d):
    """By a name, and by an index; brands without such a channel too."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("name"), F.col("p_size").alias("idx"))
    by_name, by_index = evaluation.resolve_channel(p, " ECO ", ["brand"]), evaluation.resolve_channel(p, 7, ["brand"])
    return by_name.join(by_index.select("brand", F.col("name").alias("seventh"), F.col("how").alias("seventh_how")), "brand")


@query("""WITH c AS (SELECT o_custkey AS k, o_orderkey AS idx, CASE o_orderkey % 6 WHEN 0 THEN 'DIC-1' WHEN 1 THEN 'Phasemask' WHEN 2 THEN 'mCherry' WHEN 3 THEN 'my TL' ELSE 'phase_x' END AS name FROM orders)
SELECT k, coalesce(min(idx) FILTER (regexp_matches(lower(name), '\\b(?:phase|bright|brightfield|tl|dic)\\b')), min(idx)) AS phase, min(idx) FILTER (contains(lower(name), 'mask')) AS mask FROM c GROUP BY k""")
def b24_phase_channel(spark, d):
    name = F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'DIC-1' WHEN 1 THEN 'Phasemask' WHEN 2 THEN 'mCherry' WHEN 3 THEN 'my TL' ELSE 'phase_x' END")
    return evaluation.phase_channel(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("idx"), name.alias("name")), ["k"])


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'trained' WHEN 1 THEN 'Order_' || o_custkey || '.v2' ELSE 'plain_' || o_custkey END AS run,
CASE o_orderkey % 3 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || '_12-30-05' ELSE '' END AS stamp, o_custkey FROM orders)
SELECT o_orderkey, run, stamp, run || CASE WHEN stamp = '' THEN '' ELSE ' · ' || stamp END || CASE WHEN o_custkey % 2 = 0 THEN ' (acc 0.' || (10 + o_custkey % 90) || ')' ELSE '' END AS label,
CASE WHEN o_orderkey % 5 = 0 THEN 'model' ELSE 'My-Order_' || o_custkey || '.x' END AS slug FROM d""")
def b26_parse_run_dir(spark, d):
    dir_ = "CASE o_orderkey % 3 WHEN 0 THEN concat('trained_', o_custkey) WHEN 1 THEN concat('Order_', o_custkey, '.v2_', date_format(o_orderdate, 'yyyy-MM-dd'), '_12-30-05') ELSE concat('plain_', o_custkey) END"
    acc = "CASE WHEN o_custkey % 2 = 0 THEN (10 + o_custkey % 90) / 100D END"
    typed = "CASE WHEN o_orderkey % 5 = 0 THEN ' .-!' ELSE concat('  My  Order_', o_custkey, '.x!! ') END"
    o = table(spark, d, "orders").selectExpr("o_orderkey", f"{dir_} AS dir", f"{acc} AS acc", f"{typed} AS typed")
    p = o.select("o_orderkey", N.parse_run_dir(F.col("dir"), F.col("acc")).alias("p"), N.slug(F.col("typed")).alias("slug"))
    return p.select("o_orderkey", "p.run", "p.stamp", "p.label", "slug")


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","size":' || p_size || ',"stage":"crops"}') AS digest FROM part""")
def b27_signature(spark, d):
    return table(spark, d, "part").select("p_partkey", N.signature(stage=F.lit("crops"), size=F.col("p_size"), brand=F.col("p_brand")).alias("digest"))


@query("""SELECT decision, count(*) AS n FROM (SELECT CASE WHEN s.o_orderkey IS NULL THEN 'build' WHEN s.o_orderstatus = 'P' THEN 'in-progress' WHEN s.o_custkey % 7 = 0 THEN 'corrupt' WHEN s.o_custkey % 5 = 0 THEN 'companion-missing'
WHEN s.o_custkey % 4 <> 1 AND s.o_orderpriority <> '1-URGENT' THEN 'rebuild' WHEN s.o_custkey % 4 = 1 THEN 'legacy' ELSE 'reuse' END AS decision
FROM (SELECT DISTINCT l_orderkey FROM lineitem) w LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 3 > 0) s ON l_orderkey = o_orderkey) GROUP BY ALL""")
def b28_reuse_plan(spark, d):
    wanted = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit("1-URGENT").alias("digest")).distinct()
    stored = table(spark, d, "orders").filter("o_custkey % 3 > 0").selectExpr(
        "o_orderkey AS key", "o_orderstatus = 'P' AS in_progress", "o_custkey % 7 <> 0 AS valid", "o_custkey % 5 <> 0 AS companions_valid", "CASE WHEN o_custkey % 4 <> 1 THEN o_orderpriority END AS digest"
    )
    return evaluation.reuse_plan(wanted, stored, "key").groupBy("decision").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT c_custkey, c_custkey % 5 AS m, s_suppkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey) SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN s_suppkey IS NULL THEN 'missing'
WHEN m = 0 THEN 'match' WHEN m = 1 THEN 'refresh' WHEN m = 2 THEN 'backfill' WHEN m = 4 AND c_custkey % 2 = 0 THEN 'match' ELSE 'mismatch' END AS verdict FROM x) GROUP BY ALL""")
def b31_check_dataset(spark, d):
    """Of m = customer % 5: equal, equal uids with other rows, no stored uid, another uid, and no uid now (rows decide)."""
    manifest = table(spark, d, "customer").selectExpr("c_custkey AS name", "CASE WHEN c_custkey % 5 <> 2 THEN cast(c_custkey % 5 AS string) ELSE ' ' END AS uid", "10 AS n", "'h' AS head")
    uid = "CASE s_suppkey % 5 WHEN 3 THEN '9' WHEN 4 THEN NULL ELSE cast(s_suppkey % 5 AS string) END AS uid"
    now = table(spark, d, "supplier").selectExpr("s_suppkey AS name", uid, "CASE WHEN s_suppkey % 5 = 1 OR (s_suppkey % 5 = 4 AND s_suppkey % 2 = 1) THEN 11 ELSE 10 END AS n", "'h' AS head")
    return evaluation.check_dataset(manifest, now).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber - 1 AS region_id, count(*) AS spots FROM lineitem WHERE l_suppkey % 5 = 2 AND l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber > 1 GROUP BY ALL")
def b32_unit_view(spark, d):
    s = table(spark, d, "lineitem").withColumn("region_id", F.col("l_linenumber") - 1)
    return evaluation.unit_view(s, F.col("l_suppkey") % 5 == 2, F.col("l_returnflag") == "N", F.col("l_linestatus") == "O")


@query("SELECT l_orderkey AS scene, l_linenumber AS z, o_custkey % 7 AS chosen_z, l_linenumber - o_custkey % 7 AS error FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 9 <> 0")
def c14_picks_vs_manual(spark, d):
    manual = table(spark, d, "orders").selectExpr("o_orderkey AS scene", "CASE WHEN o_custkey % 9 = 0 THEN -1 ELSE o_custkey % 7 END AS chosen_z")
    return evaluation.picks_vs_manual(table(spark, d, "lineitem").selectExpr("l_orderkey AS scene", "l_linenumber AS z"), manual, "scene")


@query(f"""WITH {CELLS} SELECT run_id, cond, count(*) AS n, round(quantile_cont(area, 0.5), 3) AS area_median, round(quantile_cont(width, 0.95), 3) AS red_p95 FROM cells GROUP BY ALL""")
def c15_summary_join(spark, d):
    c = cells(spark, d)
    shape = profiles.summary_table(c, ["run_id", "cond"], "length", "width", "area").select("run_id", "cond", "n", "area_median")
    return evaluation.summary_join(shape, c, ["run_id", "cond"], "width", "red").drop("red_median")


@query(f"""WITH {BOXES}, d AS (SELECT a.p_partkey, min(sqrt((a.y0-b.y0)*(a.y0-b.y0)+(a.x0-b.x0)*(a.x0-b.x0))) AS d, count(b.p_partkey) + 1 AS field FROM boxes a LEFT JOIN boxes b ON a.fov = b.fov AND a.p_partkey <> b.p_partkey GROUP BY ALL)
SELECT p_partkey, field, round(d, 6) AS nearest FROM d""")
def c8_nearest_in_field(spark, d):
    n = evaluation.nearest_in_field(boxes(spark, d), ["fov"], "p_partkey", "y0", "x0", 16.0)
    return n.select("p_partkey", "field", r(F.col("nearest")).alias("nearest"))


SIDES = ", ".join(
    f"count(*) FILTER (side = '{side}' AND qc = '{v}') AS {name}_{v}" for side, name in (("matched_ref_sample", "kept"), ("only_A", "removed"), ("only_B", "added")) for v in ("edge_cell", "debris", "bad", "good")
)


@query(f"""WITH f AS (SELECT o_orderpriority AS k, count(*) AS fields, sum(o_custkey) AS n_a, sum(o_custkey % 100) AS n_b, sum(o_custkey % 50) AS matched, sum(o_orderkey % 7) AS only_a, sum(o_orderkey % 5) AS only_b, sum(o_orderkey % 3) AS splits, sum(o_orderkey % 2) AS merges,
sum(o_custkey % 20) AS good_a, sum(o_custkey % 10) AS good_b, sum(o_custkey % 8) AS good_matched_both, median(o_totalprice) AS s, avg(o_totalprice) AS sm FROM orders GROUP BY ALL),
j AS (SELECT o_orderpriority AS k, lineitem.*, l_extendedprice / (l_quantity * 1000) - 1 AS da, (l_quantity + 1) / (l_linenumber * 5.0) - 1 AS dl FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT k, median(l_discount * 10) AS iou, quantile_cont(l_discount * 10, 0.05) AS p5, avg((l_discount * 10 >= 0.9)::INT) AS iou90, median(da) AS da, median(abs(da)) AS daa, median(dl) AS dl, median(abs(dl)) AS dla FROM j GROUP BY ALL),
o AS (SELECT k, CASE WHEN l_partkey % 3 = 0 THEN 'matched_ref_sample' WHEN l_partkey % 3 = 1 THEN 'only_A' ELSE 'only_B' END AS side, CASE l_suppkey % 5 WHEN 0 THEN 'edge_cell' WHEN 1 THEN 'debris' WHEN 2 THEN 'bad' WHEN 3 THEN 'good' END AS qc, l_extendedprice AS area, l_quantity AS contrast FROM j),
q AS (SELECT k, quantile_cont(contrast, 0.25) AS q FROM o WHERE side = 'matched_ref_sample' GROUP BY ALL),
w AS (SELECT k, {SIDES}, avg((qc IS DISTINCT FROM 'good')::INT) FILTER (side = 'only_A') AS rr, avg((qc IS DISTINCT FROM 'good')::INT) FILTER (side = 'matched_ref_sample') AS rk, avg((contrast < q)::INT) FILTER (side = 'only_A') AS rl, avg((contrast < q)::INT) FILTER (side = 'only_B') AS al,
median(area) FILTER (side = 'only_B') AS aa, median(contrast) FILTER (side = 'only_A') AS rc FROM o JOIN q USING (k) GROUP BY ALL)
SELECT f.* EXCLUDE (s, sm), round((n_b - n_a) / n_a, 6) AS count_change, round(matched / n_a, 6) AS matched_share, round((good_b - good_a) / good_a, 6) AS good_change, round(good_matched_both / good_a, 6) AS good_both_share, round(s, 2) AS seconds_median, round(sm, 2) AS seconds_mean,
round(iou, 6) AS iou_median, round(p5, 6) AS iou_p5, round(iou90, 6) AS iou_90, round(da, 6) AS area_change, round(daa, 6) AS area_change_abs, round(dl, 6) AS length_change, round(dla, 6) AS length_change_abs,
w.* EXCLUDE (k, rr, rk, rl, al, aa, rc), round(rr, 6) AS removed_reject_rate, round(rk, 6) AS kept_reject_rate, round(rl, 6) AS removed_low_contrast, round(al, 6) AS added_low_contrast, round(aa, 2) AS added_area_median, round(rc, 6) AS removed_contrast_median
FROM f JOIN m USING (k) JOIN w USING (k)""")
def d26_compare_report(spark, d):
    o = table(spark, d, "orders")
    names = {"n_a": "o_custkey", "n_b": "o_custkey % 100", "matched": "o_custkey % 50", "only_a": "o_orderkey % 7", "only_b": "o_orderkey % 5", "splits": "o_orderkey % 3", "merges": "o_orderkey % 2"}
    names |= {"good_a": "o_custkey % 20", "good_b": "o_custkey % 10", "good_matched_both": "o_custkey % 8", "seconds": "o_totalprice"}
    fields = o.selectExpr("o_orderpriority AS k", *[f"{v} AS {k}" for k, v in names.items()])
    l = table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_quantity", "l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")
    j = l.join(o.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
    j = materialize(j, "compared")  # read by each count and percentile, joined once
    m = j.selectExpr("o_orderpriority AS k", "l_discount * 10 AS iou", "l_quantity * 1000 AS area_a", "l_extendedprice AS area_b", "l_linenumber * 5.0D AS length_a", "l_quantity + 1 AS length_b")
    side = "CASE l_partkey % 3 WHEN 0 THEN 'matched_ref_sample' WHEN 1 THEN 'only_A' ELSE 'only_B' END AS side"
    qc = "CASE l_suppkey % 5 WHEN 0 THEN 'edge_cell' WHEN 1 THEN 'debris' WHEN 2 THEN 'bad' WHEN 3 THEN 'good' END AS qc"
    x = evaluation.compare_report(fields, m, j.selectExpr("o_orderpriority AS k", side, qc, "l_extendedprice AS area", "l_quantity AS contrast"), ["k"])
    counts = [c for c in x.columns if c in names or c.split("_", 1)[0] in ("kept", "removed", "added") and c.split("_", 1)[1] in evaluation.VERDICTS]
    shares = ["count_change", "matched_share", "good_change", "good_both_share", "iou_median", "iou_p5", "iou_90", "area_change", "area_change_abs", "length_change", "length_change_abs"]
    shares += ["removed_reject_rate", "kept_reject_rate", "removed_low_contrast", "added_low_contrast", "removed_contrast_median"]
    return x.select("k", "fields", *counts, *[r(F.col(c)).alias(c) for c in shares], *[r(F.col(c), 2).alias(c) for c in ("seconds_median", "seconds_mean", "added_area_median")])


def _keyed(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("id")).distinct().selectExpr("id", "concat(' K', id % 5, ' ') AS key")


def _mapping(spark, d, size: int):
    return _keyed(spark, d).selectExpr("lower(trim(key)) AS key", "id % 5 AS k").distinct().filter("k < 4").selectExpr("key", f"k % {size} AS grp")


@query("""WITH e AS (SELECT DISTINCT label AS id, label % 5 AS k FROM embeddings), g AS (SELECT id, k, CASE WHEN k < 4 THEN k % 3 END AS grp FROM e), s AS (SELECT grp, count(DISTINCT k) AS n FROM g WHERE grp IS NOT NULL GROUP BY ALL)
SELECT count(*) FILTER (n > 1) AS n, count(*) FILTER (g.grp IS NULL) AS dropped_unmapped, count(*) FILTER (n = 1) AS dropped_single FROM g LEFT JOIN s ON g.grp = s.grp""")
def e6_admit(spark, d):
    return evaluation.admit(_keyed(spark, d), _mapping(spark, d, 3), "key", "cross_gene")[1]


@query(f"""WITH {RANKED}, u AS (SELECT 'three' AS grouping, 'cross_gene' AS scope, i, j, d FROM dist WHERE i % 5 <> j % 5 AND i % 5 IN (0, 3) AND j % 5 IN (0, 3) UNION ALL
SELECT 'two', 'cross_gene', i, j, d FROM dist WHERE i % 5 <> j % 5 AND i % 5 < 4 AND j % 5 < 4 UNION ALL SELECT '(replicate)', 'replicate', i, j, d FROM dist),
h AS (SELECT *, CASE grouping WHEN '(replicate)' THEN i % 5 = j % 5 WHEN 'two' THEN (i % 5) % 2 = (j % 5) % 2 ELSE true END::INT AS hit, row_number() OVER (PARTITION BY grouping, i ORDER BY d, j) AS rank FROM u),
a AS (SELECT *, sum(hit) OVER (PARTITION BY grouping, i ORDER BY rank) AS hits FROM h), q AS (SELECT grouping, scope, i, avg(hits / rank) FILTER (hit = 1) AS ap, avg(hit) FILTER (rank <= 5) AS knn FROM a GROUP BY ALL HAVING max(hit) = 1),
e AS (SELECT DISTINCT label AS id FROM embeddings)
SELECT grouping, scope, round(avg(ap), 6) AS map, round(avg(knn), 6) AS knn, count(*) AS n, CASE WHEN scope = 'replicate' THEN 0 ELSE (SELECT count(*) FROM e WHERE id % 5 = 4) END AS dropped_unmapped,
CASE WHEN grouping = 'three' THEN (SELECT count(*) FROM e WHERE id % 5 IN (1, 2)) ELSE 0 END AS dropped_single FROM q GROUP BY ALL""")
def g13_score_source(spark, d):
    s = evaluation.score_source(distances(spark, d), "euclidean", _keyed(spark, d), {"three": _mapping(spark, d, 3), "two": _mapping(spark, d, 2)})
    return s.withColumn("map", r(F.col("map"))).withColumn("knn", r(F.col("knn")))


@query(f"""WITH {SSCORE.replace("FROM prof UNPIVOT", "FROM (SELECT * FROM prof WHERE regexp_matches(cond, '\\bL0\\b') OR left(cond, 2) IN ('AF', 'NO')) UNPIVOT")},
t AS (SELECT feature, max(score) - min(score) AS spread FROM scored WHERE NOT regexp_matches(cond, '\\bL0\\b') GROUP BY ALL ORDER BY spread DESC, feature LIMIT 4)
SELECT run_id, cond, feature, round(score, 4) AS score, round(spread, 4) AS spread FROM scored JOIN t USING (feature)""")
def g15_compare_genes(spark, d):
    x = evaluation.compare_genes(
        cell_profiles(spark, d), F.substring("cond", 1, 2), ["af", " NO "], L.is_control(F.col("cond"), ["l0"]), ["run_id", "cond"], ["length", "length_CV", "area", "area_CV", "width", "width_CV"], 4
    )
    return x.withColumn("score", r(F.col("score"), 4)).withColumn("spread", r(F.col("spread"), 4))


def _pixels(spark, d):
    px = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v0"))
    return px.selectExpr("vec_id", "i div 8 AS y", "i % 8 AS x", "cast(v0 AS double) + 1 AS value")


STEPS = ("nv", "br", "vf", "sml", "lv", "tg")
SMOOTHED = ", ".join(f"CASE WHEN count(*) OVER s < 3 THEN {c} ELSE (coalesce(lag({c}) OVER o, {c}) + 2 * {c} + coalesce(lead({c}) OVER o, {c})) / 4 END AS {c}" for c in STEPS)
SCALED = " + ".join(f"CASE WHEN max({c}) OVER s - min({c}) OVER s < 1e-12 THEN 0 ELSE ({c} - min({c}) OVER s) / (max({c}) OVER s - min({c}) OVER s) END" for c in STEPS)


@query(f"""WITH {GRAD}, f AS (SELECT *, lead(v, 1) OVER c AS y1, lead(v, 2) OVER c AS y2, lag(v) OVER c AS y_1, lead(v) OVER r AS x1, lag(v) OVER r AS x_1 FROM g3 WINDOW c AS (PARTITION BY vec_id, x ORDER BY y), r AS (PARTITION BY vec_id, y ORDER BY x)),
m AS (SELECT image AS stack, z, CASE WHEN avg(v) > 0 THEN var_pop(v) / avg(v) ELSE 0 END AS nv, sum((y2 - v) * (y2 - v)) AS br, sum(v * y1) - sum(v * y2) AS vf,
coalesce(sum(abs(2 * v - y1 - y_1)), 0) + coalesce(sum(abs(2 * v - x1 - x_1)), 0) AS sml, var_pop(lap) AS lv, sum(gx * gx + gy * gy) AS tg FROM f GROUP BY image, z),
w AS (SELECT stack, z, {SMOOTHED} FROM m WINDOW s AS (PARTITION BY stack), o AS (PARTITION BY stack ORDER BY z)),
e AS (SELECT stack, z, ({SCALED}) / 6 AS score FROM w WINDOW s AS (PARTITION BY stack)),
t AS (SELECT *, max(score) OVER s AS best, (count(*) OVER s - 1) / 2 AS mid FROM e WINDOW s AS (PARTITION BY stack)), p AS (SELECT stack, min_by(z, (abs(z - mid), z)) AS zb FROM t WHERE score >= best - 1e-12 GROUP BY stack)
SELECT stack, z, round(score, 5) AS score, z = zb AS chosen FROM e JOIN p USING (stack)""")
def h8_score_stack(spark, d):
    """All six metrics of each plane, smoothed along z."""
    px = pixels(spark, d, "vec_id % 50").withColumnRenamed("image", "stack")
    key = ["stack", "z"]
    m = px_metrics.focus_metrics(px, key).join(focus.sharpness(px, key).select(*key, "laplacian_variance", "tenengrad"), key)
    s = evaluation.score_stack(m, ["stack"], "z", ["normalized_variance", "brenner", "vollath_f4", "sml", "laplacian_variance", "tenengrad"], smooth=True)
    return s.select("stack", "z", r(F.col("score"), 5).alias("score"), "chosen")


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY fov ORDER BY p_retailprice DESC, spot) AS k FROM (SELECT b.*, p.p_retailprice, row_number() OVER (PARTITION BY fov ORDER BY b.p_partkey) AS spot FROM boxes b JOIN part p ON b.p_partkey = p.p_partkey)),
s AS (SELECT DISTINCT fov, 0 AS k, CAST([] AS STRUCT(key BIGINT, y BIGINT, x BIGINT)[]) AS kept FROM o UNION ALL
SELECT o.fov, o.k, CASE WHEN len(list_filter(s.kept, lambda q: (q.y - o.y0) * (q.y - o.y0) + (q.x - o.x0) * (q.x - o.x0) < 3600)) = 0 THEN list_append(s.kept, {{'key': o.spot, 'y': o.y0, 'x': o.x0}}) ELSE s.kept END FROM s JOIN o ON o.fov = s.fov AND o.k = s.k + 1)
SELECT fov, unnest(kept).key AS spot FROM (SELECT fov, max_by(kept, k) AS kept FROM s GROUP BY fov)""")
def h17_suppress_points(spark, d):
    """Spots are numbered anew in every field, so that their numbers repeat over the fields."""
    b = boxes(spark, d).withColumn("spot", F.row_number().over(Window.partitionBy("fov").orderBy("p_partkey")))
    return evaluation.suppress_points(b, ["fov"], "spot", "y0", "x0", "p_retailprice", 60.0).select("fov", F.col("spot").cast("long").alias("spot"))


@query(f"""WITH {PIXELS}, v AS (SELECT vec_id, sum(v) FILTER (y = 0 AND x = 1) - 2 * sum(v) FILTER (y = 1 AND x = 1) + sum(v) FILTER (y = 2 AND x = 1) AS yy, sum(v) FILTER (y = 1 AND x = 0) - 2 * sum(v) FILTER (y = 1 AND x = 1) + sum(v) FILTER (y = 1 AND x = 2) AS xx,
(sum(v) FILTER (y = 2 AND x = 2) - sum(v) FILTER (y = 2 AND x = 0) - sum(v) FILTER (y = 0 AND x = 2) + sum(v) FILTER (y = 0 AND x = 0)) / 4 AS xy FROM px GROUP BY ALL),
g AS (SELECT vec_id, (yy + xx) / 2 AS m, sqrt((yy - xx) * (yy - xx) / 4 + xy * xy) AS g FROM v)
SELECT vec_id, round(CASE WHEN greatest(abs(m + g), abs(m - g)) < 1e-12 THEN 0 ELSE least(abs(m + g), abs(m - g)) / greatest(abs(m + g), abs(m - g)) END, 6) AS symmetry FROM g""")
def h20_hessian_symmetry(spark, d):
    return evaluation.hessian_symmetry(_pixels(spark, d), ["vec_id"], "value").withColumn("symmetry", r(F.col("symmetry")))


@query(f"""WITH {PIXELS}, b AS (SELECT vec_id, median(v) AS bg FROM px WHERE y IN (0, 7) OR x IN (0, 7) GROUP BY ALL), w AS (SELECT px.vec_id, y, x, v - bg AS w, max(v - bg) OVER (PARTITION BY px.vec_id) AS top FROM px JOIN b USING (vec_id)),
c AS (SELECT * FROM w WHERE top > 0 AND w >= top / 2), m AS (SELECT vec_id, count(*) AS n, sum(w) AS t, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx FROM c GROUP BY ALL),
s AS (SELECT vec_id, any_value(n) AS n, sum(w * (y - my) ** 2) / sum(w) AS a, sum(w * (x - mx) ** 2) / sum(w) AS b, sum(w * (y - my) * (x - mx)) / sum(w) AS c FROM c JOIN m USING (vec_id) GROUP BY ALL),
e AS (SELECT *, (a + b + sqrt((a - b) ** 2 + 4 * c * c)) / 2 AS hi, (a + b - sqrt((a - b) ** 2 + 4 * c * c)) / 2 AS lo FROM s)
SELECT e0.vec_id, round(CASE WHEN n >= 5 AND lo > 1e-9 THEN hi / lo ELSE 1 END, 4) AS elongation FROM embeddings e0 LEFT JOIN e ON e.vec_id = e0.vec_id""")
def h21_core_elongation(spark, d):
    e = evaluation.core_elongation(_pixels(spark, d), ["vec_id"], "value")
    return e.withColumn("elongation", r(F.col("elongation"), 4))
