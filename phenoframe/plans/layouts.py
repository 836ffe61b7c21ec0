"""Queries on layouts, samples and outlines, with their SQL. Roles as in registry.py; part rows are also scenes of plates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import shapes
from ..operators import layout, sampling
from .registry import BOXES, boxes, query, r, table

WELLS = "w AS (SELECT p_partkey, p_brand, p_type, p_size, CAST(p_size % 8 AS INTEGER) AS row, CAST(p_partkey % 12 AS INTEGER) AS col, chr(CAST(65 + p_size % 8 AS INTEGER)) || (p_partkey % 12 + 1) AS well FROM part)"


def wells(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "p_brand", "p_type", "p_size", "concat(lower(chr(65 + p_size % 8)), '0', p_partkey % 12 + 1) AS well")


@query("""SELECT c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' ATc' ELSE '' END END AS label, count(*) AS n FROM customer GROUP BY ALL""")
def b2_condition_label(spark, d):
    c = table(spark, d, "customer").selectExpr("c_nationkey AS nation", "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS m", "CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN ' ATc ' ELSE '' END AS t", "c_name")
    return c.groupBy("nation", L.condition_label(F.col("m"), F.col("t"), F.col("c_name")).alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN p_partkey % 2 = 0 THEN 'g' || p_size ELSE string_split(p_type, ' ')[1] END AS gene, count(*) AS n FROM part GROUP BY ALL""")
def b3_gene_of(spark, d):
    label = table(spark, d, "part").selectExpr("CASE WHEN p_partkey % 2 = 0 THEN concat('c__r__g', p_size, '_focused__R1') ELSE concat(' ', p_type, ' 10x') END AS label")
    return label.groupBy(L.gene_of(F.col("label")).alias("gene")).agg(F.count("*").alias("n"))


@query(f"""WITH {WELLS}, b AS (SELECT p_brand, min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max FROM w GROUP BY ALL)
SELECT *, CASE WHEN row_max < 2 AND col_max < 3 THEN 2 WHEN row_max < 4 AND col_max < 6 THEN 4 WHEN row_max < 6 AND col_max < 8 THEN 6 ELSE 8 END AS n_rows,
CASE WHEN row_max < 2 AND col_max < 3 THEN 3 WHEN row_max < 4 AND col_max < 6 THEN 6 WHEN row_max < 6 AND col_max < 8 THEN 8 ELSE 12 END AS n_cols FROM b""")
def b5_plate_bounds(spark, d):
    return layout.plate_bounds(wells(spark, d), ["p_brand"], "well")


@query(f"""WITH {WELLS}, b AS (SELECT p_brand, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM w GROUP BY ALL)
SELECT p_brand, chr(CAST(65 + y.i AS INTEGER)) || (x.i + 1) AS well FROM b, range(8) y(i), range(12) x(i) WHERE y.i BETWEEN r0 AND r1 AND x.i BETWEEN c0 AND c1""")
def b5_plate_grid(spark, d):
    return layout.plate_grid(layout.plate_bounds(wells(spark, d), ["p_brand"], "well"), ["p_brand"])


@query("SELECT p_partkey, p_size + p_partkey AS total, 2 AS n FROM part")
def b6_parse_int_list(spark, d):
    raw = table(spark, d, "part").selectExpr("p_partkey", "concat('[', p_size, '; x,', p_partkey, ' y]') AS raw").withColumn("l", L.parse_int_list(F.col("raw")))
    return raw.select("p_partkey", F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("l").alias("n"))


@query("SELECT 'run' || (l_suppkey % 4) || '__A1__' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '__' || lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') AS uid, count(*) AS n FROM lineitem GROUP BY ALL")
def b12_cell_uid(spark, d):
    uid = L.cell_uid(F.concat(F.lit("run"), (F.col("l_suppkey") % 4).cast("string")), F.lit("A1"), F.col("l_linenumber"), F.col("l_partkey") % 100000)
    return table(spark, d, "lineitem").groupBy(uid.alias("uid")).agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag AS k, count(*) AS n, round(avg(l_extendedprice - l_quantity), 4) AS amplitude, round(avg(CASE WHEN l_quantity < 1e-9 THEN 0 ELSE l_discount / l_quantity END), 6) AS variation,
round(avg(4 * l_extendedprice / (pi() * l_quantity * l_quantity)), 4) AS roundness, round(avg(4 * pi() * l_quantity / (l_extendedprice * l_extendedprice)), 6) AS circularity FROM lineitem GROUP BY ALL""")
def b13_shape_ratios(spark, d):
    x = table(spark, d, "lineitem").selectExpr(
        "l_returnflag AS k", "l_extendedprice AS width_max_um", "l_quantity AS width_min_um", "l_discount AS width_std_um", "l_quantity AS width_mean_um", "l_extendedprice AS length_um",
        "l_quantity AS width_median_um", "l_quantity AS area_um2_subpixel", "l_extendedprice AS perimeter_um_subpixel", "l_extendedprice AS area_um2", "l_quantity AS feret_diameter_max_um",
    )
    s = shapes.shape_ratios(x)
    return s.groupBy("k").agg(F.count("*").alias("n"), r(F.avg("width_amplitude_um"), 4).alias("amplitude"), r(F.avg("width_variation")).alias("variation"),
                              r(F.avg("roundness"), 4).alias("roundness"), r(F.avg("circularity_subpixel")).alias("circularity"))


@query(f"WITH {BOXES} SELECT p_partkey, greatest(y0 - 4, 0) AS y0, greatest(x0 - 4, 0) AS x0, least(y1 + 4, 540) AS y1, least(x1 + 4, 540) AS x1 FROM boxes")
def b30_crop_window(spark, d):
    b = boxes(spark, d)
    return b.select("p_partkey", shapes.crop_window(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1"), 4, 540, 540).alias("w")).select("p_partkey", "w.*")


@query(f"WITH {WELLS} SELECT p_brand, well, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1")
def a9_duplicate_wells(spark, d):
    return layout.duplicate_wells(wells(spark, d), ["p_brand"], "well")


@query("""SELECT p_brand || '__' || p_type AS stem, count(*) AS n, array_to_string(list('f' || (p_partkey % 50) ORDER BY p_partkey), ';') AS paths, count(*) - count(DISTINCT p_partkey % 50) AS repeated FROM part WHERE p_size > 10 GROUP BY ALL""")
def a10_pool_samples(spark, d):
    sheet = table(spark, d, "part").selectExpr("p_partkey AS row", "concat('f', p_partkey % 50) AS path", "CASE WHEN p_size > 10 THEN concat(p_brand, '__', p_type) ELSE ' ' END AS name")
    p = layout.pool_samples(sheet, F.col("name"), "path", "row")
    return p.select("stem", F.size("paths").cast("long").alias("n"), F.array_join("paths", ";").alias("paths"), F.col("repeated").cast("long").alias("repeated"))


@query("""SELECT c_nationkey AS path FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey < 20
UNION ALL SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey < 20)""")
def a11_add_files(spark, d):
    old = table(spark, d, "customer").filter("c_custkey % 2 = 0 AND c_nationkey < 20").selectExpr("c_nationkey AS path")
    return layout.add_files(old, table(spark, d, "supplier").selectExpr("s_nationkey AS path"), "path")


@query("""SELECT o_orderpriority AS k, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') AS kept, count(*) AS n FROM orders GROUP BY ALL""")
def c6_keep_expected(spark, d):
    stems = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey AS o_custkey")
    kept, stale = layout.keep_expected(table(spark, d, "orders").select("o_custkey", "o_orderpriority"), stems, "o_custkey")
    both = kept.withColumn("kept", F.lit(True)).unionByName(stale.withColumn("kept", F.lit(False)))
    return both.groupBy(F.col("o_orderpriority").alias("k"), "kept").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'R' || n_regionkey ELSE n_name END AS well, CASE WHEN n_regionkey % 2 = 0 THEN 'x__R' || n_regionkey || '__' || c_custkey ELSE 'x__' || n_name || '__' || c_custkey END AS uid
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def c5_rewrite_keys(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("n_name AS well", "concat('x__', n_name, '__', c_custkey) AS uid")
    renames = n.filter("n_regionkey % 2 = 0").selectExpr("n_name AS old", "concat('R', n_regionkey) AS new")
    return layout.rewrite_keys(c, renames, "well", "old", "new", ["well", "uid"]).select("well", "uid")


@query("""WITH lay AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS source, p_size AS scene, min(p_type) AS stem FROM part GROUP BY ALL),
art AS (SELECT p_type AS stem, p_brand AS source, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS scene FROM part),
m AS (SELECT art.stem, art.scene, coalesce(e.stem, l.stem) AS expected FROM art LEFT JOIN lay e ON e.source = art.source AND e.scene = art.scene LEFT JOIN lay l ON l.source IS NULL AND l.scene = art.scene)
SELECT stem, expected, CASE WHEN scene IS NULL THEN 'no sidecar' WHEN expected IS NULL THEN 'no match' WHEN expected = stem THEN 'correct' ELSE 'to rename' END AS bucket, count(*) AS n FROM m GROUP BY ALL""")
def c4_relabel_plan(spark, d):
    p = table(spark, d, "part")
    lay = p.selectExpr("CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS source", "array(p_size, p_size + 1000, p_size) AS scenes", "p_type AS stem")
    art = p.selectExpr("p_type AS stem", "p_brand AS source", "CASE WHEN p_partkey % 7 <> 0 THEN array(p_size + 1000, p_size) END AS scenes")
    return layout.relabel_plan(lay, art).groupBy("stem", "expected", "bucket").agg(F.count("*").alias("n"))


@query(f"""WITH {WELLS}, f AS (SELECT well, p_brand AS source, min(p_partkey) AS first, array_to_string(list_sort(list(DISTINCT p_size)), ';') AS scenes FROM w GROUP BY ALL)
SELECT well, min_by(source, first) AS source, min_by(scenes, first) AS scenes, count(*) - 1 AS conflicts FROM f GROUP BY ALL""")
def e25_merge_sources(spark, d):
    m = layout.merge_sources(wells(spark, d), "well", "p_brand", "p_partkey", "p_size")
    return m.select("well", F.col("p_brand").alias("source"), F.array_join("scenes", ";").alias("scenes"), "conflicts")


@query("""SELECT a.p_type AS name, count(o_orderkey) AS n_scenes, coalesce(array_to_string(list(CAST(epoch(o_orderdate) AS BIGINT) ORDER BY p_partkey) FILTER (o_orderkey IS NOT NULL), ';'), '') AS times
FROM (SELECT DISTINCT p_type FROM part) a LEFT JOIN part p ON p.p_type = a.p_type AND p.p_type NOT LIKE 'PROMO%' LEFT JOIN orders ON o_orderkey = p_partkey GROUP BY ALL""")
def c16_backfill_times(spark, d):
    p = table(spark, d, "part")
    lay = p.filter("p_type NOT LIKE 'PROMO%'").groupBy(F.col("p_type").alias("stem")).agg(F.collect_list("p_partkey").alias("scenes"))  # a layout of scenes
    times = table(spark, d, "orders").selectExpr("o_orderkey AS scene", "cast(o_orderdate AS timestamp) AS time")
    arts = p.selectExpr("concat(p_type, '_focused') AS stem").distinct()
    b = layout.backfill_times(arts, lay, times).withColumn("t", F.transform("times", lambda t: t.cast("long")))
    return b.select(F.regexp_replace("stem", "_focused$", "").alias("name"), F.size("t").cast("long").alias("n_scenes"), F.array_join("t", ";").alias("times"))


LATEST = "cur AS (SELECT user_id, event_id, event_type, CASE WHEN user_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"


def current(spark, d):
    from ..operators.joins import latest

    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return latest(e, "user_id", "ts", "event_id").selectExpr("user_id", "event_id", "event_type", "CASE WHEN user_id % 3 = 0 THEN 'test' ELSE 'train' END AS split")


@query(f"WITH {LATEST} SELECT user_id, event_type, 'test' AS split FROM cur WHERE split <> 'test' AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def e2_restore_split(spark, d):
    ids = table(spark, d, "customer").filter("c_nationkey < 12").selectExpr("c_custkey AS user_id")
    return sampling.restore_split(current(spark, d), ids, "user_id", "test").select("user_id", "event_type", "split")


@query("""WITH best AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos FROM (SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 250)),
q AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS rnd, min(pos) OVER (PARTITION BY p_brand) AS f FROM best), z AS (SELECT *, row_number() OVER (ORDER BY rnd, f) AS place FROM q)
SELECT p_partkey, p_brand, CAST(place AS INTEGER) AS place FROM z WHERE place <= 50""")
def e12_diversify(spark, d):
    return sampling.diversify(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 50).select("p_partkey", "p_brand", "place")


SEEDED = "k AS (SELECT o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('5:' || o_orderkey), o_orderkey) AS rn FROM orders)"


@query(f"WITH {SEEDED} SELECT o_orderkey, o_orderpriority, f AS fraction FROM k, (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) v(f) WHERE rn <= greatest(round_even(n * f, 0), least(8, n))")
def e13_nested_subsets(spark, d):
    return sampling.nested_subsets(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", [0.1, 0.5], 5)


@query(f"""WITH {SEEDED} SELECT o_orderkey, CASE WHEN rn <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' WHEN rn <= round_even(n * 0.2::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM k""")
def e14_stratified_split(spark, d):
    return sampling.stratified_split(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 0.1, 0.2, 5).select("o_orderkey", "split")


@query("""WITH g AS (SELECT DISTINCT o_custkey FROM orders), k AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('9:' || o_custkey), o_custkey) AS rn, count(*) OVER () AS n FROM g)
SELECT o_orderkey, CASE WHEN rn <= greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS split FROM orders JOIN k ON k.o_custkey = orders.o_custkey""")
def e15_group_split(spark, d):
    return sampling.group_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.15, 9).select("o_orderkey", "split")


@query("""WITH h AS (SELECT * FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')), k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('2:' || doc_id), doc_id) AS rn FROM h)
SELECT doc_id, quality, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS place FROM k WHERE rn <= 15""")
def e17_consistency_sample(spark, d):
    present = table(spark, d, "documents").filter("lang <> 'en'")
    return sampling.consistency_sample(table(spark, d, "labels"), present, "quality", "doc_id", 30, True, 2).select("doc_id", "quality", "place")


OUTLINE = "v AS (SELECT user_id, event_id, value AS y, (event_id * 37 % 101)::DOUBLE AS x FROM events)"


def outlines(spark, d):
    return table(spark, d, "events").selectExpr("user_id", "event_id", "value AS y", "cast(event_id * 37 % 101 AS double) AS x")


@query(f"""WITH {OUTLINE}, n AS (SELECT *, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(CASE WHEN count(*) >= 3 THEN abs(sum(x * ny - nx * y)) / 2 ELSE 0 END, 3) AS area, round(sum(sqrt((ny - y) * (ny - y) + (nx - x) * (nx - x))), 4) AS perimeter FROM n GROUP BY ALL""")
def e21_polygon_measures(spark, d):
    return shapes.polygon_measures(outlines(spark, d), ["user_id"], "event_id", "y", "x").select("user_id", r(F.col("area"), 3).alias("area"), r(F.col("perimeter"), 4).alias("perimeter"))


@query(f"""WITH {OUTLINE}, s AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT s.user_id, s.i, s.n, a.y - b.y AS ty, a.x - b.x AS tx FROM s JOIN s a ON a.user_id = s.user_id AND a.i = (s.i + 1) % s.n JOIN s b ON b.user_id = s.user_id AND b.i = (s.i + s.n - 1) % s.n),
g AS (SELECT t.user_id, t.n, CASE WHEN t.n >= 4 THEN atan2(abs(t.tx * u.ty - t.ty * u.tx), t.tx * u.tx + t.ty * u.ty) END AS a FROM t JOIN t u ON u.user_id = t.user_id AND u.i = (t.i + 1) % t.n)
SELECT user_id, round(avg(a), 5) AS angularity_mean, round(max(a), 5) AS angularity_max, round(median(a), 5) AS angularity_median, round(stddev_pop(a), 5) AS angularity_std, round(max(a) - min(a), 5) AS angularity_amplitude,
round(stddev_pop(a) / avg(a), 5) AS angularity_variation FROM g GROUP BY ALL""")
def e22_angularity(spark, d):
    a = shapes.angularity(outlines(spark, d), ["user_id"], "event_id", "y", "x")
    return a.select("user_id", *[r(F.col(c), 5).alias(c) for c in a.columns if c != "user_id"])
