"""Queries on points, channels, names and scores, with their SQL. Roles as in registry.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import models, ranking, sites, summaries
from ..sources import tables
from .library import distances
from .registry import PIXELS, RANKED, query, r, table
from .summaries import pixels

SITES = f"{PIXELS}, st AS (SELECT vec_id, 2 + vec_id % 5 AS sy, 1 + vec_id % 6 AS sx FROM embeddings), n AS (SELECT st.vec_id, y - sy AS dy, x - sx AS dx, v FROM st JOIN px ON px.vec_id = st.vec_id)"


def points(spark, d):
    return table(spark, d, "embeddings").selectExpr("vec_id AS image", "1 AS site", "cast(2 + vec_id % 5 AS int) AS y", "cast(1 + vec_id % 6 AS int) AS x")


@query(f"""WITH {SITES}, a AS (SELECT vec_id, count(*) FILTER (greatest(abs(dy), abs(dx)) <= 2) AS n, max(v) FILTER (greatest(abs(dy), abs(dx)) <= 1) - median(v) FILTER (greatest(abs(dy), abs(dx)) = 2) AS a FROM n GROUP BY ALL)
SELECT vec_id AS image, CASE WHEN n = 25 THEN round(a, 5) END AS amplitude FROM a""")
def h18_peak_amplitude(spark, d):
    return sites.peak_amplitude(pixels(spark, d), points(spark, d), ["image"], 2, 1).select("image", r(F.col("amplitude"), 5).alias("amplitude"))


@query(f"""WITH {SITES}, a AS (SELECT vec_id, max(v) FILTER (dy = 0 AND dx = 0) AS peak, median(v) FILTER (dy * dy + dx * dx BETWEEN 4 AND 16) AS m, stddev_pop(v) FILTER (dy * dy + dx * dx BETWEEN 4 AND 16) AS s FROM n GROUP BY ALL)
SELECT vec_id AS image, round((peak - m) / s, 4) AS snr FROM a""")
def h19_annulus_snr(spark, d):
    return sites.annulus_snr(pixels(spark, d), points(spark, d), ["image"], 1.0).select("image", r(F.col("snr"), 4).alias("snr"))


CHANNELS = """c AS (SELECT l_returnflag AS scene, l_linenumber AS channel, l_extendedprice AS v FROM lineitem), m AS (SELECT scene, channel, avg(v) AS mean, stddev_pop(v) AS std, median(v) AS med FROM c GROUP BY ALL),
s AS (SELECT c.scene, c.channel, any_value(mean) AS mean, any_value(std) AS std, avg(((v - mean) / std) ** 3) AS skew, avg((abs(v - med) <= greatest(0.05 * abs(med), 1))::INT) AS near FROM c JOIN m ON m.scene = c.scene AND m.channel = c.channel GROUP BY ALL)"""


def channels(spark, d):
    return sites.channel_stats(table(spark, d, "lineitem").selectExpr("l_returnflag AS scene", "l_linenumber AS channel", "l_extendedprice AS value"), ["scene", "channel"])


@query(f"WITH {CHANNELS} SELECT scene, channel, round(mean, 3) AS mean, round(std, 3) AS std, round(skew, 5) AS skew, round(near, 6) AS near_background FROM s")
def d23_channel_stats(spark, d):
    return channels(spark, d).select("scene", "channel", r(F.col("mean"), 3).alias("mean"), r(F.col("std"), 3).alias("std"), r(F.col("skew"), 5).alias("skew"), r(F.col("near_background")).alias("near_background"))


@query(f"""WITH {CHANNELS.replace("SELECT l_returnflag AS scene", "SELECT l_returnflag || l_suppkey % 2 AS scene")}, a AS (SELECT left(scene, 1) AS source, channel, avg(abs(skew)) AS skew, avg(near) AS near FROM s GROUP BY ALL)
SELECT source, min_by(channel, (round_even(skew, 1), -near, channel)) AS channel FROM a GROUP BY source""")
def d23_pick_phase(spark, d):
    """Two scenes of each source."""
    px = table(spark, d, "lineitem").selectExpr("l_returnflag AS source", "l_suppkey % 2 AS scene", "l_linenumber AS channel", "l_extendedprice AS value")
    return sites.pick_phase(sites.channel_stats(px, ["source", "scene", "channel"]), ["source"], "channel")


@query(f"""WITH {SITES}, a AS (SELECT vec_id, max(v) FILTER (dy = 0 AND dx = 0) AS peak, median(v) FILTER (dy * dy + dx * dx > 4) AS m, stddev_pop(v) FILTER (dy * dy + dx * dx > 4) AS s FROM n WHERE abs(dy) <= 3 AND abs(dx) <= 3 GROUP BY ALL)
SELECT vec_id AS image, round((peak - m) / s, 4) AS snr FROM a""")
def h19_patch_snr(spark, d):
    return sites.patch_snr(pixels(spark, d), points(spark, d), ["image"], 3).select("image", r(F.col("snr"), 4).alias("snr"))


@query(f"""WITH {RANKED}, h AS (SELECT i, rank, (i % 3 = j % 3)::INT AS hit, sum((i % 3 = j % 3)::INT) OVER (PARTITION BY i ORDER BY rank) AS hits FROM ranked),
q AS (SELECT i, avg(hits / rank) FILTER (hit = 1) AS ap, avg(hit) FILTER (rank <= 5) AS knn FROM h GROUP BY ALL) SELECT CAST(i % 3 AS INTEGER) AS grp, round(avg(ap), 6) AS map, round(avg(knn), 6) AS knn, count(*) AS n FROM q GROUP BY ALL""")
def d27_score_summary(spark, d):
    groups = table(spark, d, "embeddings").select(F.col("label").alias("id")).distinct().withColumn("grp", F.col("id") % 3)
    q = ranking.rank_metrics(distances(spark, d), "euclidean", groups, 5).withColumn("grp", (F.col("id") % 3).cast("int"))
    return summaries.score_summary(q, ["grp"], [F.desc("map")]).select("grp", r(F.col("map")).alias("map"), r(F.col("knn")).alias("knn"), "n")


@query("SELECT DISTINCT trim(t) AS token FROM (SELECT unnest(string_split(p_type || ', ' || p_brand || ',,' || p_type, ',')) AS t FROM part) WHERE trim(t) <> ''")
def b9_control_tokens(spark, d):
    return table(spark, d, "part").select(F.explode(L.control_tokens(F.concat("p_type", F.lit(", "), "p_brand", F.lit(",,"), "p_type"))).alias("token")).distinct()


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type || CASE WHEN p_size % 2 = 0 THEN '_' || p_size ELSE '' END ELSE p_name END AS label FROM part""")
def b23_class_label(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_brand) ELSE '' END AS g", "CASE WHEN p_partkey % 3 = 1 THEN p_type ELSE ' ' END AS dr", "CASE WHEN p_size % 2 = 0 THEN cast(p_size AS string) ELSE '' END AS c", "p_name")
    return p.select("p_partkey", L.class_label(F.col("g"), F.col("dr"), F.col("c"), F.col("p_name")).alias("label"))


@query("SELECT 'run' || p_size AS run_id, count(*) AS n FROM part GROUP BY ALL")
def b29_run_id_of(spark, d):
    p = table(spark, d, "part").selectExpr("concat('/data/run', p_size, CASE p_partkey % 3 WHEN 0 THEN '/04_features' WHEN 1 THEN '\\\\features' ELSE '' END, '/f.parquet') AS path")
    return p.groupBy(L.run_id_of(F.col("path")).alias("run_id")).agg(F.count("*").alias("n"))


@query("""WITH inv AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'r/f' || s_nationkey ELSE 'r/sub/f' || s_nationkey END AS path FROM supplier WHERE s_nationkey < 20), own AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'r/sub/f' || c_nationkey ELSE 'old/f' || c_nationkey END AS path FROM customer)
SELECT c_custkey, coalesce(inv.path, (SELECT min_by(i.path, (length(i.path) - length(replace(i.path, '/', '')), i.path)) FROM inv i WHERE string_split(i.path, '/')[-1] = string_split(own.path, '/')[-1])) AS found FROM own LEFT JOIN inv ON inv.path = own.path""")
def b22_remap(spark, d):
    inv = table(spark, d, "supplier").filter("s_nationkey < 20").selectExpr("CASE WHEN s_suppkey % 2 = 0 THEN concat('r/f', s_nationkey) ELSE concat('r/sub/f', s_nationkey) END AS path")
    own = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 4 = 0 THEN concat('r/sub/f', c_nationkey) ELSE concat('old/f', c_nationkey) END AS path")
    return tables.remap(own, inv, "path").select("c_custkey", "found")


@query("SELECT o_orderkey, 'm1' AS model_key, round(o_totalprice / 1000000, 6) AS p FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def g12_score_missing(spark, d):
    cache = table(spark, d, "lineitem").selectExpr("l_orderkey AS o_orderkey", "'m1' AS model_key")
    return models.score_missing(table(spark, d, "orders"), cache, "o_orderkey", "m1", lambda t: t.withColumn("p", r(F.col("o_totalprice") / 1000000)))
