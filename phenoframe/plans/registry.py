"""The registered queries over the driver's tables and the SQL they are compared with.

Roles: lineitem rows are cells, part rows wells and boxes, events a label log, embeddings vectors and pixel grids, documents
and labels rated items, customer and supplier two runs, nation and region a group table. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import filters, joins, pixels, profiles, ranking
from ..sources import tables
from ..streaming.labels import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "d2_sscore"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column, digits: int = 6):
    return F.round(column, digits)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as cells of 12 conditions in 4 runs; the conditions that begin with R-O are controls."""
    c = table(spark, sf_dir, "lineitem")
    run = F.concat(F.lit("run"), (F.col("l_suppkey") % 4).cast("string"))
    cond = F.concat_ws(" ", F.concat("l_returnflag", "l_linestatus"), F.concat(F.lit("L"), (F.col("l_linenumber") % 3).cast("string")))
    return c.select(
        run.alias("run_id"), cond.alias("cond"), F.col("l_quantity").alias("length"), F.col("l_extendedprice").alias("area"), F.col("l_discount").alias("width"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


CELLS = """cells AS (SELECT 'run' || (l_suppkey % 4) AS run_id, l_returnflag || l_linestatus || ' L' || (l_linenumber % 3) AS cond,
  l_quantity AS length, l_extendedprice AS area, l_discount AS width FROM lineitem)"""


@query("""SELECT 'customer' AS src, c_nationkey AS nation, count(*) AS n, round(avg(c_acctbal), 6) AS mean_bal, count(c_mktsegment) AS n_segment FROM customer GROUP BY ALL
UNION ALL SELECT 'supplier', s_nationkey, count(*), round(avg(s_acctbal), 6), 0 FROM supplier GROUP BY ALL""")
def a2_consolidate(spark, d):
    c = table(spark, d, "customer").selectExpr("'customer' AS src", "c_nationkey AS nation", "c_acctbal AS bal", "c_mktsegment AS segment")
    s = table(spark, d, "supplier").selectExpr("'supplier' AS src", "s_nationkey AS nation", "s_acctbal AS bal")
    both = tables.consolidate([c, s])
    return both.groupBy("src", "nation").agg(F.count("*").alias("n"), r(F.avg("bal")).alias("mean_bal"), F.count("segment").alias("n_segment"))


@query("""SELECT 'letter' AS scheme, lower(trim(n_name)) AS gene, substr(n_name, 1, 1) AS grp FROM nation
UNION ALL SELECT 'region', lower(trim(n_name)), CAST(n_regionkey AS VARCHAR) FROM nation""")
def a5_group_table(spark, d):
    wide = table(spark, d, "nation").selectExpr("n_name AS gene", "n_nationkey AS line_no", "cast(n_regionkey AS string) AS region", "substr(n_name, 1, 1) AS letter", "'x' AS _note")
    return tables.group_table(wide, "gene", "line_no")


STEM = """SELECT l_returnflag || '_focused__rep' || l_linenumber || '__' || CASE WHEN l_suppkey % 3 = 0 THEN 'WT1' ELSE 'gene' || (l_partkey % 7) || '_filtered' END ||
  CASE WHEN l_suppkey % 2 = 0 THEN '__R' || (l_suppkey % 4) ELSE '__x' END AS stem FROM lineitem"""


@query(f"""WITH s AS ({STEM}), p AS (SELECT string_split(stem, '__') AS a FROM s),
q AS (SELECT regexp_replace(a[1], '(_focused|_filtered)$', '') AS condition, regexp_replace(a[3], '(_focused|_filtered)$', '') AS mutant, a[4] AS last FROM p)
SELECT condition, mutant AS mutant_or_drug, CASE WHEN regexp_matches(last, '^R[0-9]+$') THEN last ELSE '' END AS replica, contains(lower(mutant), 'wt') AS is_control,
CASE WHEN contains(lower(mutant), 'wt') THEN '' ELSE mutant END AS gene, count(*) AS n FROM q GROUP BY ALL""")
def b1_parse_stem(spark, d):
    mutant = "CASE WHEN l_suppkey % 3 = 0 THEN 'WT1' ELSE concat('gene', l_partkey % 7, '_filtered') END"
    last = "CASE WHEN l_suppkey % 2 = 0 THEN concat('__R', l_suppkey % 4) ELSE '__x' END"
    stem = table(spark, d, "lineitem").selectExpr(f"concat(l_returnflag, '_focused__rep', l_linenumber, '__', {mutant}, {last}) AS stem")
    p = stem.select(L.parse_stem(F.col("stem")).alias("p")).select("p.*")
    return p.groupBy("condition", "mutant_or_drug", "replica", "is_control", "gene").agg(F.count("*").alias("n"))


@query("""SELECT chr(CAST(65 + p_size % 8 AS INTEGER)) || (p_partkey % 12 + 1) AS well, count(*) AS n FROM part GROUP BY ALL""")
def b4_norm_well(spark, d):
    raw = table(spark, d, "part").selectExpr("concat(' ', lower(chr(65 + p_size % 8)), '0', p_partkey % 12 + 1, ' ') AS raw")
    return raw.groupBy(L.norm_well(F.col("raw")).alias("well")).agg(F.count("*").alias("n"))


@query("""SELECT p_brand || ' ' || p_type AS label, count(*) AS n FROM part GROUP BY ALL""")
def b7_strip_replicate(spark, d):
    raw = table(spark, d, "part").selectExpr("concat(p_brand, '_R', p_size, ' ', p_type, ' r2') AS raw")
    return raw.groupBy(L.strip_replicate(F.col("raw")).alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT regexp_matches(lower(p_name), '\\b(?:blue|part 1|small)\\b') OR regexp_matches(lower(p_type), '\\b(?:blue|part 1|small)\\b') AS hit, count(*) AS n FROM part GROUP BY ALL""")
def b8_control_match(spark, d):
    words = ["Blue", "part 1", "SMALL"]
    hit = L.is_control(F.col("p_name"), words) | L.is_control(F.col("p_type"), words)
    return table(spark, d, "part").groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, round(greatest(0, least(1, (ln(greatest(p_retailprice, 1)) - ln(10)) / (ln(10000) - ln(10)))), 6) AS norm_area,
round(CASE WHEN p_size < 1e-9 THEN 0 ELSE p_retailprice / p_size END, 6) AS aspect FROM part""")
def b14_norm_area(spark, d):
    return table(spark, d, "part").select("p_partkey", r(L.norm_area(F.col("p_retailprice"))).alias("norm_area"), r(L.ratio(F.col("p_retailprice"), F.col("p_size").cast("double"))).alias("aspect"))


@query(f"""WITH {CELLS} SELECT run_id, count(*) AS n_input, count(*) FILTER (length >= 25 AND width >= 0.04) AS n_pass,
round(100.0 * count(*) FILTER (length >= 25 AND width >= 0.04) / count(*), 6) AS pct_pass FROM cells GROUP BY ALL""")
def b15_filter_report(spark, d):
    out = filters.filter_report(cells(spark, d), {"length": 25, "width": 0.04, "unknown": 3}, ["run_id"])
    return out.withColumn("pct_pass", r(F.col("pct_pass")))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def b16_filter_in(spark, d):
    out = filters.filter_in(table(spark, d, "orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]})
    return out.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT 'NT' || p_size AS value, count(*) AS n, 'nt' || lpad(CAST(p_size AS VARCHAR), 10, '0') AS sort_key FROM part GROUP BY ALL""")
def b17_distinct_values(spark, d):
    return filters.distinct_values(table(spark, d, "part").selectExpr("concat('NT', p_size) AS v"), "v")


BOXES = """boxes AS (SELECT p_partkey, p_brand AS fov, (p_partkey * 37) % 500 AS y0, (p_partkey * 91) % 500 AS x0, (p_partkey * 37) % 500 + p_size AS y1,
  (p_partkey * 91) % 500 + p_size + 5 AS x1, p_size * (p_size + 5) AS area_px FROM part)"""


def boxes(spark, d):
    return table(spark, d, "part").selectExpr(
        "p_partkey", "p_brand AS fov", "(p_partkey * 37) % 500 AS y0", "(p_partkey * 91) % 500 AS x0", "(p_partkey * 37) % 500 + p_size AS y1",
        "(p_partkey * 91) % 500 + p_size + 5 AS x1", "p_size * (p_size + 5) AS area_px", "p_retailprice",
    )


@query(f"""WITH {BOXES}, q AS (SELECT *, CASE WHEN y0 < 2 OR x0 < 2 OR y1 > 538 OR x1 > 538 THEN 'edge' WHEN area_px < 0.3 * 100 THEN 'debris' ELSE 'ok' END AS rule,
area_px > 25.0 * 100 AS clump, (p_partkey % 100) / 100.0 AS p_good FROM boxes)
SELECT fov, count(*) AS total, count(*) FILTER (rule = 'edge') AS edge, count(*) FILTER (rule = 'debris') AS debris,
count(*) FILTER (rule = 'ok' AND NOT (p_good >= 0.5 AND p_good >= 0.6)) AS cnn, count(*) FILTER (rule = 'ok' AND p_good >= 0.6) AS kept FROM q GROUP BY ALL""")
def b19_quality_report(spark, d):
    b = boxes(spark, d).withColumnsRenamed({k: f"bbox_{k}" for k in ("y0", "x0", "y1", "x1")})
    q = filters.quality_rules(b, 540, 540, 10).withColumn("p_good", (F.col("p_partkey") % 100) / 100.0)
    return filters.quality_report(q, "fov", "p_good", confidence=0.6)


LOG = "log AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS label_name, max((ts, event_id))[2] AS event_id FROM events GROUP BY user_id)"


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_id, event_type, round(value, 6) AS value FROM x WHERE rn = 1""")
def e1_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return joins.latest(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", r(F.col("value")).alias("value"))


@query("""SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, q.n_orders, round(q.total, 4) AS total, l.event_type FROM customer
JOIN (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1) l ON c_custkey = l.user_id
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY ALL) q ON c_custkey = o_custkey""")
def c1_feature_matrix(spark, d):
    log = joins.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").selectExpr("user_id AS key", "event_type")
    extra = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    m = joins.feature_matrix(table(spark, d, "customer").selectExpr("c_custkey AS key", "c_acctbal"), log, "key", extra)
    return m.select(F.col("key").alias("c_custkey"), r(F.col("c_acctbal")).alias("c_acctbal"), "n_orders", r(F.col("total"), 4).alias("total"), "event_type")


@query("""SELECT l.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AS found, quality, count(*) AS n FROM labels l GROUP BY ALL""")
def c2_labelled_rows(spark, d):
    have, missing = joins.labelled_rows(table(spark, d, "documents").filter("lang = 'en'"), table(spark, d, "labels"), "doc_id")
    both = have.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))
    return both.groupBy("found", "quality").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, coalesce(s.s_name, c_name) AS label, s.s_name IS NOT NULL AS updated FROM customer
LEFT JOIN (SELECT s_nationkey, min_by(s_name, s_suppkey) AS s_name FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY ALL) s ON c_nationkey = s_nationkey""")
def c3_overlay_labels(spark, d):
    layout = table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey AS key", "c_name AS label")
    source = table(spark, d, "supplier").filter("s_nationkey % 2 = 0").selectExpr("s_nationkey AS key", "s_suppkey", "s_name AS label")
    return joins.overlay_labels(layout, source, "key", "s_suppkey", ["label"]).select("c_custkey", "label", "updated")


@query(f"""WITH {BOXES} SELECT a.p_partkey, count(b.p_partkey) FILTER ((a.y0-b.y0)*(a.y0-b.y0)+(a.x0-b.x0)*(a.x0-b.x0) <= 400) AS r0, count(b.p_partkey) AS r1
FROM boxes a LEFT JOIN boxes b ON a.fov = b.fov AND a.p_partkey <> b.p_partkey AND (a.y0-b.y0)*(a.y0-b.y0)+(a.x0-b.x0)*(a.x0-b.x0) <= 2500 GROUP BY ALL""")
def c8_neighbours(spark, d):
    return joins.neighbours(boxes(spark, d), ["fov"], "p_partkey", "y0", "x0", [20, 50]).drop("fov")


@query(f"""WITH {BOXES} SELECT a.p_partkey, count(b.p_partkey) AS overlaps FROM boxes a LEFT JOIN boxes b ON a.fov = b.fov AND a.p_partkey <> b.p_partkey
AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.x0 < b.x1 AND b.x0 < a.x1 GROUP BY ALL""")
def c9_box_overlaps(spark, d):
    return joins.box_overlaps(boxes(spark, d), ["fov"], "p_partkey", 64.0).drop("fov")


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT user_id FROM events)")
def c11_common_keys(spark, d):
    frames = [table(spark, d, t).select(F.col(c).alias("key")) for t, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"))]
    return joins.common_keys(frames, "key")


@query("""WITH s AS (SELECT DISTINCT l_returnflag AS src, l_partkey AS k FROM lineitem)
SELECT x.src AS a, y.src AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k GROUP BY ALL""")
def c12_overlap_matrix(spark, d):
    return joins.overlap_matrix(table(spark, d, "lineitem"), "l_returnflag", "l_partkey")


PROFILE = f"""{CELLS}, prof AS (SELECT run_id, cond, avg(length) AS length, CASE WHEN avg(length) = 0 THEN 0 ELSE stddev_samp(length) / avg(length) END AS length_CV,
avg(area) AS area, CASE WHEN avg(area) = 0 THEN 0 ELSE stddev_samp(area) / avg(area) END AS area_CV, avg(width) AS width,
CASE WHEN avg(width) = 0 THEN 0 ELSE stddev_samp(width) / avg(width) END AS width_CV FROM cells GROUP BY ALL)"""
FEATURES = ["length", "length_CV", "area", "area_CV", "width", "width_CV"]


def cell_profiles(spark, d):
    return profiles.profile(cells(spark, d), ["run_id", "cond"], ["length", "area", "width"])


@query(f"WITH {PROFILE} SELECT run_id, cond, round(length, 4) AS length, round(length_CV, 6) AS length_CV, round(area, 4) AS area, round(area_CV, 6) AS area_CV, round(width, 6) AS width, round(width_CV, 6) AS width_CV FROM prof")
def d1_profile(spark, d):
    p = cell_profiles(spark, d)
    return p.select("run_id", "cond", *[r(F.col(c), 4 if c in ("length", "area") else 6).alias(c) for c in FEATURES])


SSCORE = f"""{PROFILE}, long AS (SELECT * FROM prof UNPIVOT (value FOR feature IN (length, length_CV, area, area_CV, width, width_CV))),
base AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM long WHERE regexp_matches(cond, '\\bL0\\b') GROUP BY feature),
scored AS (SELECT run_id, cond, long.feature, value, (value - mu) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END AS score FROM long JOIN base ON long.feature = base.feature)"""


def cell_scores(spark, d, run=None):
    return profiles.sscore(cell_profiles(spark, d), L.is_control(F.col("cond"), ["l0"]), ["run_id", "cond"], FEATURES, run)


@query(f"WITH {SSCORE} SELECT run_id, cond, feature, round(score, 4) AS score FROM scored")
def d2_sscore(spark, d):
    return cell_scores(spark, d).select("run_id", "cond", "feature", r(F.col("score"), 4).alias("score"))


@query(f"""WITH {SSCORE}, own AS (SELECT run_id, feature, avg(value) AS m, stddev_samp(value) AS s FROM long WHERE regexp_matches(cond, '\\bL0\\b') GROUP BY ALL)
SELECT l.run_id, cond, l.feature, round((value - m) / CASE WHEN coalesce(s, 0) = 0 THEN 1 ELSE s END, 4) AS score FROM long l JOIN own o ON l.run_id = o.run_id AND l.feature = o.feature""")
def d2_sscore_per_run(spark, d):
    return cell_scores(spark, d, "run_id").select("run_id", "cond", "feature", r(F.col("score"), 4).alias("score"))


@query(f"""WITH {CELLS} SELECT cond, count(*) AS n, round(quantile_cont(area, 0.5), 4) AS median, round(avg(area), 4) AS mean, round(stddev_samp(area), 4) AS std,
round(quantile_cont(area, 0.05), 4) AS p5, round(quantile_cont(area, 0.95), 4) AS p95, round(mad(area), 4) AS mad, round(mad(area) / median(area), 6) AS robust_cv FROM cells GROUP BY ALL""")
def d4_variation(spark, d):
    v = profiles.variation(cells(spark, d), "area", ["cond"])
    return v.select("cond", "n", *[r(F.col(c), 4).alias(c) for c in ("median", "mean", "std", "p5", "p95", "mad")], r(F.col("robust_cv")).alias("robust_cv"))


@query("SELECT o_orderstatus AS species, o_orderpriority AS kind, count(*) AS runs, sum(o_custkey) AS cells FROM orders GROUP BY ALL")
def d6_library_summary(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("species"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("runs"), F.sum("o_custkey").alias("cells"))


VECTORS = """v AS (SELECT label, UNNEST(embedding)::DOUBLE AS x, UNNEST(range(len(embedding))) AS dim FROM embeddings),
mean AS (SELECT label, dim, avg(x) AS m FROM v GROUP BY ALL), whole AS (SELECT dim, avg(x) AS a FROM v GROUP BY ALL),
prof AS (SELECT label, mean.dim, m - a AS value FROM mean JOIN whole ON mean.dim = whole.dim)"""


@query(f"WITH {VECTORS} SELECT label, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value FROM prof")
def d7_embedding_profiles(spark, d):
    return profiles.embedding_profiles(table(spark, d, "embeddings"), "label", "embedding").select("label", "dim", r(F.col("value")).alias("value"))


@query(f"""WITH {VECTORS} SELECT x.label AS i, y.label AS j, round(sqrt(sum((x.value - y.value) * (x.value - y.value))), 5) AS euclidean,
round(1 - sum(x.value * y.value) / sqrt(sum(x.value * x.value) * sum(y.value * y.value)), 5) AS cosine FROM prof x JOIN prof y ON x.dim = y.dim AND x.label < y.label GROUP BY ALL""")
def g1_pair_distances(spark, d):
    p = joins.pair_distances(profiles.embedding_profiles(table(spark, d, "embeddings"), "label", "embedding"), "label", "dim", "value")
    return p.select("i", "j", r(F.col("euclidean"), 5).alias("euclidean"), r(F.col("cosine"), 5).alias("cosine"))


RANKED = f"""{VECTORS}, dist AS (SELECT x.label AS i, y.label AS j, sqrt(sum((x.value - y.value) * (x.value - y.value))) AS d FROM prof x JOIN prof y ON x.dim = y.dim AND x.label <> y.label GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM dist)"""


@query(f"WITH {RANKED} SELECT i AS query, CAST(rank AS INTEGER) AS rank, j AS match, round(d, 5) AS distance FROM ranked WHERE rank <= 3")
def e4_rank_matches(spark, d):
    p = joins.pair_distances(profiles.embedding_profiles(table(spark, d, "embeddings"), "label", "embedding"), "label", "dim", "value")
    return joins.rank_matches(p, "euclidean", 3).withColumn("distance", r(F.col("distance"), 5))


@query(f"""WITH {RANKED}, h AS (SELECT i, rank, (i % 3 = j % 3)::INT AS hit, sum((i % 3 = j % 3)::INT) OVER (PARTITION BY i ORDER BY rank) AS hits FROM ranked)
SELECT i AS id, round(avg(hits / rank) FILTER (hit = 1), 6) AS ap, round(avg(hit) FILTER (rank <= 5), 6) AS knn FROM h GROUP BY ALL""")
def e5_rank_metrics(spark, d):
    e = table(spark, d, "embeddings")
    p = joins.pair_distances(profiles.embedding_profiles(e, "label", "embedding"), "label", "dim", "value")
    groups = e.select(F.col("label").alias("id")).distinct().withColumn("grp", F.col("id") % 3)
    return ranking.rank_metrics(p, "euclidean", groups, 5).select("id", r(F.col("ap")).alias("ap"), r(F.col("knn")).alias("knn"))


@query("""SELECT quality AS label, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM labels GROUP BY ALL
UNION ALL SELECT quality, NULL, count(*) FROM labels GROUP BY ALL""")
def d11_label_counts(spark, d):
    x = table(spark, d, "labels").selectExpr("quality", "CASE WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 5 = 1 THEN 'odd' ELSE 'train' END AS part")
    return profiles.label_counts(x, "part", "quality")


@query("""WITH s AS (SELECT l_returnflag AS k, (l_discount > 0.05)::INT AS y, l_quantity / 50.0 AS p FROM lineitem), c AS (SELECT k, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp FROM s GROUP BY ALL)
SELECT *, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(greatest(tp + fn, tn + fp) / (tn + fp + fn + tp), 6) AS majority_baseline FROM c""")
def d13_binary_metrics(spark, d):
    s = table(spark, d, "lineitem").selectExpr("l_returnflag AS k", "cast(l_discount > 0.05 AS int) AS y", "l_quantity / 50.0D AS p")
    m = profiles.binary_metrics(s, "y", "p", ["k"])
    return m.select("k", "tn", "fp", "fn", "tp", *[r(F.col(c)).alias(c) for c in ("accuracy", "balanced_accuracy", "majority_baseline")])


@query("""WITH c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (quality = toxic) AS agree, count(*) FILTER (quality = 1) AS a1, count(*) FILTER (toxic = 1) AS b1 FROM labels),
k AS (SELECT *, agree / n AS raw, (a1 * b1 + (n - a1) * (n - b1)) / (n * n) AS ch FROM c)
SELECT CAST(n AS BIGINT) AS n, agree, round(raw, 6) AS raw_agreement, round((raw - ch) / (1 - ch), 6) AS kappa, CASE WHEN (raw - ch) / (1 - ch) <= 0 THEN 'poor' WHEN (raw - ch) / (1 - ch) <= 0.2 THEN 'slight' ELSE 'fair' END AS band FROM k""")
def d14_agreement(spark, d):
    a = profiles.agreement(table(spark, d, "labels"), "quality", "toxic")
    return a.select("n", "agree", r(F.col("raw_agreement")).alias("raw_agreement"), r(F.col("kappa")).alias("kappa"), "band")


@query("SELECT o_orderpriority, round(1.4826 * mad(o_totalprice), 4) AS sigma FROM orders GROUP BY ALL")
def d19_robust_sigma(spark, d):
    return profiles.robust_sigma(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]).withColumn("sigma", r(F.col("sigma"), 4))


@query("""WITH x AS (SELECT p_partkey, p_brand || '__' || p_type AS name, count(*) OVER g AS n, row_number() OVER (g ORDER BY p_partkey) AS rn FROM part WINDOW g AS (PARTITION BY p_brand, p_type))
SELECT p_partkey, CASE WHEN n > 1 THEN name || '_' || rn ELSE name END AS label FROM x""")
def e3_disambiguate(spark, d):
    return joins.disambiguate(table(spark, d, "part"), ["p_brand", "p_type"], [F.col("p_partkey")], "label").select("p_partkey", "label")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, (s_suppkey * 37 % 1000 + 1) / 1000.0 AS p FROM supplier), x AS (SELECT *, p * count(*) OVER (PARTITION BY s_nationkey) / row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) AS raw FROM s)
SELECT s_suppkey, round(least(1.0, min(raw) OVER w), 6) AS q, least(1.0, min(raw) OVER w) <= 0.05 AS significant FROM x WINDOW w AS (PARTITION BY s_nationkey ORDER BY p, s_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def e7_benjamini_hochberg(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "s_nationkey", "(s_suppkey * 37 % 1000 + 1) / 1000.0D AS p")
    return ranking.benjamini_hochberg(s, "p", ["s_nationkey"]).select("s_suppkey", r(F.col("q")).alias("q"), "significant")


@query("""WITH s AS (SELECT l_quantity / 51.0 AS s, count(*) FILTER (l_discount > 0.05) AS p, count(*) FILTER (l_discount <= 0.05) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS tot_p, sum(n) OVER () AS tot_n FROM s WINDOW w AS (ORDER BY s DESC))
SELECT round(sum(n * (tp - p / 2.0)) / max(tot_p * tot_n), 6) AS auc, round(sum(p * tp / (tp + fp)) / max(tot_p), 6) AS average_precision, round(max(tot_p) / max(tot_p + tot_n), 6) AS prevalence, round(max_by(s, (tp * tot_n - fp * tot_p, s)), 6) AS youden FROM c""")
def e8_auc(spark, d):
    s = table(spark, d, "lineitem").selectExpr("cast(l_discount > 0.05 AS int) AS y", "l_quantity / 51.0D AS s")
    return ranking.auc(s, "y", "s").select(*[r(F.col(c)).alias(c) for c in ("auc", "average_precision", "prevalence", "youden")])


@query(f"""WITH {SSCORE} SELECT feature, round(max(score) FILTER (NOT regexp_matches(cond, '\\bL0\\b')) - min(score) FILTER (NOT regexp_matches(cond, '\\bL0\\b')), 4) AS spread,
round(min(score) FILTER (regexp_matches(cond, '\\bL0\\b')), 4) AS control_min, round(max(score) FILTER (regexp_matches(cond, '\\bL0\\b')), 4) AS control_max FROM scored GROUP BY feature ORDER BY spread DESC, feature LIMIT 20""")
def e9_top_spread(spark, d):
    t = ranking.top_spread(cell_scores(spark, d), "feature", "score", L.is_control(F.col("cond"), ["l0"]), 20)
    return t.select("feature", *[r(F.col(c), 4).alias(c) for c in ("spread", "control_min", "control_max")])


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5('7:' || doc_id), doc_id LIMIT 100""")
def e11_build_pool(spark, d):
    return ranking.build_pool(table(spark, d, "documents").select("doc_id"), "doc_id", "random", 100, 7, exclude=table(spark, d, "labels")).select("doc_id")


@query("""WITH x AS (SELECT o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('3:' || o_orderkey), o_orderkey) AS rn FROM orders)
SELECT o_orderkey, o_orderpriority FROM x WHERE rn <= 50 AND n >= 5""")
def e16_cap_sample(spark, d):
    return ranking.cap_sample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 50, 5, 3)


PIXELS = "px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE + 1 AS v FROM embeddings, range(64) t(i))"


@query(f"""WITH {PIXELS}, s AS (SELECT vec_id, v, lead(v, 1) OVER d AS y1, lead(v, 2) OVER d AS y2, lag(v) OVER d AS y_1, lead(v) OVER a AS x1, lag(v) OVER a AS x_1 FROM px
WINDOW d AS (PARTITION BY vec_id, x ORDER BY y), a AS (PARTITION BY vec_id, y ORDER BY x))
SELECT vec_id, round(CASE WHEN avg(v) > 0 THEN var_pop(v) / avg(v) ELSE 0 END, 6) AS normalized_variance, round(sum((y2 - v) * (y2 - v)), 5) AS brenner,
round(sum(v * y1) - sum(v * y2), 4) AS vollath_f4, round(coalesce(sum(abs(2 * v - y1 - y_1)), 0) + coalesce(sum(abs(2 * v - x1 - x_1)), 0), 5) AS sml FROM s GROUP BY ALL""")
def h1_focus_metrics(spark, d):
    px = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v0"))
    px = px.selectExpr("vec_id", "i div 8 AS y", "i % 8 AS x", "cast(v0 AS double) + 1 AS value")
    m = pixels.focus_metrics(px, ["vec_id"])
    digits = {"normalized_variance": 6, "brenner": 5, "vollath_f4": 4, "sml": 5}
    return m.select("vec_id", *[r(F.col(c), n).alias(c) for c, n in digits.items()])


@query(f"WITH {PIXELS} SELECT vec_id % 50 AS image, y, x, round(max(v), 6) AS value FROM px GROUP BY ALL")
def h25_maximum_projection(spark, d):
    px = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v0")).selectExpr("vec_id % 50 AS image", "i div 8 AS y", "i % 8 AS x", "cast(v0 AS double) + 1 AS value")
    return pixels.maximum_projection(px, ["image"]).withColumn("value", r(F.col("value")))


@query("SELECT date_trunc('hour', ts) AS start, event_type AS label, count(*) AS n FROM events GROUP BY ALL")
def s1_windowed_counts(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
