"""Every registered query of the library against its SQL on DuckDB, and small cases by hand."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from phenoframe.functions import labels as L
from phenoframe.operators import filters, joins, profiles, ranking, summaries
from phenoframe.plans import registry
from phenoframe.sources import tables

DATA = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.3f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    own = sorted([norm(r[k]) for k in sorted(df.columns)] for r in df.collect())
    if name not in registry.ORACLE_SQL:  # transport: test_operators.py compares it with brute force
        assert own
        return
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    rows = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert own == sorted([norm(r[k]) for k in sorted(rel.columns)] for r in rows)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_labels(spark):
    p = one(spark, L.parse_stem, "ATc_focused__rep__dnaN_filtered__r2")
    assert (p["condition"], p["reporter"], p["mutant_or_drug"], p["replica"], p["is_control"], p["gene"]) == ("ATc", "rep", "dnaN", "r2", False, "dnaN")
    assert one(spark, L.parse_stem, "x")["condition_label"] == "x"
    assert one(spark, L.gene_of, "dnaN 10x") == "dnaN"
    assert one(spark, L.norm_well, " b007 ") == "B7"
    assert one(spark, L.parse_int_list, "[1; 2,x 3]") == [1, 2, 3]
    assert one(spark, L.strip_replicate, "dnaN_R2  ATc_") == "dnaN ATc"
    assert one(spark, lambda c: L.is_control(c, ["NT"]), "NT1") is False and one(spark, lambda c: L.is_control(c, ["NT1"]), "nt1 ATc") is True
    assert one(spark, lambda c: L.is_control(c, []), "a") is False
    assert [round(one(spark, lambda c: L.norm_area(c.cast("double")), x), 6) for x in ("10", "10000", "1", "316.227766017")] == [0, 1, 0, 0.5]


def test_rank_metrics_by_hand(spark):
    """Two groups of three, 0.1 apart inside and 1 outside: kNN@1 is 1, kNN@5 is 0.4, AP is 1."""
    pairs = [(i, j, 0.1 if i // 3 == j // 3 else 1.0) for i in range(6) for j in range(i + 1, 6)]
    p = spark.createDataFrame(pairs, "i long, j long, d double")
    g = spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, grp long")
    for k, expected in ((1, 1.0), (5, 0.4)):
        rows = ranking.rank_metrics(p, "d", g, k).collect()
        assert len(rows) == 6 and all(abs(r["knn"] - expected) < 1e-9 and r["ap"] == 1 for r in rows)


def test_binary_metrics_by_hand(spark):
    rows = [("m", 0, 0.1)] * 495 + [("m", 0, 0.9)] * 15 + [("m", 1, 0.2)] * 86 + [("m", 1, 0.5)] * 464
    m = profiles.binary_metrics(spark.createDataFrame(rows, "k string, y int, p double"), "y", "p", ["k"]).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (495, 15, 86, 464) and round(m["accuracy"], 4) == 0.9047 and round(m["balanced_accuracy"], 4) == 0.9071


def test_filters_let_nan_fail(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "a double")
    assert filters.filter_min(df, {"a": 3, "b": 9}).count() == 1
    with pytest.raises(ValueError, match="no such field"):
        filters.filter_in(df, {"z": [1]})


def test_label_log(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("cell_uid,label_idx,label_name,labeled_at,split\nc1,1,good,2024-01-01T00:00:00,\nc2,x,bad,,test\n,0,bad,,\n")
    rows = tables.read_labels(spark, str(path)).collect()
    assert [(r["label_idx"], r["split"], r["bad"]) for r in rows] == [(1, "train", False), (None, "test", True), (0, "train", True)]


def test_windowed_counts_as_a_stream(spark, tmp_path):
    from phenoframe.streaming.labels import windowed_counts

    source = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in"), "ts", "event_type", late="365 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in windowed_counts(source, "ts", "event_type").collect()}


def test_latest_and_neighbours_handle_empty(spark):
    e = spark.createDataFrame([], "k long, ts long, seq long, v string")
    assert joins.latest(e, "k", "ts", "seq").count() == 0
    b = spark.createDataFrame([("f", 1, 0.0, 0.0)], "f string, id long, y double, x double")
    assert joins.neighbours(b, ["f"], "id", "y", "x", [5.0]).first()["r0"] == 0


def test_neighbours_count_copies_of_a_place_without_a_broadcast(spark):
    b = spark.createDataFrame([("f", i, 3.0, 4.0) for i in range(50)] + [("f", 50, 3.0, 8.0), ("g", 51, 3.0, 4.0), ("f", 52, None, 1.0)], "f string, id long, y double, x double")
    near = joins.neighbours(b, ["f"], "id", "y", "x", [1.0, 5.0])
    got = {r["id"]: (r["r0"], r["r1"]) for r in near.collect()}
    assert got == {i: (49, 50) for i in range(50)} | {50: (0, 50), 51: (0, 0), 52: (0, 0)}
    assert "SortMergeJoin [f" in near._jdf.queryExecution().sparkPlan().toString()


def test_overlaps_count_copies_of_a_box_once_a_tile(spark):
    rows = [("f", i, 0, 0, 10, 10) for i in range(50)] + [("f", 50, 9, 9, 30, 30), ("f", 51, 10, 10, 12, 12), ("f", 52, 5, 5, 5, 9), ("g", 53, 0, 0, 10, 10)]
    over = joins.box_overlaps(spark.createDataFrame(rows, "f string, id long, y0 int, x0 int, y1 int, x1 int"), ["f"], "id", 4.0)
    touch = lambda a, b: a[1] != b[1] and a[0] == b[0] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]
    assert {r["id"]: r["overlaps"] for r in over.collect()} == {a[1]: sum(touch(a, b) for b in rows) for a in rows}
    plan = over._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [f" in plan and "distinct" not in plan


def test_orientation_where_the_covariance_is_zero(spark, tmp_path):
    """The sign of pi/2 is that of the SQL's sum, also for pixels that come in another order, and where 100,000 regions are too many to broadcast."""
    masks = [(1, 0xD164E12A8DB9E2A2), (2, 0x8674BE8FC59B106C), (2, 0xB97B95F99EB22485), (2, 0x83EF5E020BC3628B), (2, 0x192B89440539046)]
    vectors = [(k, k, [0.5 if (m >> i & 1) == (at == 1) else -0.5 for i in range(64)]) for k, (at, m) in enumerate(masks)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        wanted = {r[:2]: r[-1] for r in c.sql(registry.ORACLE_SQL["d21_region_geometry"]).fetchall()}
    assert [wanted[k, at] for k, (at, _) in enumerate(masks)] == [-1.5708, 1.5708, 1.5708, -1.5708, -1.5708]
    assert {(r["image"], r["label"]): r["orientation"] for r in registry.QUERIES["d21_region_geometry"](spark, str(tmp_path)).collect()} == wanted
    px = spark.createDataFrame([(k, i // 8, i % 8) for k, (_, m) in enumerate(masks) for i in reversed(range(64)) if m >> i & 1], "image long, y int, x int").repartition(5, "y")
    for few in (summaries.FEW, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(summaries, "FEW", few)
            got = {r["image"]: round(r["orientation"], 4) for r in summaries.region_geometry(px, ["image"], 1.0).collect()}
        assert got == {k: wanted[k, at] for k, (at, _) in enumerate(masks)}
