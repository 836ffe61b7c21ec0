"""Small cases of the operators by hand and against brute force."""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoframe.functions import labels, shapes
from phenoframe.operators import focus, layout, models, ranking, regions, sampling, sites, summaries, transport
from phenoframe.sources import tables
from phenoframe.streaming import intake


def test_seeded_rank_is_dense_with_a_hot_group(spark):
    df = spark.range(20000).selectExpr("id", "CASE WHEN id % 10 < 9 THEN 'hot' ELSE 'cold' END AS g")
    r = sampling.seeded_rank(df, ["g"], "id", 1).toPandas()
    for _, part in r.groupby("g"):
        assert sorted(part["_rank"]) == list(range(1, len(part) + 1)) and set(part["_size"]) == {len(part)}


def test_nested_subsets(spark):
    df = spark.range(100).selectExpr("id", "cast(id % 2 AS string) AS c")
    s = sampling.nested_subsets(df, "c", "id", [0.1, 0.5, 1.0], 4).toPandas()
    small, mid, whole = (set(s[s["fraction"] == f]["id"]) for f in (0.1, 0.5, 1.0))
    assert len(small) == 16 and len(mid) == 50 and len(whole) == 100 and small < mid < whole  # 8 a class at least
    tiny = df.filter("c = '0' OR id < 10")
    assert sampling.nested_subsets(tiny, "c", "id", [0.5], 4).count() == 0  # a class of five rows is below eight


def test_splits_keep_groups_and_classes(spark):
    df = spark.range(1000).selectExpr("id", "id % 13 AS fov", "CASE WHEN id < 3 THEN 'rare' ELSE 'usual' END AS c")
    g = sampling.group_split(df, "fov", 0.2, 1)
    assert g.groupBy("fov").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    assert g.filter("split = 'val'").select("fov").distinct().count() == 2
    assert {r["split"] for r in sampling.stratified_split(df, "c", "id", 0.1, 0.2, 1).select("split").distinct().collect()} == {"train", "val"}
    assert sampling.stratified_split(df.limit(0), "c", "id", 0.1, 0.2, 1).count() == 0


def test_layouts(spark):
    w = spark.createDataFrame([("p", "a01"), ("p", "H12"), ("q", " b3 "), ("q", "B03"), ("r", "x")], "plate string, well string")
    b = {r["plate"]: r for r in layout.plate_bounds(w, ["plate"], "well").collect()}
    assert (b["p"]["n_rows"], b["p"]["n_cols"]) == (8, 12) and (b["q"]["n_rows"], b["q"]["n_cols"]) == (2, 3) and "r" not in b
    assert [tuple(r) for r in layout.duplicate_wells(w, ["plate"], "well").collect()] == [("q", "B3", 2)]
    kept, stale = layout.keep_expected(w, w.select("plate").limit(0), "plate")
    assert kept.count() == 5 and stale.count() == 0


def test_outlines(spark):
    square = spark.createDataFrame([("s", k, y, x) for k, (y, x) in enumerate([(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)])] + [("l", 0, 0.0, 0.0), ("l", 1, 0.0, 3.0)], "id string, k int, y double, x double")
    m = {r["id"]: r for r in shapes.polygon_measures(square, ["id"], "k", "y", "x").collect()}
    assert (m["s"]["area"], m["s"]["perimeter"]) == (4, 8) and (m["l"]["area"], m["l"]["perimeter"]) == (0, 6)
    a = {r["id"]: r for r in shapes.angularity(square, ["id"], "k", "y", "x").collect()}
    assert abs(a["s"]["angularity_mean"] - np.pi / 2) < 1e-9 and a["l"]["angularity_mean"] is None


def test_focus_choice(spark):
    s = spark.createDataFrame([("a", z, v) for z, v in enumerate([5.0, 1.0, 5.0, 5.0, 0.0])] + [("b", 0, 1.0), ("b", 1, 1.0)], "img string, z int, v double")
    assert {r["img"]: r["z"] for r in focus.pick_slice(s, ["img"], "v").collect()} == {"a": 2, "b": 0}
    flat = focus.ensemble(s.filter("img = 'b'"), ["img"], ["v"])
    assert {r["ensemble"] for r in flat.collect()} == {0.0}
    assert [r["v"] for r in focus.smooth_z(s.filter("img = 'b'"), ["img"], ["v"]).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError, match="grid"):
        focus.tile_id(s, 0, 1, 4, 4)


def test_sharpness_of_a_grid_by_loops(spark):
    g = np.random.default_rng(0).random((5, 6))
    px = spark.createDataFrame([("i", y, x, float(g[y, x])) for y in range(5) for x in range(6)], "img string, y int, x int, value double")
    p = np.pad(g, 1, mode="edge")
    n, s, w, e = p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]
    gx = (p[:-2, 2:] + 2 * e + p[2:, 2:]) - (p[:-2, :-2] + 2 * w + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * s + p[2:, 2:]) - (p[:-2, :-2] + 2 * n + p[:-2, 2:])
    r = focus.sharpness(px, ["img"]).first()
    assert abs(r["laplacian_variance"] - (n + s + w + e - 4 * g).var()) < 1e-9 and abs(r["tenengrad"] - (gx**2 + gy**2).sum()) < 1e-9


def test_regions(spark):
    a = spark.createDataFrame([("i", y, x, 1 if x < 4 else 2) for y in range(4) for x in range(8)], "img string, y int, x int, label int")
    b = a.withColumn("label", F.when(F.col("x") < 2, 1).when(F.col("x") < 4, 2).otherwise(3))
    p = regions.overlaps(a, b, ["img"])
    m = sorted((r["la"], r["lb"], r["iou"]) for r in regions.match_regions(p, ["img"]).collect())
    assert m == [(1, 1, 0.5), (2, 3, 1.0)]
    assert [tuple(r) for r in regions.splits_merges(p, ["img"]).collect()] == [("i", 1, 0)]
    points = spark.createDataFrame([("i", 0.5, 4.5), ("i", 9.0, 9.0)], "img string, y double, x double")
    assert sorted(r["label"] for r in regions.label_at(points, a, ["img"]).collect()) == [0, 2]


def test_transport_approaches_the_exact_assignment():
    rng = np.random.default_rng(1)
    a, b = rng.random((5, 2)), rng.random((5, 2)) + 1
    exact = min(sum(((a[i] - b[j]) ** 2).sum() for i, j in enumerate(p)) for p in permutations(range(5))) / 5
    assert abs(transport.transport_cost(a, b, 0.005, 5000) - exact) < 0.02 * exact


def test_transport_jobs(spark):
    rng = np.random.default_rng(2)
    rows = [(c, f"{c}{i}", [float(v) for v in rng.normal(3 if c == "far" else 0, 1, 3)]) for c in ("near1", "near2", "far") for i in range(30)] + [("few", "f", [0.0, 0.0, 0.0])]
    cloud = transport.clouds(spark.createDataFrame(rows, "c string, id string, v array<double>"), "c", "id", "v")
    matrix = transport.sinkhorn_matrix(cloud)
    d = {(r["i"], r["j"]): r["divergence"] for r in matrix.collect()}
    assert all(abs(r["distance"] ** 2 - r["divergence"]) < 1e-9 for r in matrix.collect())
    assert {r["query"]: r["match"] for r in transport.nearest_matches(matrix, "divergence").collect()} == {
        c: min((v, b if a == c else a) for (a, b), v in d.items() if c in (a, b))[1] for c in ("near1", "near2", "far")
    }
    assert set(d) == {("far", "near1"), ("far", "near2"), ("near1", "near2")} and d["near1", "near2"] < 0.2 * d["far", "near1"]
    pairs = spark.createDataFrame([("near1", "near2"), ("near1", "far"), ("near1", "few")], "query string, match string")
    p = {r["match"]: r["p_perm"] for r in transport.permutation_test(cloud, pairs, n_perm=30, each=8).collect()}
    assert set(p) == {"near2", "far"} and p["far"] > 0.9 and 0 < p["near2"] <= 1


def test_choose_k_and_noise(spark):
    assert transport.choose_k(spark.createDataFrame([(2, 0.5), (3, 0.52), (4, 0.3)], "k int, silhouette double")) == 2
    found = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (0, 3, -1), (0, 4, -1), (1, 1, 5), (1, 2, 6)], "seed int, id int, label int")
    assert [tuple(r) for r in transport.co_association(found, 2).collect()] == [(1, 2, 0.5)]


def test_zclip_and_weights(spark):
    z = summaries.zclip(spark.createDataFrame([(1.0, 4.0), (1.0, None)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in z] == [(0.0, 0.0), (0.0, 0.0)]
    w = summaries.class_weights(spark.createDataFrame([("a",)] * 3 + [("b",)] + [(" ",)] * 5 + [(None,)], "c string"), "c", 2, 50).collect()
    assert [(r["c"], r["n"], r["idx"]) for r in w] == [("a", 3, 0)]


def test_library_tables(spark, tmp_path):
    a = spark.createDataFrame([(0, "x"), (1, None)], "fov_id int, drug string")
    both = tables.consolidate_metadata([a, a.select("drug"), a], {"fov_id": "int", "drug": "string", "is_control": "boolean"})
    assert sorted(r["fov_id"] for r in both.collect()) == [0, 1, 2, 2, 3, 4] and both.filter("drug IS NULL OR is_control").isEmpty()
    pairs = spark.createDataFrame([("a", "b", 1.5)], "i string, j string, d double")
    tables.write_distances(pairs, f"{tmp_path}/d", {"reg": "0.05"})
    back, params = tables.read_distances(spark, f"{tmp_path}/d")
    assert back.collect() == pairs.collect() and params == {"reg": "0.05"}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"n": 3}, indent=1))
    (tmp_path / "j" / "b.json").write_text("{ no")
    assert [r["n"] for r in tables.scan_json(spark, f"{tmp_path}/j", "n int").collect()] == [3]
    assert [(r["length"], len(r["sha256"])) for r in tables.fingerprint_files(spark, f"{tmp_path}/j/b.json").collect()] == [(4, 64)]
    tables.append_labels(spark.createDataFrame([("c", 1)], "cell_uid string, label_idx int"), f"{tmp_path}/l")
    assert [(r["split"], r["model_at_label"]) for r in spark.read.parquet(f"{tmp_path}/l").collect()] == [("train", "none")]


def test_streams_keep_tables_current(spark, tmp_path):
    schema, source = "k string, ts long, seq long, v double", f"{tmp_path}/in"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for q in (
            intake.stream_latest_labels(spark, source, schema, f"{tmp_path}/latest", "k", "ts", "seq", f"{tmp_path}/c1"),
            intake.stream_intake(spark, source, schema, {"v": 2.0}, f"{tmp_path}/kept", f"{tmp_path}/c2"),
        ):
            assert q.awaitTermination(120)

    arrive([("a", 1, 0, 1.0), ("b", 1, 0, 2.0)])
    arrive([("a", 2, 1, 3.0), ("b", 0, 1, 9.0)])
    assert sorted((r["k"], r["v"]) for r in intake.current_labels(spark, f"{tmp_path}/latest").collect()) == [("a", 3.0), ("b", 2.0)]
    assert sorted(r["v"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [2.0, 3.0, 9.0]


def test_feature_model(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), None, int(a + 0.1 * b > 0), "train" if i % 4 else "test") for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int, split string")
    model, used = models.train_feature_model(df, ["a", "b", "c"], "y", "split", rounds=5)
    test = df.filter("split = 'test'")
    assert used == ["a", "b"] and models.evaluate_model(model, test, used, "y").first()["auc"] > 0.9
    top = models.permutation_importance(model, test, used, "y", "id", repeats=2).collect()
    assert top[0]["feature"] == "a" and top[0]["mean"] > 0.2
    with pytest.raises(ValueError, match="hold-out"):
        models.train_feature_model(test, ["a"], "y", "split")
    with pytest.raises(ValueError, match="no such features"):
        models.score(model, test.drop("a"), used)


def test_model_registry(spark):
    reg = spark.createDataFrame([("m1", "cnn", ["r1"], 1), ("m2", "ae", [], 2)], "model_name string, model_type string, run_ids array<string>, position int")
    new = spark.createDataFrame([("m1", "cnn", ["r9"])], "model_name string, model_type string, run_ids array<string>")
    both = tables.register_model(reg, new)
    assert both.count() == 2 and tables.latest_model(both).first()["model_name"] == "m1" and tables.latest_model(both, "ae").first()["model_name"] == "m2"
    assert tables.update_model_runs(both, "m1", ["r9", "a"]).filter("model_name = 'm1'").first()["run_ids"] == ["a", "r9"]


def test_names(spark):
    df = spark.createDataFrame([("/d/run1/04_features/f.csv", " NT1 ,WT,, NT1"), ("d\\run2\\f.csv", "")], "p string, c string")
    rows = df.select(labels.run_id_of(F.col("p")).alias("r"), labels.control_tokens(F.col("c")).alias("t")).collect()
    assert [(x["r"], x["t"]) for x in rows] == [("run1", ["NT1", "WT"]), ("run2", [])]


def test_sites_near_a_border(spark):
    px = spark.createDataFrame([("i", y, x, float(10 * (y == x == 4))) for y in range(9) for x in range(9)], "img string, y int, x int, value double")
    s = spark.createDataFrame([("i", 1, 4, 4), ("i", 2, 0, 0)], "img string, site int, y int, x int")
    assert {r["site"]: r["amplitude"] for r in sites.peak_amplitude(px, s, ["img"], 3, 1).collect()} == {1: 10.0, 2: None}
    assert {r["snr"] for r in sites.annulus_snr(px, s, ["img"], 1.0).collect()} == {0.0}  # flat rings


def test_scopes_of_rank_metrics(spark):
    """A gene of five replicates: the other genes of its group fill 4 of 5 places across genes, its own replicates all 5 otherwise."""
    genes = [("A", "hadA", 5), ("A", "hadB", 3), ("A", "hadC", 1), ("B", "xx", 5), ("B", "yy", 3)]
    rows = [(n, gene, grp) for n, (grp, gene) in enumerate((grp, gene) for grp, gene, count in genes for _ in range(count))]
    far = lambda a, b: 0.05 if a[1] == b[1] else 0.5 if a[2] == b[2] else 1.0
    pairs = spark.createDataFrame([(a[0], b[0], far(a, b)) for a in rows for b in rows if a[0] < b[0]], "i int, j int, d double")
    groups = spark.createDataFrame([*rows, (99, "lone", "C"), (98, "none", None)], "id int, key string, grp string")
    got = {s: {r["id"]: r for r in ranking.rank_metrics(pairs, "d", groups, 5, s).collect()} for s in ranking.SCOPES}
    assert abs(got["cross_gene"][0]["knn"] - 0.8) < 1e-9 and got["all"][0]["knn"] == 1 and len(got["all"]) == 17
    assert abs(got["replicate"][0]["knn"] - 0.8) < 1e-9 and 8 not in got["replicate"]  # four other replicates; a gene of one has none
    with pytest.raises(ValueError, match="scope"):
        ranking.rank_metrics(pairs, "d", groups, 5, "other")


def test_read_features_and_library(spark, tmp_path):
    (tmp_path / "f.csv").write_text("cell_uid,area\na,1.5\nb,NaN\n")
    assert [r["area"] for r in tables.read_features(spark, f"{tmp_path}/f.csv").orderBy("cell_uid").collect()] == [1.5, None]
    index = spark.createDataFrame([("r1", "Msm", "t"), ("r2", "Mtb", "t")], "run_id string, species string, experiment_type string")
    runs = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 3)], "run_id string, n int")
    assert [r["_library_run_id"] for r in tables.load_library(index, runs, "msm").collect()] == ["r1"]
    assert tables.load_library(index, runs).count() == 2


def test_percentiles_are_exact(spark):
    from phenoframe.operators.quantiles import percentiles

    even = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 400) END AS k"
    df = spark.range(60_000).selectExpr(even, "CASE WHEN id % 11 <> 0 THEN exp(xxhash64(id) / 1e18) END AS x", "id % 5 AS y").union(spark.sql("SELECT 'none', CAST(NULL AS double), CAST(NULL AS bigint)"))
    wanted = {"x5": ("x", 0.05), "x50": ("x", 0.5), "x999": ("x", 0.999), "x0": ("x", 0.0), "x1": ("x", 1.0), "y25": ("y", 0.25), "y50": ("y", 0.5)}
    got = {r["k"]: r for r in percentiles(df, ["k"], wanted, F.count("*").alias("n")).collect()}
    plain = df.groupBy("k").agg(F.count("*").alias("n"), *[F.percentile(c, F.lit(q)).alias(name) for name, (c, q) in wanted.items()]).collect()
    assert {r["k"]: tuple(got[r["k"]][c] for c in ["n", *wanted]) for r in plain} == {r["k"]: tuple(r[c] for c in ["n", *wanted]) for r in plain}
    assert percentiles(df.filter("false"), ["k"], wanted).count() == 0


def test_pairs_of_items_are_made_whole(spark, monkeypatch):
    """Blocks of three items: every pair once, with its share rounded, noise and null items apart."""
    monkeypatch.setattr(transport, "ITEMS", 3)
    rows = [(s, i, -1 if (s + i) % 5 == 0 else i * (s + 1) % 3) for s in range(4) for i in range(11)]
    df = spark.createDataFrame([*rows, (0, None, 1)], "seed int, id long, label int")
    at = {(s, i): l for s, i, l in rows}
    share = {(i, j): sum(at[s, i] == at[s, j] >= 0 for s in range(4)) / 4 for i in range(11) for j in range(i + 1, 11)}
    assert sorted(map(tuple, transport.co_association(df, 4, 1).collect())) == sorted((*k, round(v, 1)) for k, v in share.items() if v)
    assert transport.co_association(df.filter("label < 0"), 4).count() == 0


def test_blocks_of_items_are_sent_not_items(spark, monkeypatch):
    """More blocks than some have items for, small batches, text as ids: every pair once, and items do not meet as rows of a join."""
    rows = [(s, f"k{i * 7 % 23}", -1.0 if (s + i) % 5 == 0 else i * (s + 1) % 4 / 2) for s in range(4) for i in range(23) if (s, i) != (2, 4)]
    at = {(s, i): l for s, i, l in rows}
    ids = sorted({i for _, i, _ in rows})
    share = {(i, j): sum(at.get((s, i), -1) == at.get((s, j), -2) >= 0 for s in range(4)) / 4 for k, i in enumerate(ids) for j in ids[k + 1 :]}
    df = spark.createDataFrame(rows, "seed int, id string, label double")
    for least, blocks, largest, batch in ((1, 60, 9, 5), (1, 1, 5, 1), (100, 16, 16_384, 10_000)):
        for name, value in (("ITEMS", least), ("BLOCKS", blocks), ("LARGEST", largest), ("BATCH", batch)):
            monkeypatch.setattr(transport, name, value, raising=False)
        pairs = transport.co_association(df, 4)
        assert "Join" not in pairs._jdf.queryExecution().sparkPlan().toString()
        assert sorted(map(tuple, pairs.collect())) == sorted((*k, v) for k, v in share.items() if v)


def test_angularity_beside_nulls_and_repeated_points(spark):
    """A null vertex leaves its neighbours without a tangent; beside a tangent without length a negative zero is half a turn."""
    null = [(0, 0.0, 0.0), (1, None, 1.0), (2, 2.0, 2.0), (3, 0.0, 2.0), (4, -1.0, 1.0)]
    spike = [(0, 0.0, 0.0), (1, -1.0, -1.0), (2, 0.0, 0.0), (3, -3.0, -2.0)]
    df = spark.createDataFrame([(k, *p) for k, s in (("null", null), ("spike", spike)) for p in s], "id string, k int, y double, x double")
    got = {r["id"]: r for r in shapes.angularity(df, ["id"], "k", "y", "x").collect()}
    for name, points in (("null", null), ("spike", spike)):
        p, n = np.array([q[1:] for q in points], float), len(points)
        t = np.roll(p, -1, 0) - np.roll(p, 1, 0)
        u = np.roll(t, -1, 0)
        a = np.arctan2(np.abs(t[:, 1] * u[:, 0] - t[:, 0] * u[:, 1]), t[:, 1] * u[:, 1] + t[:, 0] * u[:, 0])
        assert abs(got[name]["angularity_mean"] - np.nanmean(a)) < 1e-9 and abs(got[name]["angularity_max"] - np.nanmax(a)) < 1e-9
