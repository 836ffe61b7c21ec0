"""Bleed, outlines, spots, components, stored distances and results against brute force and by hand."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoframe.functions import provenance as P
from phenoframe.operators import components, joins, models, outlines, quantiles, ranking, robust, spots, transport, transport_job
from phenoframe.sources import results, tables


def test_inversions():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 200):
        v = rng.integers(0, 20, n)
        assert robust.inversions(v) == sum(v[i] > v[j] for i in range(n) for j in range(i + 1, n))


def slopes(points):
    return sorted((b[1] - a[1]) / (b[0] - a[0]) for a in points for b in points if b[0] > a[0])


def test_median_slope_equals_all_pairs(spark, monkeypatch):
    """Also where the bracket has to narrow: far points, whole numbers full of ties, one x for a third of all."""
    monkeypatch.setattr(robust, "MOST", 60)
    rng = random.Random(3)
    sets = {
        "plain": [(rng.random(), rng.random()) for _ in range(90)], "far": [(math.exp(6 * rng.random()), rng.gauss(0, 1)) for _ in range(80)] + [(1e9, 5.0)],
        "whole": [(float(rng.randrange(6)), float(rng.randrange(4))) for _ in range(120)], "hot": [(1.0, rng.random()) for _ in range(60)] + [(rng.random() * 3, rng.random()) for _ in range(60)],
        "line": [(float(i), 2.0 * i + 1) for i in range(50)], "two": [(0.0, 0.0), (1.0, 3.0)], "one": [(1.0, 1.0)], "same": [(2.0, 1.0), (2.0, 5.0)],
    }
    rows = [(k, *p) for k, v in sets.items() for p in v] + [("plain", None, 1.0), ("plain", float("nan"), 1.0)]
    got = {r["k"]: r["slope"] for r in robust.median_slope(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    for k, v in sets.items():
        s = slopes(v)
        assert (got[k] is None) if not s else abs(got[k] - float(np.median(s))) <= 1e-9 * max(1, abs(got[k])), k


def test_median_slope_in_blocks(spark, monkeypatch):
    """Keys of several blocks: with copies and far points, whole numbers, one slope for many pairs, and middle slopes far apart."""
    for name, value in (("SIZE", 64), ("SAMPLE", 110), ("DRAWN", 5_000), ("MOST", 3_000)):
        monkeypatch.setattr(robust, name, value)
    rng = random.Random(5)
    sets = {
        "far": [(math.exp(9 * rng.random()), rng.gauss(0, 1)) for _ in range(140)] * 2 + [(1e9, 5.0)], "whole": [(float(rng.randrange(30)), float(rng.randrange(9))) for _ in range(250)],
        "bleed": [(x, 0.03 * x + rng.randrange(3)) for x in (rng.uniform(900, 5e5) for _ in range(150))], "few": [(0.0, 0.0), (1.0, 3.0)],
        "fan": [(0.0, 0.0)] * 100 + [(1.0, 1.0)] * 50 + [(1.0, 2.0)] * 50 + [(1.0, 100.0 + i) for i in range(60)] + [(1.0, -100.0 - i) for i in range(60)],
    }
    rows = [(k, *p) for k, v in sets.items() for p in v]
    got = {r["the key"]: r["slope"] for r in robust.median_slope(spark.createDataFrame(rows, "`the key` string, x double, y double"), ["the key"], "x", "y").collect()}
    assert set(got) == set(sets)
    for k, v in sets.items():
        middle = float(np.median(slopes(v)))
        assert abs(got[k] - middle) <= 1e-9 * max(1, abs(middle)), (k, got[k], middle)


def test_slopes_below_equals_all_pairs(spark):
    """Blocks of x that cut one x in two, residuals on the edges of blocks, and weights."""
    rng = random.Random(6)
    points = sorted({(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(60)})
    w = [rng.randrange(1, 400) for _ in points]
    packed = lambda a, b: [np.array(v).tobytes() for v in zip(*points[a:b])] + [robust._bytes(np.array(w[a:b]))]
    blocks = spark.createDataFrame([("k", n, *map(bytearray, packed(a, a + 7))) for n, a in enumerate(range(0, len(points), 7))], "k string, xb long, x binary, y binary, w binary")
    ts = [-1.5, -1.0, 0.0, 0.3, 1.0, 7.0]
    probes = spark.createDataFrame([("k", 0, n, t, [-3.0, 0.0, 1.0, 2.0, 6.0]) for n, t in enumerate(ts)], "k string, part int, probe int, t double, edges array<double>")
    got = {r["probe"]: r["below"] for r in robust.slopes_below(blocks, ["k"], probes).collect()}
    pairs = [((q[1] - p[1]) / (q[0] - p[0]), w[i] * w[j]) for i, p in enumerate(points) for j, q in enumerate(points) if p[0] < q[0]]
    assert got == {n: sum(m for s, m in pairs if s < t) for n, t in enumerate(ts)}


def test_crosstalk_modes(spark):
    rng = random.Random(1)
    rows = [("few", 100.0 + i, 5.0 * i) for i in range(19)] + [("few", -5.0, 1.0), ("few", 7.0, None)]
    rows += [("bleed", x, 0.04 * x + rng.gauss(0, 0.1)) for x in (rng.uniform(100, 900) for _ in range(200))]
    rows += [("same", x, 1.1 * x + rng.gauss(0, 5)) for x in (rng.uniform(100, 900) for _ in range(200))]
    rows += [("down", x, -0.2 * x) for x in (rng.uniform(100, 900) for _ in range(40))] + [("none", 0.0, 1.0)]
    got = {r["w"]: r for r in robust.crosstalk_k(spark.createDataFrame(rows, "w string, s double, t double"), ["w"], "s", "t").collect()}
    assert (got["few"]["mode"], got["few"]["k"], got["few"]["n_sites"], got["few"]["fitted_slope"]) == ("insufficient-sites", 0.0, 19, None)
    assert got["bleed"]["mode"] == "auto" and abs(got["bleed"]["k"] - 0.04) < 0.005 and got["bleed"]["rho"] > 0.99
    assert got["same"]["mode"] == "implausible-slope" and got["same"]["k"] == 0.0 and got["same"]["fitted_slope"] > 1
    assert got["down"]["mode"] == "auto" and got["down"]["k"] == 0.0 and abs(got["down"]["fitted_slope"] + 0.2) < 1e-12 and abs(got["down"]["rho"] + 1) < 1e-12
    assert got["none"]["n_sites"] == 0 and got["none"]["mode"] == "insufficient-sites"


def test_average_ranks(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, -1.0] * 40
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0)], "k string, v double")
    ranks = {(r["k"], r["v"]): r["r"] for r in robust.average_ranks(df, ["k"], "v", "r").collect()}
    plain = sorted(values)
    assert all(ranks["a", v] == np.mean([i + 1 for i, w in enumerate(plain) if w == v]) for v in set(values)) and ranks["b", 5.0] == 1


def test_resampling(spark, monkeypatch):
    square = [(0, 0), (0, 2), (0, 2), (2, 2), (2, 0)]  # a repeated vertex
    rng = random.Random(2)
    rough = [(rng.random() * 9, rng.random() * 9) for _ in range(57)]
    rows = [("square", i, *map(float, p)) for i, p in enumerate(square)] + [("rough", i, *p) for i, p in enumerate(rough)] + [("small", i, 0.0, float(i)) for i in range(3)] + [("point", i, 1.0, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "cell string, i int, y double, x double")

    def plain(points, n):
        c = np.vstack([points, points[:1]]).astype(float)
        cum = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(c, axis=0), axis=1))])
        t = np.linspace(0, cum[-1], n, endpoint=False)
        return np.column_stack([np.interp(t, cum, c[:, 0]), np.interp(t, cum, c[:, 1])])

    for slot in (4096, 5):
        monkeypatch.setattr(outlines, "SLOT", slot)
        out = {}
        for r in outlines.resample_closed(df, ["cell"], "i", "y", "x", 16).collect():
            out.setdefault(r["cell"], []).append((r["cell"], r["k"], r["y"], r["x"]))
        assert set(out) == {"square", "rough"}
        for k, points in (("square", square), ("rough", rough)):
            got = sorted(out[k], key=lambda t: t[1])
            assert [g[1] for g in got] == list(range(16)) and np.allclose([g[2:] for g in got], plain(points, 16))


def test_width_profiles(spark):
    sets = {"a": [1.0, 3.0, 2.0, 5.0, 1.0], "two": [2.0, 4.0], "one": [7.0], "zero": [0.0, 0.0, 0.0]}
    df = spark.createDataFrame([(k, i, v) for k, s in sets.items() for i, v in enumerate(s)], "k string, i int, w double")
    got = {r["k"]: r for r in outlines.width_profile(df, ["k"], "i", "w").collect()}
    for k in ("a", "two", "zero"):
        s = np.array(sets[k])
        d = np.interp(np.linspace(0, 1, 200), np.linspace(0, 1, len(s)), s)
        g = got[k]
        fold = lambda i: min(i / 199, 1 - i / 199)
        mid = d[80:120].mean()
        expected = [np.median(d), d.mean(), d.max(), d.min(), d.std(), fold(int(d.argmax())), fold(int(d.argmin())), np.concatenate([d[:20], d[-20:]]).mean()]
        assert np.allclose([g[c] for c in g.asDict() if c not in ("k", "pole_taper")], expected)
        assert abs(g["pole_taper"] - (expected[-1] / mid if mid > 1e-9 else 0)) < 1e-9
    assert got["one"]["width_median"] == 7 and got["one"]["pole_taper"] is None


def image(spark, grid, label=None):
    rows = [("i", y, x, float(v), int(label[y][x]) if label is not None else 0) for y, row in enumerate(grid) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "image string, y int, x int, value double, label int")


def render(shape, places):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    return sum(a * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * s * s)) for y, x, a, s in places) + 10.0


def test_radial_centres_are_sub_pixel(spark):
    places = [(8.3, 9.6, 80.0, 1.4), (20.75, 15.2, 60.0, 1.3)]
    px = image(spark, render((30, 28), places))
    sites = spark.createDataFrame([("i", 1, 8, 10), ("i", 2, 21, 15), ("i", 3, 0, 27), ("i", 4, 99, 99)], "image string, site int, y int, x int")
    got = {r["site"]: r for r in spots.radial_centres(px, sites, ["image"], 4).collect()}
    for k, (y, x, _, s) in enumerate(places, 1):
        assert math.hypot(got[k]["y"] - y, got[k]["x"] - x) < 0.15 and abs(got[k]["sigma"] - s) < 0.4
    assert got[4]["y"] is None
    flat = spots.radial_centres(image(spark, np.ones((9, 9))), sites.limit(1), ["image"], 3).first()
    assert flat["y"] is None and flat["sigma"] == 0


def test_region_candidates_end_at_the_border(spark):
    """A brighter pixel of the next region hides none; of equal neighbours the first stays."""
    grid, label = np.zeros((6, 8)), np.zeros((6, 8), int)
    label[:, :4], label[:, 4:7] = 1, 2
    grid[2, 3], grid[2, 4] = 5, 50
    grid[5, 0], grid[5, 1], grid[0, 7] = 4, 4, 99
    got = {(r["label"], r["y"], r["x"], r["amplitude"]) for r in spots.region_candidates(image(spark, grid, label), ["image"], "label", 2, 1.5).collect()}
    assert got == {(1, 2, 3, 5.0), (2, 2, 4, 50.0), (1, 5, 0, 4.0)}


def test_object_contrast_of_touching_objects(spark):
    grid, label = np.full((9, 9), 10.0), np.zeros((9, 9), int)
    label[2:5, 2:4], label[2:5, 4:6] = 1, 2
    grid[2:5, 2:4], grid[2:5, 4:6] = 20.0, 5.0
    got = {r["label"]: r["contrast"] for r in spots.object_contrast(image(spark, grid, label), ["image"], "label").collect()}
    assert got == {1: 1.0, 2: 0.5}
    full = np.ones((3, 3), int)
    assert spots.object_contrast(image(spark, np.ones((3, 3)), full), ["image"], "label").first()["contrast"] is None


def test_atrous_planes_add_up(spark):
    grid = np.random.default_rng(5).random((11, 7))
    planes = {(r["y"], r["x"]): r["planes"] for r in spots.atrous_planes(image(spark, grid), ["image"], 3).collect()}
    w, current = np.array([1, 4, 6, 4, 1]) / 16, grid
    for k in range(3):
        nxt = current
        for axis in (0, 1):
            pad = [(2 * 2**k, 2 * 2**k) if a == axis else (0, 0) for a in (0, 1)]
            p = np.pad(nxt, pad, mode="symmetric")
            n = nxt.shape[axis]
            nxt = sum(c * np.take(p, np.arange(n) + j * 2**k, axis) for j, c in enumerate(w))
        assert all(abs(planes[y, x][k] - (current - nxt)[y, x]) < 1e-12 for y in range(11) for x in range(7))
        current = nxt


def test_wavelet_response_finds_spots(spark):
    places = [(10.0, 10.0, 90.0, 1.5), (22.0, 18.0, 60.0, 1.5)]
    noise = np.random.default_rng(1).normal(0, 1, (32, 30))
    out = {(r["y"], r["x"]): r["response"] for r in spots.atrous_response(image(spark, render((32, 30), places) + noise), ["image"]).collect()}
    top = sorted(out, key=out.get)[-1]
    assert math.hypot(top[0] - 10, top[1] - 10) < 1.5 and out[22, 18] > 0.2 and sum(v > 0 for v in out.values()) < 0.35 * len(out)
    with pytest.raises(ValueError, match="scales"):
        spots.atrous_response(image(spark, noise), ["image"], ())
    assert all(r["response"] == 0 for r in spots.atrous_response(image(spark, np.ones((6, 6))), ["image"]).collect())


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    x[5, 2] = np.nan
    rows = [(i, [float(v) for v in r] + [None]) for i, r in enumerate(x)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    c = components.fit_components(df, "v", 0.95)
    clean = np.nan_to_num(x)
    values, axes = np.linalg.eigh(np.cov(clean.T))
    share = values[::-1] / values.sum()
    take = int(np.searchsorted(np.cumsum(share), 0.95, side="right")) + 1
    assert c.kept == list(range(6)) and np.allclose(c.explains, share[:take]) and c.axes.shape == (6, take)
    scores = {r["id"]: r["s"] for r in components.reduce_vectors(df, "v", c, "s").collect()}
    expected = (clean - clean.mean(0)) @ axes[:, ::-1][:, :take]
    assert scores[999] is None and all(np.allclose(np.abs(scores[i]), np.abs(expected[i])) for i in range(300))
    assert components.fit_components(df, "v", above=100) is None and components.fit_components(df.limit(0), "v") is None
    plain = components.reduce_vectors(df.filter("id = 5"), "v", None, "s").first()["s"]
    assert plain[2] == 0 and plain[6] == 0


def clouds(spark, names):
    rng = np.random.default_rng(9)
    rows = [(n * 100 + i, f"run{i % 2}", name, [float(v) for v in rng.normal(n, 1, 4)]) for n, name in enumerate(names) for i in range(12)]
    return spark.createDataFrame(rows, "id long, run string, cond string, v array<double>")


def test_distance_job_computes_what_is_lacking(spark, tmp_path):
    path = f"file://{tmp_path}/distances"
    job = lambda df, **o: transport_job.distance_job(spark, df, path, "run", "cond", "id", "v", F.col("cond") == "NT", **{"version": "1", "merge": True, **o})
    assert job(clouds(spark, ["a"])) is None and results.read_manifest(spark, path) is None
    first = job(clouds(spark, ["NT", "a", "b_R1"]))
    assert first.added == 6 and first.mismatch is None  # NT of two runs, a and b
    assert {(r["key"], r["run_id"]) for r in first.groups.collect()} == {("run0::NT", "run0"), ("run1::NT", "run1"), ("a", "run0,run1"), ("b", "run0,run1")}
    assert job(clouds(spark, ["NT", "a", "b_R1"])).added == 0
    more = job(clouds(spark, ["NT", "a", "b_R1", "c"]))
    assert more.added == 4 and more.pairs.count() == 10
    old = {(r["i"], r["j"]): r["distance"] for r in first.pairs.collect()}
    assert all(abs(d - old[k]) < 1e-12 for k, d in {(r["i"], r["j"]): r["distance"] for r in more.pairs.collect()}.items() if k in old)
    other = job(clouds(spark, ["NT", "a", "b_R1", "c"]), dims=2)
    assert other.mismatch == "dims: 0 -> 2" and other.added == 10
    assert job(clouds(spark, ["NT", "a", "b_R1"]), dims=2).pairs.count() == 6


def test_a_killed_write_leaves_the_old_results(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    with pytest.raises(FileNotFoundError):
        results.read_results(spark, path)
    boom = spark.range(3).select(F.raise_error(F.lit("killed")).cast("int").alias("x"))
    with pytest.raises(Exception, match="killed"):
        results.write_results({"a": spark.range(2), "z": boom}, path, {})
    assert results.read_manifest(spark, path) is None
    results.write_results({"a": spark.range(2), "none": spark.range(0)}, path, {"species": "x"})
    with pytest.raises(Exception, match="killed"):
        results.write_results({"a": spark.range(9), "z": boom}, path, {})
    out = results.read_results(spark, path)
    assert sorted(out) == ["a", "none"] and out["a"].count() == 2 and out["none"].count() == 0 and results.read_manifest(spark, path)["species"] == "x"
    assert any(f.endswith(".csv") for f in os.listdir(f"{tmp_path}/results/{results.read_manifest(spark, path)['version']}"))
    with pytest.raises(ValueError, match="no result"):
        results.write_results({}, path, {})


def test_learning_curve(spark):
    rng = random.Random(4)
    rows = [(i, float(i % 2) + rng.gauss(0, 0.4), i % 2, "train" if i % 4 else "test") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, y int, split string")
    train = lambda d, f, label, split: models.train_feature_model(d, f, label, split, rounds=3, depth=2)
    curve = models.learning_curve(df.withColumn("y", F.when(F.col("split") == "test", (F.col("id") / 4 % 2).cast("int")).otherwise(F.col("y"))), ["a"], "y", "split", "id", 2, train=train).orderBy("fraction").collect()
    assert [(r["n"], r["n_good"] + r["n_bad"]) for r in curve] == [(30, 30), (300, 300)] and all(0 <= r["roc_auc"] <= 1 for r in curve)
    with pytest.raises(ValueError, match="hold-out"):
        models.learning_curve(df.filter("split = 'train'"), ["a"], "y", "split", "id", 2)
    with pytest.raises(ValueError, match="both classes"):
        models.learning_curve(df.filter("split = 'test' OR y = 1"), ["a"], "y", "split", "id", 2)


def test_provenance(spark):
    rows = [('{"stage": "classify", "model": {"sha256": "s"}}', "x"), ('{"stage": "classify"}', "x"), ('{"stage": "segment", "model": {"sha256": "s"}}', "x"), ("{broken", "03_classify"), (None, "02_segment"), ("[]", "x"), ('{"stage": "crops"}', "a_segment")]
    got = [tuple(r["p"]) for r in spark.createDataFrame(rows, "s string, f string").select(P.input_provenance(F.col("s"), F.col("f")).alias("p")).collect()]
    assert got == [("classify", "cnn", "s"), ("classify", "rules", ""), ("segment", "none", ""), ("classify", "unknown", ""), ("segment", "none", ""), ("unknown", "unknown", ""), ("segment", "none", "")]
    stages = '{"stages": [{"name": "classify"}, {"name": "Features", "opts": {"mask_background": "yes"}}]}'
    rows = [(stages, {}), (stages, {"mask_background": "false"}), (stages, {"classifier_prefilter": "rules"}), (None, {"extract_options": '{"mask_background": true}'}), ("{", {})]
    o = spark.createDataFrame(rows, "m string, a map<string,string>").select(P.crop_options(F.col("m"), F.col("a")).alias("o"))
    got = [(tuple(r["o"]), r["w"]) for r in o.select("o", P.crop_warnings(F.col("o")).alias("w")).collect()]
    assert got[0] == ((True, True, None, None, "manifest"), ["masked", "perhaps_filtered"]) and got[1][0][:2] == (False, True)
    assert got[2] == ((True, False, "rules", None, "manifest"), ["masked"]) and got[3] == ((True, None, None, None, "attributes"), ["masked"]) and got[4] == ((None,) * 5, [])


def test_review_sample(spark):
    s = spark.createDataFrame([(f, i) for f in "ab" for i in range(5 if f == "a" else 2)], "file string, scene int")
    assert sorted(r["file"] for r in ranking.review_sample(s, "file", "scene", 3, 1).collect()) == ["a"] * 3 + ["b"] * 2
    assert ranking.review_sample(s, "file", "scene", 3, 1, [1, 0, 1]).count() == 4
    with pytest.raises(ValueError, match=r"not present in b: \[4\]"):
        ranking.review_sample(s, "file", "scene", 3, 1, [1, 4])
    with pytest.raises(ValueError, match="no scenes"):
        ranking.review_sample(s.limit(0), "file", "scene", 3, 1)


def test_percentiles_agree_whatever_the_size(spark, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(k, rng.gauss(0, 1) if rng.random() < 0.8 else 1.0, None) for k in ("a", None) for _ in range(3000)] + [("n", None, None)], "k string, v double, w double")
    wanted = {"m": ("v", 0.5), "p": ("v", 0.95), "n": ("w", 0.5)}
    plain = {r["k"]: r for r in quantiles.percentiles(df, ["k"], wanted).collect()}
    monkeypatch.setattr(quantiles, "ALONE", 10)
    spread = {r["k"]: r for r in quantiles.percentiles(df, ["k"], wanted).collect()}
    assert set(plain) == set(spread) == {"a", None, "n"}
    assert all((plain[k][c] is None and spread[k][c] is None) or abs(plain[k][c] - spread[k][c]) < 1e-12 for k in plain for c in wanted)


def test_roc_starts_above_all_scores(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.2), ("b", 1, 0.5), ("c", 0, 0.1), ("c", 1, 0.05)], "k string, y int, s double")
    first = {r["k"]: (r["score"], r["tp"], r["fp"]) for r in ranking.roc_curve(df, "y", "s", ["k"]).filter("score = double('infinity')").collect()}
    assert first == {k: (float("inf"), 0, 0) for k in "abc"}
    got = {r["k"]: r for r in ranking.auc(df, "y", "s", ["k"]).collect()}
    assert got["a"]["auc"] == 0.25 and abs(got["a"]["prevalence"] - 2 / 3) < 1e-12 and got["b"]["auc"] is None and got["c"]["auc"] == 0 and got["c"]["youden"] == float("inf")


def test_labels_are_numbered_in_order(spark):
    rows = [("x", "A", 2), ("x", "A", 10), ("x", "B", 1), ("y", "A", 1), (None, "A", 3), (None, "C", 3)]
    df = spark.createDataFrame(rows, "l string, letter string, number int")
    got = {(r["letter"], r["number"]): r["t"] for r in joins.disambiguate(df, ["l"], [F.col("letter"), F.col("number")], "t").collect()}
    assert got == {("A", 2): "x_1", ("A", 10): "x_2", ("B", 1): "x_3", ("A", 1): "y", ("A", 3): "_1", ("C", 3): "_2"}


def test_pair_distances_over_shared_dimensions(spark, monkeypatch):
    monkeypatch.setattr(joins, "PROFILES", 3)
    rng = random.Random(6)
    own = {f"p{i}": {d: rng.gauss(0, 1) for d in "abcde" if rng.random() < 0.8} for i in range(11)} | {"zero": {"a": 0.0}, "lone": {"z": 1.0}}
    long = spark.createDataFrame([(k, d, v) for k, ds in own.items() for d, v in ds.items()] + [("p0", "q", None)], "k string, d string, v double")
    got = {(r["i"], r["j"]): (r["euclidean"], r["cosine"]) for r in joins.pair_distances(long, "k", "d", "v").collect()}
    for i in own:
        for j in own:
            both = sorted(set(own[i]) & set(own[j]))
            if i < j and both:
                x, y = np.array([own[i][d] for d in both]), np.array([own[j][d] for d in both])
                assert abs(got[i, j][0] - np.linalg.norm(x - y)) < 1e-12
                size = np.linalg.norm(x) * np.linalg.norm(y)
                assert (got[i, j][1] is None) if not size else abs(got[i, j][1] - (1 - x @ y / size)) < 1e-12
    assert not any("lone" in k for k in got)


def test_wide_and_long_distances(spark):
    groups = spark.createDataFrame([(f"g{i}", i) for i in range(12)], "key string, place int")
    pairs = spark.createDataFrame([(f"g{i}", f"g{j}", float(10 * i + j)) for i in range(12) for j in range(i + 1, 12)], "i string, j string, d double")
    wide = tables.wide_distances(pairs, groups, "place", "d")
    assert wide.columns == ["key", "place"] + [f"d_{n}" for n in range(12)] and wide.filter("key = 'g3'").first()["d_11"] == 41 and wide.filter("key = 'g3'").first()["d_3"] == 0
    back = tables.long_distances(wide, "place")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in pairs.collect()}


def test_tables(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("Scheme A\tGENE\t_note\tempty\nx\t Abc \tn\t\ny\tabc\tn\tnan\n\tdef\tn\t\n")
    assert {tuple(r) for r in tables.read_groups(spark, str(tmp_path / "g.tsv")).collect()} == {("Scheme A", "abc", "y")}
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no column gene"):
        tables.read_groups(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "log.csv").write_text("cell_uid,label_idx,label_name,labeled_at,split\nc1,1,good,2024-01-01T00:00:00,\nc2,x,bad,,test\n,0,bad,,\n")
    rows, counts = tables.valid_labels(tables.read_labels(spark, str(tmp_path / "log.csv")))
    assert [r["cell_uid"] for r in rows.collect()] == ["c1"] and tuple(counts.first()) == (3, 2)
    spark.createDataFrame([("c1", 1)], "cell_uid string, label_idx int").write.parquet(f"{tmp_path}/labels")
    tables.append_labels(spark.createDataFrame([("c2", 0, "test")], "cell_uid string, label_idx int, split string"), f"{tmp_path}/labels")
    assert {(r["cell_uid"], r["split"], r["model_at_label"]) for r in tables.read_label_table(spark, f"{tmp_path}/labels").collect()} == {("c1", "train", "none"), ("c2", "test", "none")}
    same = spark.createDataFrame([(f, n, v) for f in (1, 2) for n, v in (("a", "x"), ("b", str(f)))] + [(1, "c", "y")], "file int, name string, value string")
    assert [tuple(r) for r in tables.shared_attributes(same, 2).collect()] == [("a", "x")]
    cells = spark.createDataFrame([("r1", "b"), ("r1", "a"), ("r1", "a"), ("r2", None)], "run string, cond string")
    assert {tuple(r) for r in tables.run_row(cells, "run", "cond").collect()} == {("r1", 3, 2, "a,b"), ("r2", 1, 0, "")}
    index = spark.createDataFrame([("r1", "x")], "run_id string, species string")
    changed, found = tables.update_run(index, "r1", {"species": "y"})
    assert found and changed.first()["species"] == "y" and not tables.update_run(index, "r9", {"species": "y"})[1]
    with pytest.raises(ValueError, match="no such fields"):
        tables.update_run(index, "r1", {"nope": "y"})


def test_labels_of_a_split(spark):
    cells = spark.createDataFrame([("a",)], "uid string")
    labels = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "uid string, split string")
    found, missing = joins.labelled_rows(cells, labels, "uid", "train")
    assert found.count() == 1 and missing.count() == 1
    with pytest.raises(ValueError, match="no labelled cell"):
        joins.labelled_rows(cells, labels, "uid", "test")
    layout = spark.createDataFrame([("A1", "x"), ("A2", "y")], "well string, drug string")
    assert {tuple(r) for r in joins.set_fields(layout, "well", ["A2"], {"drug": "z"}).collect()} == {("A1", "x"), ("A2", "z")}


def plain_transport(a, b, reg):
    """Scaling of the kernel itself, to the end."""
    cost = ((a[:, None] - b[None]) ** 2).sum(2)
    kernel, u, v = np.exp(-cost / reg), np.ones(len(a)), np.ones(len(b))
    for _ in range(5000):
        v = (1 / len(b)) / (kernel.T @ u)
        u = (1 / len(a)) / (kernel @ v)
    return float((u[:, None] * kernel * v * cost).sum())


def test_transport_matrix_equals_plain_scaling(spark, monkeypatch):
    monkeypatch.setattr(transport, "BLOCK", 2)
    rng = np.random.default_rng(11)
    sets = {f"k{n}": rng.normal(n % 3, 1, (8 + n, 3)) for n in range(5)}
    cloud = spark.createDataFrame([(k, [[float(x) for x in p] for p in v]) for k, v in sets.items()], "key string, points array<array<double>>")
    got = {(r["i"], r["j"]): (r["divergence"], r["distance"]) for r in transport.sinkhorn_matrix(cloud, absolute=1.5).collect()}
    assert set(got) == {(a, b) for a in sets for b in sets if a < b}
    for (i, j), (d, root) in got.items():
        a, b = sets[i], sets[j]
        plain = max(0.0, plain_transport(a, b, 1.5) - (plain_transport(a, a, 1.5) + plain_transport(b, b, 1.5)) / 2)
        assert abs(d - plain) < 1e-3 * max(1, plain) and abs(root - math.sqrt(d)) < 1e-12


def test_permutations_tell_apart_clouds_from_like_ones(spark):
    rng = np.random.default_rng(12)
    sets = {"a": rng.normal(0, 1, (15, 2)), "far": rng.normal(9, 1, (15, 2)), "like": rng.normal(0, 1, (15, 2))}
    cloud = spark.createDataFrame([(k, [[float(x) for x in p] for p in v]) for k, v in sets.items()], "key string, points array<array<double>>")
    pairs = spark.createDataFrame([("a", "far"), ("a", "like"), ("a", "gone")], "query string, match string")
    got = {r["match"]: r["p_perm"] for r in transport.permutation_test(cloud, pairs, n_perm=99).collect()}
    # p counts shuffles at most as far apart as the data: all of them for clouds far apart, some for clouds alike; pairs without a cloud have none.
    assert set(got) == {"far", "like"} and got["far"] == 1.0 and 0.01 < got["like"] < 1.0


def test_corrected_p_values(spark, monkeypatch):
    """One family without a name, ties over the edges of ranges, null p, and null families."""
    monkeypatch.setattr(ranking, "RANGES", 4)
    rng = random.Random(13)
    rows = [(i, rng.choice(["a", None]), rng.choice([0.001, 0.01, 0.2, 0.2, 1.0, rng.random()])) for i in range(120)] + [(999, "a", None)]
    df = spark.createDataFrame(rows, "id long, f string, p double")

    def plain(ps):
        order = sorted(range(len(ps)), key=lambda i: ps[i])
        q, least = [0.0] * len(ps), 1.0
        for k in range(len(ps), 0, -1):
            least = min(least, ps[order[k - 1]] * len(ps) / k)
            q[order[k - 1]] = least
        return q

    for family in ([], ["f"]):
        got = {r["id"]: r["q"] for r in ranking.benjamini_hochberg(df, "p", family).collect()}
        assert len(got) == 121 and got[999] is None
        for key in ("a", None) if family else ("all",):
            own = [r for r in rows if r[2] is not None and (not family or r[1] == key)]
            assert np.allclose([got[r[0]] for r in own], plain([r[2] for r in own]))


def test_a_midline_is_measured_in_one_row(spark):
    """No generated place is sent, and long midlines and null widths give the values of all places."""
    draw = np.random.default_rng(3)
    long = draw.random(1000).tolist()
    df = spark.createDataFrame([("long", i, v) for i, v in enumerate(long)] + [("gap", i, v) for i, v in enumerate([1.0, None, 3.0, 2.0])] + [("none", 0, None), ("none", 1, None)], "k string, i int, w double")
    p = outlines.width_profile(df, ["k"], "i", "w")
    plan = p._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    got = {r["k"]: r for r in p.collect()}
    for k in ("long", "gap"):
        d = np.array([r["value"] for r in outlines.densify(df.filter(f"k = '{k}'"), ["k"], "i", "w").filter("value IS NOT NULL").orderBy("k").collect()])
        assert np.allclose([got[k]["width_median"], got[k]["width_mean"], got[k]["width_max"], got[k]["width_std"]], [np.median(d), d.mean(), d.max(), d.std()])
    d = np.interp(np.linspace(0, 1, 200), np.linspace(0, 1, 1000), long)
    assert np.allclose([got["long"][c] for c in ("width_mean", "pole_width", "width_pos_max")], [d.mean(), np.r_[d[:20], d[180:]].mean(), min(d.argmax() / 199, 1 - d.argmax() / 199)])
    assert got["none"]["width_mean"] is None and got["none"]["pole_width"] is None
