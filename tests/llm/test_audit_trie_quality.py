"""Filter audit, prefix trie and quality against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phenoframe.llm import filter_audit as A
from phenoframe.llm import prefix_trie as P
from phenoframe.llm import language_id, token_files, toxicity, url_filter
from phenoframe.llm import quality as Q
from phenoframe.llm import queries
from phenoframe.llm import textops as T

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_prefix_trie"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    rel = c.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*rel.columns).collect()))) == sorted(map(str, rel.fetchall()))


# --- filter audit


def test_positional_popcounts_equal_plain_counts():
    rng = np.random.default_rng(1)
    for size, groups in ((0, 3), (1, 1), (15, 1), (16, 2), (4000, 7)):
        words, group = rng.integers(0, 1 << 32, size, dtype=np.uint32), rng.integers(0, groups, size)
        times = rng.integers(1, 100, size)
        plain = np.zeros((groups, 32), int)
        for w, g, n in zip(words.tolist(), group.tolist(), times.tolist(), strict=True):
            plain[g] += n * np.array([w >> b & 1 for b in range(32)])
        assert (A.weighted_popcounts(words, times, group, groups, 32) == plain).all()


def test_truth_words():
    words = A.truth_words(5)
    assert words[0] == (1 << 32) - 1 and words[31] == 1
    assert all((words[f] >> s) & 1 == (not f & s) for f in range(32) for s in range(32))


def audit_brute(docs, labels):
    rows, fails = [], []
    for i, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        bad = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        good, toxic = (any(r[0] == i and r[k] == 1 for r in labels) and i is not None for k in (1, 2))
        fails.append(((source or ""), bad, good, toxic))
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        out = []
        for order in permutations("ABCDE"):
            left, gone = own, []
            for k, f in enumerate(order):
                here = [x for x in left if x[1][f]]
                kept = [x for x in left if not x[1][f]]
                only = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                out.append(["".join(order), k + 1, len(kept), len(here), sum(x[1][f] for x in gone), only, sum(x[2] for x in here), sum(x[3] for x in here), f])
                shapley[f] += len(here)
                left, gone = kept, gone + here
        rows += [(part, *r[:-1], shapley[r[-1]]) for r in out]
    return sorted(rows)


def test_audit_of_an_untidy_table(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [
        (1, long, "a"), (2, long, "a"), (2, long, "a"), (3, long, None), (None, long, "a"), (None, long, "a"), (4, None, "a"), (5, "", ""), (6, "same " * 900, "b"),
        (7, "SHOUT " * 250, "b"), (8, long + " | x", "b"), (9, long * 300, "a"), (0, long, "c"), (6, "other", "b"), (-3, "same " * 900, "b"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (6, None, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1), (9, 0, 0)]
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, source string, word string, n int, digest int")
    lb = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, part int")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    own = A.filter_audit(df, lb)
    assert own.columns == columns
    assert sorted(tuple(r) for r in own.collect()) == audit_brute(docs, labels)
    assert A.filter_audit(df.limit(0), lb).count() == 0
    assert A.filter_audit(df, lb.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


# --- prefix trie


def trie_brute(turns, fork):
    own = {}
    for c, t, r, x in turns:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [m for *_, m in sorted(v)] for c, v in own.items()}
    built = {}
    for c, ms in own.items():
        b, h = fork(c)
        built[c] = own.get(b, [])[:h] + ms[h:]
    members = {}
    for c, ms in built.items():
        for d in range(len(ms) + 1):
            members.setdefault(tuple(ms[:d]), []).append(c)
    rows = []
    for node, cs in members.items():
        sub = [n for n in members if n[: len(node)] == node]
        kids = [n for n in sub if len(n) == len(node) + 1]
        leaves = [n for n in sub if not any(m[:-1] == n and m for m in members)]
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in sub if n)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(node))))
        rows.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def forked(c):
    return c - c % 20, zlib.crc32(str(c).encode()) % 4


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(df, plain=False):
    base, taken = F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    out = P.with_digests(P.prefix_trie(df) if plain else P.prefix_trie(df, base, taken))
    return sorted((tuple(r) for r in out.select(COLUMNS).collect()), key=str)


def untidy_turns():
    rng = np.random.default_rng(4)
    turns = []
    for c in [*range(0, 70), 105, 106, 107, 108, 109, 110]:  # 100 is absent
        for t in range(int(rng.integers(1, 6))):
            turns.append((c, t, ["user", "assistant"][t % 2], str(rng.choice(["a b", "c", "d  e\tf", "", "g"]))))
    turns += [(20, None, "user", "first"), (20, None, None, None), (21, 1, "user", "tie"), (21, 1, "user", "tie"), (None, 0, "user", "lost"), (22, 9, "user", "w " * 50000)]
    turns += [(c, t, "u", f"long {t}") for c in (200, 220, 221) for t in range(150)]
    return [turns[i] for i in rng.permutation(len(turns))]


def test_trie_of_untidy_conversations(spark):
    turns = untidy_turns()
    df = spark.createDataFrame([(*t, 1, 2) for t in turns], "conv_id long, turn int, role string, text string, depth int, s1 int").repartition(7)
    assert trie_of(df) == trie_brute(turns, forked)
    assert trie_of(df, plain=True) == trie_brute(turns, lambda c: (c, 0))
    assert trie_of(df.limit(0)) == []


def test_a_full_sketch_and_an_open_one_agree(spark, monkeypatch):
    """With next to no cells all prefixes take the exact way."""
    turns = untidy_turns()
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    monkeypatch.setattr(P, "_cells", lambda high, low, width: np.zeros((2, len(high)), np.int64))
    assert trie_of(df) == trie_brute(turns, forked)


def test_the_sketch_never_takes_a_shared_prefix_for_one_of_its_own(spark):
    """Screened rows are prefixes of one conversation, and almost all of those are screened."""
    state = [[c // 3 if k < 1 else 10000 * k + c for k in range(3)] for c in range(3000)]
    rows = [(c, 1 + k, s[k], s[k] + 7, s[k - 1] if k else 0, s[k - 1] + 7 if k else 0, 0, 1, 3, 3) for c, s in enumerate(state) for k in range(3)]
    df = spark.createDataFrame(rows, P._PREFIX)
    single = [r for r in P.screened(df).collect() if r["single"]]
    assert all(r["depth"] > 1 for r in single) and len(single) > 0.97 * 6000


def test_hot_conversations_are_numbered_across_ranges(spark):
    turns = [(5, t, "u", str(t)) for t in range(3000)] + [(c, 0, "u", "x") for c in range(4)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = {(r["conv_id"], r["rank"]): ((r["s1"] << 64) | (r["s2"] & P._LOW), r["before"]) for r in P.scanned(df, "conv_id", "turn", "role", "text").collect()}
    state = 0
    for t in range(3000):
        state = (state * P.FACTOR + int.from_bytes(hashlib.md5(f"1:u{t}".encode()).digest(), "big")) % P.PRIME
        assert got[5, t + 1] == (state, t)
    assert len(got) == 3004


# --- quality


def block(texts):
    return next(T.blocks(pa.array(texts, pa.large_string())))[2:]


def test_features_of_a_text():
    """Kinds and lengths have a sum of squares of one each; a repeated word's shape is the same whatever the word."""
    row, bucket, value = Q.features(*block(["Ab ab!! ab!! 77 x", "", "one"]))
    assert np.allclose(np.bincount(row, value**2, 3), [5, 0, 2])
    one, two = (Q.features(*block([t])) for t in ("foo foo foo foo", "bar bar bar bar"))
    shared = set(one[1].tolist()) & set(two[1].tolist())
    assert len(shared) >= 3
    alone = Q.features(*block(["Ab ab!! ab!! 77 x"]))
    assert sorted(alone[1].tolist()) == sorted(bucket[row == 0].tolist())


def test_updates_equal_the_textbook_loop():
    rng = np.random.default_rng(2)
    m = Q.Leader()
    z, n = {}, {}
    bias = 1 << Q.BITS

    def weight(i):
        l1 = 0.0 if i == bias else m.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((m.beta + math.sqrt(n[i])) / m.alpha + m.l2)

    for _ in range(60):
        x = rng.choice(20, 6, replace=False)
        v, y = rng.random(6), int(x.sum() % 2)
        m.learn(x.astype(np.int64), v, y)
        items = [*zip(x.tolist(), v.tolist(), strict=True), (bias, 1.0)]
        p = 1 / (1 + math.exp(-sum(weight(i) * a for i, a in items)))
        for i, a in items:
            w, g = weight(i), (p - y) * a
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / m.alpha
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w, n.get(i, 0.0) + g * g
    assert all(abs(m.z[i] - z[i]) < 1e-9 and abs(m.n[i] - n[i]) < 1e-9 for i in z)
    w = m.weights(np.arange(len(m.z)))
    assert all(abs(w[i] - weight(i)) < 1e-9 for i in z) and (w != 0).sum() <= len(z)


def test_scores_equal_explicit_dot_products():
    rng = np.random.default_rng(3)
    w = rng.normal(size=(1 << Q.BITS) + 1)
    row, bucket, value = Q.features(*block(["a b c a", "", "x " * 500]))
    got = Q.score(w, row, bucket, value, 3)
    for i in range(3):
        y = w[-1] + sum(w[b] * v for r, b, v in zip(row.tolist(), bucket.tolist(), value.tolist(), strict=True) if r == i)
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, y))))) < 1e-12


def test_quality_of_an_untidy_table(spark):
    good, bad = "the calm text goes on in lines", "BUY!! NOW!! ***"
    docs = [(i, (good if i % 3 else bad) + f" {i}", "x", 1.0) for i in range(300)]
    docs += [(1000, None, None, 0.0), (1001, "", None, 0.0), (None, good, None, 0.0), (1, good + " 1", "x", 1.0), (1002, good + " x" * 200000, None, 0.0), (1003, bad * 5, None, 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 9) for i in range(300)] + [(1, 7, 9), (None, None, 9)], "doc_id long, quality int, id int")
    rows = Q.quality(df, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert all(r["held_out"] == (zlib.crc32(str(i if i is not None else "").encode()) % 5 == 0) for i, r in by.items())
    held = [(i, r["predicted"]) for i, r in by.items() if i is not None and i < 300 and r["held_out"]]
    assert held and all(p == int(i % 3 > 0) for i, p in held)
    assert by[1000]["score"] == by[1001]["score"] and by[None]["predicted"] == 1 and by[1003]["predicted"] == 0
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert Q.quality(df.limit(0), labels).count() == 0
    assert {r["score"] for r in Q.quality(df, labels.limit(0)).collect()} == {0.5}
    again = {r["doc_id"]: r["score"] for r in Q.quality(df.repartition(5), labels).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in by.items())


def test_held_out_quality(spark):
    df = queries.op13_quality(spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = df.select("quality", "predicted").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) >= 0.95 * len(rows)


# --- earlier operators against plain loops


def test_a_long_host_is_split_like_a_short_one(spark):
    """10^5 letters within seconds, a word across two pieces and one longer than what is kept behind a place included."""
    import time

    giant = "ab" * 40
    words = {"cheap": 50, "pills": 40, "che": 2, "news": 30, giant: 3, giant + "zz": 2, "é" * 60: 1}
    table = spark.createDataFrame(list(words.items()), "w string, n long")
    hosts = ["cheapnews.com", "x" * 254 + "cheappills.com", giant + "cheap.org", "cheappillsnews" * 7000 + ".net", "é" * 60 + "news." + giant + "z"]
    began = time.time()
    got = {r["host"]: r["words"] for r in url_filter.segmented(spark.createDataFrame([(h,) for h in hosts], "host string"), table).collect()}
    assert time.time() - began < 60
    segmenter = url_filter.Segmenter([(w, n) for w, n in words.items()], sum(words.values()) + 1)
    for h in hosts:
        assert got[h] == [w for part in re.findall(url_filter._PARTS, h) for w in segmenter.split(part)]


def test_toxicity_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    index = np.sort(rng.choice(1 << toxicity.BITS, 40, replace=False))
    m = toxicity.FactorizationMachine(-0.3, index, rng.normal(0, 0.5, 40).astype(np.float32), rng.normal(0, 0.3, (40, 4)).astype(np.float32))
    docs = [index[:7], index[5:30], np.array([1, 2, 3]), np.zeros(0, np.int64), index[[3, 3, 9]]]
    got = m.score(np.repeat(np.arange(5), [len(d) for d in docs]), np.concatenate(docs).astype(np.int64), 5)
    for d, g in zip(docs, got, strict=True):
        at = [int(np.searchsorted(index, b)) for b in sorted(set(d.tolist())) if b in index]
        y = m.bias + sum(float(m.w[i]) for i in at) + sum(float(m.v[i].astype(float) @ m.v[j].astype(float)) for n, i in enumerate(at) for j in at[n + 1 :])
        assert abs(g - 1 / (1 + math.exp(-y))) < 1e-6


def test_the_toxicity_sample_is_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(i, 0, bytes(4 * (i % 5 + 1))) for i in range(50)], "id long, label int, terms binary")
    draw = F.xxhash64("id")
    taken = toxicity.taken_rows(rows, draw, 200)
    order = [r["id"] for r in rows.orderBy(draw).collect()]
    assert 0 < sum(len(r["terms"]) for r in taken) <= 200 and {r["id"] for r in taken} == set(order[: len(taken)])
    assert len(toxicity.taken_rows(rows, draw, 10**6)) == 50 and toxicity.taken_rows(rows, draw, 0) == []


def test_language_tags_equal_a_loop_over_bytes():
    """Both directions byte by byte with every unit spelled out, then the mean over a text's bytes."""
    texts = ["Ein Text", "", "x é" * 40]
    tagger = language_id.ByteTagger(["de", "en", "fr"], hidden=3)
    soft = lambda v: v / (1 + abs(v))

    def states(layer, window):
        own, out, n = [0.0] * 3, [], range(3)
        p = {k: v.astype(float) for k, v in layer.p.items()}
        for byte in window:
            z = [0.5 + 0.5 * soft(p["xz"][byte][j] + sum(own[i] * p["uz"][i][j] for i in n)) for j in n]
            r = [0.5 + 0.5 * soft(p["xr"][byte][j] + sum(own[i] * p["ur"][i][j] for i in n)) for j in n]
            c = [soft(p["xc"][byte][j] + sum(r[i] * own[i] * p["uc"][i][j] for i in n)) for j in n]
            own = [own[j] + z[j] * (c[j] - own[j]) for j in n]
            out.append(own)
        return out

    data, offsets = block(texts)
    pooled = tagger.pool(data, offsets)
    for k, t in enumerate(texts):
        raw, sums = t.encode(), np.zeros(3)
        for at in range(0, len(raw), language_id.WINDOW):
            window = raw[at : at + language_id.WINDOW]
            padded = window.ljust(language_id.WINDOW, bytes(1))
            f, b = states(tagger.forward, padded), states(tagger.backward, padded[::-1])[::-1]
            for i in range(len(window)):
                e = [math.exp(sum((f[i] + b[i])[h] * float(tagger.head[h][m]) for h in range(6)) + float(tagger.bias[m])) for m in range(3)]
                sums += np.array(e) / sum(e)
        assert np.allclose(pooled[k], sums / max(1, len(raw)), atol=1e-4)


def test_sequences_are_views_of_the_file(tmp_path):
    """Any sequence by its number, its mask telling ids from padding, without a copy of either."""
    ids = np.random.default_rng(3).integers(0, 50000, 16 * token_files.BATCH + 37)
    w = token_files.ShardWriter(f"file://{tmp_path}", 4, pa.uint16(), sequence=16)
    for part in np.array_split(ids, 7):
        w.add(part)
    w.close()
    before = pa.total_allocated_bytes()
    shard = token_files.ShardReader(f"file://{tmp_path}", 4)
    assert len(shard) == token_files.BATCH + 3
    kept = [shard[i] for i in range(len(shard))]
    assert pa.total_allocated_bytes() - before < 4096  # neither ids nor masks were copied
    flat = np.concatenate([x for x, _ in kept])
    mask = np.concatenate([m.to_numpy(zero_copy_only=False) for _, m in kept])
    assert (flat[mask] == ids).all() and not flat[~mask].any() and mask.sum() == len(ids)
    with pytest.raises(IndexError):
        shard[len(shard)]
    empty = token_files.ShardWriter(f"file://{tmp_path}", 5, pa.uint16())
    empty.close()
    assert len(token_files.ShardReader(f"file://{tmp_path}", 5)) == 0
