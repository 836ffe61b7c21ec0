"""The pipeline against a brute-force version of its stages on a small table."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

pytest.importorskip("phenoframe.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_keep_what_they_should(spark, tmp_path):
    rng = random.Random(2)
    word = {"en": ["the", "and", "thing", "was", "with"], "de": ["und", "der", "schön", "über", "nicht"]}
    rows = []
    for i in range(200):
        lang = ["en", "de"][i % 2]
        body = " ".join(f"{rng.choice(word[lang])}{rng.choice(word[lang])}" for _ in range(rng.randint(30, 80)))
        rows.append((i, body, lang, f"src{i % 3}", len(body)))
    rows.append((200, rows[0][1].upper(), "en", "src0", 1))
    rows.append((201, rows[1][1] + " nochwas", "de", None, 1))
    rows += [(202, None, "en", "src0", None), (203, "123 456", "en", "src1", 7), (204, "", None, "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert sorted(kept["language_id"]) == list(range(202))
    assert sorted(kept["exact_dedup"]) == [i for i in range(202) if i != 0]
    assert sorted(kept["ngram_join"]) == [i for i in range(201) if i != 0]
    from collections import Counter

    times = Counter(kept["mixing"])
    assert max(times.values()) <= 3 and set(times) <= set(kept["ngram_join"])
    assert sorted(kept["bpe"]) == sorted(kept["mixing"])

    from tokenizers import Tokenizer

    from phenoframe.llm.bpe import default_tokenizer

    t, text = Tokenizer.from_file(default_tokenizer()), {r[0]: r[1] for r in rows}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == times
    for r in got[:50]:
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _stages(spark, tmp_path, rows):
    """The rows after each stage but the last."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in docs.collect())
    return kept


def _body(rng, n=40):
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(n))


def test_repeated_rows(spark, tmp_path):
    """A row that stands eight times leaves exact dedup once; different texts of one id neither merge nor multiply."""
    rng = random.Random(4)
    rows = [(i, _body(rng), "en", f"src{i % 2}", 1) for i in range(40)]
    rows += [(7, rows[7][1], "en", "src1", 1)] * 7 + [(8, _body(rng), "en", "src0", 1)] * 3
    kept = _stages(spark, tmp_path, rows)
    once = sorted((False, i, t) for i, t in {(r[0], r[1]) for r in rows})
    assert len(kept["language_id"]) == 50 and kept["exact_dedup"] == once and kept["ngram_join"] == once
    # A mix takes each row three times at most, and all words of the table within a row's length and the parts.
    assert set(kept["mixing"]) <= set(once) and max(map(kept["mixing"].count, once)) <= 3
    assert len(kept["mixing"]) <= len(once) + 2


def test_null_ids(spark, tmp_path):
    """Documents without an id stay, each by itself; one goes only for an equal or a near one."""
    rng = random.Random(5)
    rows = [(i, _body(rng), "en", "src0", 1) for i in range(20)] + [(None, _body(rng), "en", "src0", 1) for _ in range(4)]
    more = [(None, rows[20][1], "en", "src0", 1), (None, rows[3][1].upper(), "en", "src0", 1), (None, rows[21][1] + " end", "en", "src0", 1), (None, rows[4][1] + " end", "en", "src0", 1)]
    kept = _stages(spark, tmp_path, rows + more)
    assert len(kept["language_id"]) == 28
    assert kept["exact_dedup"] == sorted((r[0] is None, r[0] or 0, r[1]) for r in rows + more[2:])
    pair = {rows[21][1], more[2][1]}
    texts = [t for none, _, t in kept["ngram_join"] if none]
    assert sum(not none for none, _, _ in kept["ngram_join"]) == 20
    assert len(texts) == 4 and len(pair & set(texts)) == 1 and set(texts) - pair == {rows[i][1] for i in (20, 22, 23)}
    assert sorted(set(kept["mixing"])) == kept["ngram_join"]


def test_clashing_names(spark, tmp_path):
    """Columns named as the stages' own go through with their values."""
    rng = random.Random(6)
    extra = ["_row", "_ROW2", "__row", "_id", "copy", "_copy", "times", "_times", "_name", "_pair", "key", "slot", "doc", "n"]
    rows = [(i, _body(rng), "en", "src0", 1, *[100 * i + k for k in range(len(extra))]) for i in range(12)]
    rows += [rows[3], (None, _body(rng), "en", "src0", 1, *range(len(extra)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == schema.replace(",", "").split()[::2]
    got = {tuple(r) for r in docs.collect()}
    assert got == set(rows)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_lists_the_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
