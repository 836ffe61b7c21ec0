"""URL filter: rules first, then naive Bayes over words that a unigram Viterbi search finds in hosts and paths."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..worktable import materialize
from .skew import HOT_SHARE

#: The rules of the query, as host + path prefix and verdict.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Runs of letters, and of digits.
PARTS = r"[\p{L}\p{Nl}\p{No}]+|\p{Nd}+"
#: Words of so many letters or more are found by so many first letters, shorter ones by all of them.
HEAD = 8
OUTPUT = "page_id long, host string, path string, rule string, verdict string, score double, words array<string>"


def host_of(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is this one or a parent of it and whose path starts this one; else null."""
    best = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        best = F.when(fits, F.lit(rule)).otherwise(best)
    return best


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for r, v in rules:
        out = F.when(rule == r, F.lit(v)).otherwise(out)
    return out


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(w, n): counts of the lower-cased words of a column over all rows, tags left out."""
    visible = F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"<[^<>]*>", " ")
    words = texts.select(F.explode(F.split(visible, r"[^\p{L}]+")).alias("w")).filter("w <> ''")
    return words.groupBy("w").agg(F.count("*").alias("n"))


class Segmenter:
    """The most probable split of a name into known words; an unknown stretch costs more the longer it is.

    ``total`` is the number of all words, one more than those of ``counts`` if it isn't given."""

    def __init__(self, counts: list[tuple[str, int]], total: int | None = None):
        total = total or sum(c for _, c in counts) + 1
        self.log = {w: math.log(c / total) for w, c in counts}
        self.sizes = sorted({len(w) for w, _ in counts})
        self.unknown = -math.log(total)

    def split(self, name: str) -> list[str]:
        # best and back: the best split of what stands before each place, and where its last word begins; run: the best that ends in an unknown stretch.
        best, back, run, run_at = [0.0], [0], -math.inf, 0
        for end in range(1, len(name) + 1):
            fresh = best[end - 1] + self.unknown
            run, run_at = (run, run_at) if run >= fresh else (fresh, end - 1)
            run -= 3.0
            score, at = run, run_at
            for size in self.sizes:
                if size > end:
                    break
                p = self.log.get(name[end - size : end])
                if p is not None and best[end - size] + p > score:
                    score, at = best[end - size] + p, end - size
            best.append(score)
            back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


_PARTS = re.compile(r"[^\W\d_]+|\d+")


def tokens_of(host: str, path: str, segmenter: Segmenter) -> list[str]:
    """Tokens of a host (h:word, after segmentation) and of a path (p:word; numbers count by their length): the small form of ``tokenised``."""
    out = [f"h:{w}" for part in _PARTS.findall(host) for w in segmenter.split(part)]
    return out + [f"p:#{len(part)}" if part[0].isdecimal() else f"p:{part}" for part in _PARTS.findall(path.lower())]


#: Letters of a piece in which places of words are sought, and of what is kept behind a place to compare words with.
PIECE, REACH = 256, 48


def segmented(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words) of distinct hosts: each part of a name is split once, by the words that stand in it.

    Words meet the names by a join: shorter ones on their letters, longer ones on their first HEAD letters. So no task holds the table of words. Names go in
    pieces and by number, with REACH letters behind each place, so the rows of a name grow with its length alone; words that are longer than that and begin
    as the name does there are looked for in the whole name."""
    cut = materialize(hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(PARTS), F.lit(0))).alias("at", "part")), "url-parts")
    parts = materialize(cut.select("part").distinct().withColumn("id", F.monotonically_increasing_id()), "url-names")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)) + 1).first()[0]
    starts = F.sequence(F.lit(0), F.floor((F.length("part") - 1) / PIECE).cast("int"))
    pieces = parts.select("id", F.explode(F.transform(starts, lambda k: F.col("part").substr(k * PIECE + 1, F.lit(PIECE + REACH)))).alias("piece"))
    size = F.length("piece")
    at = pieces.select("id", "piece", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), size))).alias("i"))
    short = at.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD - 1), size - F.col("i") + 1)), lambda n: F.col("piece").substr(F.col("i"), n))).alias("w"))
    short = short.distinct().join(words.filter(F.length("w") < HEAD), "w").select("id", "w", "n")
    slices = at.filter(size - F.col("i") + 1 >= HEAD).select("id", F.col("piece").substr(F.col("i"), F.lit(REACH)).alias("slice"))
    slices = slices.distinct().withColumn("head", F.substring("slice", 1, HEAD))
    long = words.filter(F.length("w") >= HEAD).select("w", "n", F.substring("w", 1, HEAD).alias("head"), F.substring("w", 1, REACH).alias("begin"))
    long = slices.join(long, "head").filter(F.col("slice").startswith(F.col("begin"))).select("id", "w", "n").distinct()
    longest = long.filter(F.length("w") > REACH).join(parts, "id").filter(F.contains("part", "w")).select("id", "w", "n")
    long = long.filter(F.length("w") <= REACH).unionByName(longest)
    found = short.unionByName(long).groupBy("id").agg(F.collect_list(F.struct("w", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(1).to_pylist()
            out = [Segmenter([(k["w"], k["n"]) for k in x or []], total).split(p) for p, x in zip(b.column(0).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["part", "pieces"])

    pieces = parts.join(found, "id", "left").select("part", "known").mapInArrow(split, "part string, pieces array<string>")
    back = cut.join(materialize(pieces, "url-pieces"), "part").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "pieces"))).alias("all"))
    return materialize(back.select("host", F.flatten("all.pieces").alias("words")), "url-hosts")


def tokenised(urls: DataFrame, words: DataFrame) -> DataFrame:
    """``urls`` with the words of the host, and all tokens (see ``tokens_of``)."""
    hosts = segmented(urls.select("host").distinct(), words)
    path = F.transform(
        F.regexp_extract_all(F.lower("path"), F.lit(PARTS), F.lit(0)),
        lambda p: F.concat(F.lit("p:"), F.when(p.rlike(r"^\p{Nd}"), F.concat(F.lit("#"), F.length(p).cast("string"))).otherwise(p)),
    )
    met = urls.join(hosts, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    return met.withColumn("tokens", F.concat(F.transform("words", lambda w: F.concat(F.lit("h:"), w)), path))


class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing from (verdict, token, count) and (verdict, rows): the small form of ``token_weights``."""

    def __init__(self, counts: list[tuple[str, str, int]], rows: dict[str, int]):
        vocabulary = {t for _, t, _ in counts}
        total = {v: len(vocabulary) + 1 + sum(c for w, _, c in counts if w == v) for v in ("allow", "block")}
        n = sum(rows.values())
        self.prior = math.log((rows.get("block", 0) + 1) / (n + 2)) - math.log((rows.get("allow", 0) + 1) / (n + 2))
        self.weight: dict[str, float] = {}
        for t in vocabulary:
            self.weight[t] = -math.log(total["block"]) + math.log(total["allow"])
        seen: dict[tuple[str, str], int] = {(v, t): c for v, t, c in counts}
        for t in vocabulary:
            self.weight[t] += math.log(seen.get(("block", t), 0) + 1) - math.log(seen.get(("allow", t), 0) + 1)

    def score(self, tokens: list[str]) -> float:
        """The probability of block."""
        x = self.prior + sum(self.weight.get(t, 0.0) for t in tokens)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def token_weights(counts: DataFrame, rows: dict[str, int], hot: int) -> tuple[float, dict[str, float], DataFrame]:
    """Multinomial naive Bayes with add-one smoothing from one row (token, n, block, allow) per token and the rows of each verdict.

    The log odds of block: of the verdicts; of the tokens that stand more than ``hot`` times in all urls; and (token, weight) of the
    others. Totals are taken over all tokens of ruled urls; a token of none of them weighs 0."""
    n = sum(rows.values())
    prior = math.log((rows.get("block", 0) + 1) / (n + 2)) - math.log((rows.get("allow", 0) + 1) / (n + 2))
    seen = F.col("block") + F.col("allow") > 0
    size, block, allow = counts.agg(F.count_if(seen), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    total = math.log(size + 1 + allow) - math.log(size + 1 + block)
    weight = F.when(seen, F.lit(total) + F.log(F.col("block") + 1) - F.log(F.col("allow") + 1)).otherwise(F.lit(0.0)).alias("weight")
    often = {r["token"]: r["weight"] for r in counts.filter(F.col("n") > hot).select("token", weight).collect()}
    return prior, often, counts.filter((F.col("n") <= hot) & seen).select("token", weight)


def probability(log_odds: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, log_odds))))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (probability of block), words.

    The words of ``text_col`` over all rows give the unigram model; the urls that a rule decides train the
    classifier (counts over all of them), which decides the rest; a tie is allow. Null urls and urls without :// have empty
    host and path, no rule, and the verdict of the prior. Without any training row, allow. Repeated rows are
    judged alike; extra columns are ignored; long urls are taken whole; no pages give no rows. All words and tokens count and stay in tables;
    only tokens with over 1 / HOT_SHARE of all (and so HOT_SHARE at most) are sent to the tasks."""
    urls = pages.select(
        F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    cut = tokenised(urls, materialize(word_counts(pages, text_col), "url-words"))
    cut = materialize(cut.select("page_id", "host", "path", "rule", "words", "tokens").withColumn("row", F.monotonically_increasing_id()), "url-tokens")
    judged = cut.withColumn("verdict", verdict_of(F.col("rule"), rules))
    counts = judged.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("block"), F.count_if(F.col("verdict") == "allow").alias("allow")
    )
    counts = materialize(counts, "url-counts")
    rows = {r["verdict"]: r["count"] for r in judged.filter("verdict IS NOT NULL").groupBy("verdict").count().collect()}
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    prior, often, weights = token_weights(counts, rows, total // HOT_SHARE)
    decided = {r: v for r, v in rules}

    # The frequent tokens are summed where the urls are, the others by a join; a token of no ruled url meets no weight.
    some = cut.select("row", F.explode("tokens").alias("token"))
    some = some.filter(~F.col("token").isin(list(often))) if often else some
    found = some.join(weights, "token").groupBy("row").agg(F.array_sort(F.collect_list("weight")).alias("parts"))
    joined = cut.join(found.hint("shuffle_hash"), "row", "left").select("page_id", "host", "path", "rule", "tokens", "parts", "words")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, parts = b.column(4).to_pylist(), b.column(5).to_pylist()
            score = [probability(prior + math.fsum([often.get(t, 0.0) for t in x] + (y or []))) for x, y in zip(tokens, parts, strict=True)]
            verdict = [decided.get(r) or ("block" if s > 0.5 else "allow") for r, s in zip(b.column(3).to_pylist(), score, strict=True)]
            more = [pa.array(verdict, pa.string()), pa.array(score, pa.float64()), b.column(6)]
            yield pa.RecordBatch.from_arrays(b.columns[:4] + more, ["page_id", "host", "path", "rule", "verdict", "score", "words"])

    return joined.mapInArrow(judge, OUTPUT)
