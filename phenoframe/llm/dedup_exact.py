"""Exact duplicates by two passes over a Bloom filter of 64-bit words (built-in functions only).

A row sets two bits of one word. The first pass merges the rows of a word by OR, XOR and a count of bits, inside tasks and then by word, which
tells the bits that may have been set twice. The second lets every row that has a bit of its own pass straight through; only the others shuffle."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..worktable import materialize
from .skew import with_group


def _word(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words))


def _bits(h: Column) -> Column:
    """The two bits of a row's word."""
    one = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {k}) & 63 AS int))") for k in (40, 52)]
    return one[0].bitwiseOR(one[1])


def repeated_bits(hashes: DataFrame, words: int) -> DataFrame:
    """Pass 1: (word, mask) with the bits that two or more rows may have set; never more than ``words`` rows.

    Bits set an even number of times are those in OR but not in XOR. If no bit was set more than twice, the number of all bits set
    shows it, and these are the repeated ones; otherwise all bits of the word count as repeated, so none is missed."""
    own = hashes.select(_word(F.col("h"), words).alias("word"), _bits(F.col("h")).alias("bits"))
    merged = own.groupBy("word").agg(F.bit_or("bits").alias("any"), F.bit_xor("bits").alias("odd"), F.sum(F.bit_count("bits")).alias("n"))
    even = F.col("any").bitwiseAND(F.bitwise_not("odd"))
    sure = F.col("n") == F.bit_count("any") + F.bit_count(even)
    return merged.select("word", F.when(sure, even).otherwise(F.col("any")).alias("mask")).filter("mask <> 0")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, broadcast_words: int = 1 << 20
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of
    a group stays. The filter has ``bits_per_row`` bits a row or more, however many rows there are. Up to ``broadcast_words`` words it is broadcast, so that
    rows don't move to meet it; beyond, it stays spread over the cluster by word, and the (id, digest) of each row meets it there. Only rows whose bits
    may be repeated shuffle by their digest. Very long texts are digested whole.
    Empty input gives an empty result. Rows repeated with the same id and text carry the same
    ``kept``. A null id is kept only if its whole group has no id. Extra columns are ignored."""
    spark = docs.sparkSession
    rows = docs.count()
    words = 1
    while words * 64 < rows * bits_per_row:
        words *= 2
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Texts equal under the rule are equal under lower(), which is the faster key for the filter.
    own = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(F.lower(text)).alias("h"))
    seen = repeated_bits(own.select("h"), words)
    digest = F.unhex(F.sha2(F.translate("t", ascii_uppercase, ascii_lowercase), 256))
    marked = own.select("id", digest.alias("sha"), _word(F.col("h"), words).alias("word"), _bits(F.col("h")).alias("bits"))
    met = marked.join(F.broadcast(seen) if words <= broadcast_words else seen, "word", "left")
    maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("bits"), F.lit(False))
    flagged = materialize(met.select("id", "sha", maybe.alias("maybe")), "exact-dedup")

    once = flagged.filter("NOT maybe").select("id", "sha", F.lit(1).cast("long").alias("n"), F.col("id").alias("keep"))
    maybe = flagged.filter("maybe").select("id", "sha")
    return once.unionByName(with_group(maybe, "sha", rows, keep=F.max("id"))).select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
