"""Seeded samples of bounded expected size for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def stratified(df: DataFrame, label: str, key: str, per_label: int | dict, max_rows: int | None = None, seed: int = 5) -> DataFrame:
    """About ``per_label`` rows (or as many as it gives for the label) of each label, by a hash of ``key``.

    With ``max_rows``, labels share about so many rows where they are too many for ``per_label`` each; none is left out. The table
    of labels is joined, so its size decides how it travels."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    if isinstance(per_label, dict):
        wanted = F.lit(0)
        for value, n in per_label.items():
            wanted = F.when(F.col(label) == value, F.lit(n)).otherwise(wanted)
    else:
        labels = counts.count() if max_rows else 1
        wanted = F.lit(min(per_label, max(1, max_rows // max(1, labels))) if max_rows else per_label)
    return df.join(counts, label).filter(draw * F.col("_n") < wanted).select(df.columns)
