"""Scalar functions on sample names, wells and labels: Column in, Column out, all built-in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A mutant or drug that contains one of these is a control.
CONTROL_WORDS = ("plasmid", "control", "wt", "empty", "untreated", "ctrl")
#: Bounds of the normalised area, in pixels.
AREA_LOW, AREA_HIGH = 10.0, 1e4


def _part(stem: Column, k: int) -> Column:
    return F.coalesce(F.regexp_replace(F.get(F.split(stem, "__"), F.lit(k)), "(_focused|_filtered)$", ""), F.lit(""))


def parse_stem(stem: Column) -> Column:
    """A struct of a stem's parts: condition, reporter, mutant_or_drug, replica, is_control, condition_label, gene."""
    condition, reporter, mutant, last = (_part(stem, k) for k in range(4))
    control = F.lower(mutant).rlike("|".join(CONTROL_WORDS))
    return F.struct(
        condition.alias("condition"), reporter.alias("reporter"), mutant.alias("mutant_or_drug"),
        F.when(last.rlike("(?i)^R[0-9]+$"), last).otherwise(F.lit("")).alias("replica"), control.alias("is_control"),
        F.when(mutant != "", mutant).otherwise(condition).alias("condition_label"), F.when(~control, mutant).otherwise(F.lit("")).alias("gene"),
    )


def condition_label(mutant: Column, treatment: Column, well: Column) -> Column:
    """"<mutant> <treatment>", with the whole well where there is no mutant."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws(" ", F.coalesce(blank(mutant), well), blank(treatment))


def gene_of(label: Column) -> Column:
    """The gene of a stem, its third part where the gene is empty, or else the first token of a plain label."""
    parsed = parse_stem(label)
    of_stem = F.when(parsed["gene"] != "", parsed["gene"]).otherwise(parsed["mutant_or_drug"])
    return F.when(F.contains(label, F.lit("__")), of_stem).otherwise(F.get(F.split(F.trim(label), r"\s+"), F.lit(0)))


def norm_well(well: Column) -> Column:
    """Trimmed, upper case, without leading zeros of the number."""
    return F.regexp_replace(F.upper(F.trim(well)), "^([A-Z])0*([0-9]+)$", "$1$2")


def well_key(well: Column) -> Column:
    """Sorts wells by letter, then number."""
    w = norm_well(well)
    return F.struct(F.substring(w, 1, 1).alias("letter"), F.regexp_extract(w, "^[A-Z]([0-9]+)$", 1).try_cast("int").alias("number"))


def parse_int_list(text: Column) -> Column:
    """Integers between brackets, commas, semicolons and spaces; what isn't an integer is left out."""
    parts = F.split(F.regexp_replace(text, r"[\[\]()]", ""), r"[;,\s]+")
    return F.filter(F.transform(parts, lambda p: p.try_cast("int")), lambda x: x.isNotNull())


def strip_replicate(label: Column) -> Column:
    """The label without replicate marks, with single spaces, without trailing underscores and spaces."""
    bare = F.regexp_replace(label, r"(?i)[\s_]+R[0-9]+\b", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"[_ ]+$", "")


def is_control(label: Column, tokens: list[str]) -> Column:
    """Whether a token stands in the label as a whole word; no tokens match nothing."""
    tokens = [t for t in tokens if t.strip()]
    if not tokens:
        return F.lit(False)
    return F.coalesce(label.rlike(r"(?i)\b(?:" + "|".join(re.escape(t.strip()) for t in tokens) + r")\b"), F.lit(False))


def norm_area(area: Column) -> Column:
    low, high = F.ln(F.lit(AREA_LOW)), F.ln(F.lit(AREA_HIGH))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.ln(F.greatest(area.cast("double"), F.lit(1.0))) - low) / (high - low)))


def cell_uid(run: Column, well: Column, fov: Column, cell: Column) -> Column:
    return F.format_string("%s__%s__%03d__%05d", run, well, fov.cast("int"), cell.cast("int"))


def ratio(a: Column, b: Column, least: float = 1e-9) -> Column:
    """a / b, or 0 where b is below ``least``."""
    return F.when(b < least, F.lit(0.0)).otherwise(F.try_divide(a, b))


def run_id_of(path: Column) -> Column:
    """The folder that holds a file, or the one above it where that is a features folder."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    near = F.try_element_at(parts, F.lit(-2))
    return F.when(near.isin("04_features", "features"), F.try_element_at(parts, F.lit(-3))).otherwise(near)


def class_label(gene: Column, drug: Column, concentration: Column, condition: Column, source: str = "auto") -> Column:
    """The gene, else the drug with its concentration, else the whole condition; blanks count as absent. ``source`` (gene, drug or condition) takes one of them only."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    of = {"gene": full(gene), "drug": F.when(full(drug).isNotNull(), F.concat_ws("_", full(drug), full(concentration))), "condition": full(condition)}
    if source != "auto" and source not in of:
        raise ValueError(f"no such source of a class: {source}")
    return F.coalesce(*of.values()) if source == "auto" else of[source]


def control_tokens(lists: Column) -> Column:
    """The distinct trimmed tokens of a comma list; distinct over runs by explode and distinct."""
    return F.array_distinct(F.filter(F.transform(F.split(lists, ","), lambda t: F.trim(t)), lambda t: t != ""))
