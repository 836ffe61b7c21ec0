"""Where masks and crops come from, read from JSON kept beside them; broken or absent JSON says nothing and is no error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of stages and filters, the ends of the folders that stages write to, the attributes that may hold options, and the words for yes and no.
STAGES, FILTERS, UNKNOWN = ("classify", "segment"), ("cnn", "rules", "none"), "unknown"
OPTION_ATTRIBUTES = ("crop_options", "crop_opts", "extract_options")
YES, NO = ("true", "1", "yes"), ("false", "0", "no")

_MANIFEST = "stages array<struct<name string, skipped string, opts map<string, string>>>"


def _json(text: Column, path: str) -> Column:
    """A value of a JSON object; null where the text isn't one."""
    return F.when(F.trim(text).startswith("{"), F.get_json_object(text, path))


def as_flag(text: Column) -> Column:
    """True, false, or null for any other word."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def input_provenance(signature: Column, folder: Column) -> Column:
    """(input_stage, classifier_prefilter, classifier_prefilter_model_sha256) of masks, from the signature beside them.

    A signature of another stage counts as none: the folder's end tells the stage then, but not whether a network chose. A model in the signature of
    classify is one that did (cnn), without one only rules did; segment has no filter and no model."""
    signed, model = _json(signature, "$.stage"), _json(signature, "$.model")
    known = F.coalesce(signed.isin(*STAGES), F.lit(False))
    network = F.coalesce(F.trim(model).startswith("{"), F.lit(False))
    by_folder = F.when(folder.endswith("_classify"), "classify").when(folder.endswith("_segment"), "segment").otherwise(UNKNOWN)
    stage = F.when(known, signed).otherwise(by_folder)
    chosen = F.when(~known, UNKNOWN).when(network, "cnn").otherwise("rules")
    sha = F.when(known & (stage == "classify") & network, F.coalesce(F.get_json_object(model, "$.sha256"), F.lit(""))).otherwise("")
    prefilter = F.when(stage == "classify", chosen).when(stage == "segment", "none").otherwise(UNKNOWN)
    return F.struct(stage.alias("input_stage"), prefilter.alias("classifier_prefilter"), sha.alias("classifier_prefilter_model_sha256"))


def crop_options(manifest: Column, attributes: Column) -> Column:
    """(mask_background, classify_before_features, classifier_prefilter, model_sha256, source) of crops, null where not known.

    ``manifest`` is the run's JSON, ``attributes`` a map of the crops' own attributes, which win. In the manifest the first stage named features has the options, and
    classify counts if it stands before that stage and wasn't skipped. Of attributes, mask_background itself or the first option list that holds it counts, and a
    filter that isn't known counts as none given."""
    stages = F.from_json(manifest, _MANIFEST)["stages"]
    names = F.transform(stages, lambda s: F.lower(F.coalesce(s["name"], F.lit(""))))
    features, classify = F.array_position(names, F.lit("features")), F.array_position(names, F.lit("classify"))
    has = F.coalesce(features > 0, F.lit(False))
    told = F.when(has, as_flag(F.element_at(F.try_element_at(stages, F.greatest(features, F.lit(1)).cast("int"))["opts"], "mask_background")))
    skipped = F.coalesce(as_flag(F.try_element_at(stages, F.greatest(classify, F.lit(1)).cast("int"))["skipped"]), F.lit(False))
    before = F.when(has & (classify > 0) & (classify < features), ~skipped)
    listed = [F.get_json_object(attributes[k], "$.mask_background") for k in OPTION_ATTRIBUTES]
    own = F.when(F.map_contains_key(attributes, "mask_background"), as_flag(attributes["mask_background"])).otherwise(as_flag(F.coalesce(*listed)))
    prefilter = F.lower(F.trim(attributes["classifier_prefilter"]))
    prefilter = F.when(prefilter.isin(*FILTERS), prefilter)
    sha = F.when(prefilter.isNotNull(), F.nullif(F.trim(attributes["classifier_prefilter_model_sha256"]), F.lit("")))
    source = F.when(own.isNotNull(), "attributes").when(stages.isNotNull(), "manifest").when(prefilter.isNotNull(), "attributes")
    return F.struct(
        F.coalesce(own, told).alias("mask_background"), F.coalesce(prefilter == "cnn", before).alias("classify_before_features"), prefilter.alias("classifier_prefilter"),
        sha.alias("model_sha256"), source.alias("source"),
    )


def crop_warnings(options: Column) -> Column:
    """Codes of what makes crops doubtful for training: masked (the background was blanked), filtered_by_network (with the first twelve letters of its SHA-256 where
    known) or perhaps_filtered (classify ran before)."""
    masked = F.when(options["mask_background"], "masked")
    sha = F.coalesce(F.concat(F.lit(":"), F.substring(options["model_sha256"], 1, 12)), F.lit(""))
    filtered = F.when(options["classifier_prefilter"] == "cnn", F.concat(F.lit("filtered_by_network"), sha)).when(options["classify_before_features"], "perhaps_filtered")
    return F.array_compact(F.array(masked, filtered))
