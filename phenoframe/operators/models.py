"""A classifier on measured features, its importances, and a cache of scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import profiles, ranking
from ..worktable import materialize
from .sampling import nested_subsets, seeded_rank


def train_feature_model(df: DataFrame, features: list[str], label: str, split: str, rounds: int = 20, depth: int = 3, seed: int = 0) -> tuple[PipelineModel, list[str]]:
    """Boosted trees on the rows of split ``train``, classes weighted alike; (model, features used). Features without a value in training are dropped.

    ``label`` is 0 or 1; a single class, or no row of another split, is an error."""
    train = df.filter(F.col(split) == "train")
    have = train.agg(*[F.count(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in features], F.count_if(F.col(label) == 1).alias("_1"), F.count_if(F.col(label) == 0).alias("_0")).first()
    if not have["_0"] or not have["_1"] or df.filter(F.col(split) != "train").isEmpty():
        raise ValueError("training needs both classes and a hold-out")
    used = [c for c in features if have[c]]
    n = have["_0"] + have["_1"]
    weighted = train.withColumns({c: F.col(c).cast("double") for c in used}).withColumn("_w", F.when(F.col(label) == 1, n / (2.0 * have["_1"])).otherwise(n / (2.0 * have["_0"]))).withColumn("_y", F.col(label).cast("double"))
    stages = [
        Imputer(inputCols=used, outputCols=[f"_i_{c}" for c in used], strategy="median"),
        VectorAssembler(inputCols=[f"_i_{c}" for c in used], outputCol="_x", handleInvalid="keep"),
        GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(weighted), used


def score(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``p``, the probability of class 1; a missing feature column is an error."""
    lacking = [c for c in features if c not in df.columns]
    if lacking:
        raise ValueError(f"no such features: {lacking}")
    out = model.transform(df.withColumns({c: F.col(c).cast("double") for c in features}))
    return out.withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")


def evaluate_model(model: PipelineModel, df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: the confusion at 0.5, accuracies, auc, average_precision and the Youden threshold."""
    s = score(model, df, features).withColumn("_k", F.lit(1))
    m = profiles.binary_metrics(s, label, "p", ["_k"])
    return m.join(ranking.auc(s, label, "p").withColumn("_k", F.lit(1)), "_k").drop("_k")


def learning_curve(
    df: DataFrame, features: list[str], label: str, split: str, key: str, points: int = 5, seed: int = 42, train: Callable = train_feature_model,
) -> DataFrame:
    """One row for each size of the training set: fraction, n, n_good (label 0), n_bad (label 1), roc_auc, average_precision, balanced_acc, eval_acc on the hold-out.

    ``points`` fractions from a tenth to all (two at least) of the rows of split ``train``, nested and in the classes' proportions (``sampling.nested_subsets``); sizes with
    too few rows of a class are left out. ``train`` takes (df, features, label, split) and gives a model and its features. No hold-out, or a
    single class in training, is an error. Rows are written once with a bit mask of the subsets that hold them: a model reads the rows of
    its bit, and none is copied a subset. All models score the hold-out in one job."""
    seen = df.groupBy((F.col(split) == "train").alias("train"), F.col(label).alias("label")).count().collect()  # two classes, twice
    if not any(not r["train"] for r in seen):
        raise ValueError("a learning curve needs a hold-out")
    if {r["label"] for r in seen if r["train"]} < {0, 1}:
        raise ValueError("training needs both classes")
    steps = max(2, points)
    fractions = [0.1 + 0.9 * i / (steps - 1) for i in range(steps)]
    places = F.create_map(*[F.lit(x) for i, f in enumerate(fractions) for x in (f, i)])
    subsets = nested_subsets(df.filter(F.col(split) == "train"), label, key, fractions, seed)
    masks = subsets.select(key, F.element_at(places, F.col("fraction")).alias("_i")).groupBy(key).agg(F.bit_or(F.expr("shiftleft(1L, _i)")).alias("_mask"))
    rows = materialize(df.join(masks, key, "left").select(*features, label, split, "_mask"), "learning-curve")
    held, scored = rows.filter(F.col(split) != "train").select(*features, label), None
    sizes = rows.filter("_mask IS NOT NULL").select(label, F.explode(F.lit(list(range(steps)))).alias("_i"), "_mask").filter("_mask & shiftleft(1L, _i) <> 0")
    sizes = sizes.groupBy("_i").agg(F.count("*").alias("n"), F.count_if(F.col(label) == 0).alias("n_good"), F.count_if(F.col(label) == 1).alias("n_bad"))
    sizes = materialize(sizes, "learning-sizes")
    for at in sorted(r["_i"] for r in sizes.collect()):
        own = rows.filter((F.col(split) != "train") | F.expr(f"_mask & {1 << at}L <> 0"))
        model, used = train(own, features, label, split)
        part = score(model, held, used).select(F.lit(at).alias("_i"), label, "p")
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return sizes.sparkSession.createDataFrame([], "fraction double, n long, n_good long, n_bad long, roc_auc double, average_precision double, balanced_acc double, eval_acc double")
    scored = materialize(scored, "learning-scores")
    of = profiles.binary_metrics(scored, label, "p", ["_i"]).select("_i", F.col("balanced_accuracy").alias("balanced_acc"), F.col("accuracy").alias("eval_acc"))
    areas = ranking.auc(scored, label, "p", ["_i"]).select("_i", F.col("auc").alias("roc_auc"), "average_precision")
    fraction = F.element_at(F.lit(fractions), F.col("_i") + 1).alias("fraction")
    return sizes.join(of, "_i").join(areas, "_i").select(fraction, "n", "n_good", "n_bad", "roc_auc", "average_precision", "balanced_acc", "eval_acc")


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], label: str, key: str, repeats: int = 5, top: int = 15) -> DataFrame:
    """(feature, mean, std): the drop in balanced accuracy when a feature's values are dealt to other rows, for the ``top`` with a positive mean.

    Values are exchanged by joining two seeded orders, once a repeat: a row then holds its own values and those of the row that it met, and its variants
    are made where it stands, without moving again. All are scored in one job."""
    own = materialize(df.select(key, label, *features).withColumn("_all", F.lit(1)), "importance-rows")
    mine = [F.col(c).cast("double").alias(c) for c in features]
    every = own.select(label, F.lit("").alias("feature"), F.lit(0).alias("repeat"), *mine)
    for k in range(repeats):
        a, b = (seeded_rank(own, ["_all"], key, 2 * k + s).drop("_size", "_all") for s in (0, 1))
        dealt = a.join(b.select("_rank", *[F.col(c).alias(f"_o_{c}") for c in features]), "_rank")
        variants = [F.struct(F.lit(f).alias("feature"), F.lit(k).alias("repeat"), *[F.col(f"_o_{c}" if c == f else c).cast("double").alias(c) for c in features]) for f in features]
        every = every.unionByName(dealt.select(label, F.inline(F.array(*variants))))
    m = profiles.binary_metrics(score(model, every, features), label, "p", ["feature", "repeat"])
    base = m.filter("feature = ''").first()["balanced_accuracy"]
    drop = F.lit(base) - F.col("balanced_accuracy")
    out = m.filter("feature <> ''").groupBy("feature").agg(F.avg(drop).alias("mean"), F.stddev_pop(drop).alias("std"))
    return out.filter("mean > 0").orderBy(F.desc("mean"), "feature").limit(top)


def score_missing(df: DataFrame, cache: DataFrame, key: str, model_key: str, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, model_key, p) of rows that the cache lacks under this model; append them to it. ``scorer`` adds p."""
    todo = df.join(cache.filter(F.col("model_key") == model_key).select(key), key, "left_anti")
    return scorer(todo).select(key, F.lit(model_key).alias("model_key"), "p")
