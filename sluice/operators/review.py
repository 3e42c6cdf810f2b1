"""Human review: candidate ranking, decision log, statistics, and the classifier that learns from decisions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uncertainty(p: Column) -> Column:
    return 0.5 - F.abs(p - 0.5)


def priority(p: Column) -> Column:
    return 0.7 * uncertainty(p) + 0.3 * p


def keep_first(pairs: DataFrame, left: str = "left_norm", right: str = "right_norm", order: str | None = None) -> DataFrame:
    """Pairs with the smaller name left, the first row of each by order."""
    a, b = F.least(left, right), F.greatest(left, right)
    rank = F.row_number().over(Window.partitionBy("_a", "_b").orderBy(order or left, right))
    return pairs.withColumns({"_a": a, "_b": b}).withColumn("_n", rank).where("_n = 1").withColumns({left: F.col("_a"), right: F.col("_b")}).drop("_a", "_b", "_n")


def candidate_queue(scored: DataFrame, decisions: DataFrame, by_uncertainty: bool = False, limit: int | None = None, left: str = "left_norm", right: str = "right_norm", p: str = "match_probability") -> DataFrame:
    """scored pairs not yet reviewed (in either order), with uncertainty and priority, best first; ties by name."""
    done = decisions.select(F.least("left", "right").alias(left), F.greatest("left", "right").alias(right)).distinct()
    one = keep_first(scored, left, right).where(F.col(left) != F.col(right)).join(done, [left, right], "left_anti")
    ranked = one.withColumns({"uncertainty": uncertainty(F.col(p)), "priority": priority(F.col(p))}).orderBy(F.desc("priority" if by_uncertainty else p), left, right)
    return ranked.limit(limit) if limit is not None else ranked


def probability_histogram(scored: DataFrame, p: str = "match_probability", bins: int = 10) -> DataFrame:
    """(bin, count) over [0, 1], every bin present, the last one closed; values outside do not count."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    counts = scored.where(F.col(p).between(0, 1)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").fillna(0, ["count"])


def review_statistics(scored: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: total pairs, labelled, matches, non_matches."""
    a = scored.agg(F.count("*").alias("total_pairs"))
    b = decisions.agg(F.count("*").alias("labelled"), F.count_if("is_match").alias("matches"), F.count_if(~F.col("is_match")).alias("non_matches"))
    return a.crossJoin(b)  # one row each


def decision_log(decisions: DataFrame, *order: str, save_every: int = 5, train_every: int = 10) -> DataFrame:
    """decisions with number (from 1, in order), since_save (decisions since the last save, itself counted) and trains (whether the model is due)."""
    from sluice.operators.relational import numbered

    n = numbered(decisions, "number", *(order or ("ts", "left", "right")))
    return n.withColumns({"since_save": F.col("number") % save_every, "trains": F.col("number") % train_every == 0})


def progress(decisions: DataFrame, total: int, ts: str = "ts") -> DataFrame:
    """One row: decisions, first, last, elapsed_seconds, per_hour, hours_left, percent; nulls where nothing has elapsed."""
    d = decisions.agg(F.count("*").alias("decisions"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    d = d.withColumn("elapsed_seconds", (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6)
    d = d.withColumn("per_hour", F.try_divide(F.col("decisions") * 3600.0, F.col("elapsed_seconds")))
    return d.withColumns({"hours_left": F.try_divide(F.lit(float(total)) - F.col("decisions"), F.col("per_hour")), "percent": F.try_divide(F.col("decisions") * 100.0, F.lit(float(total)))})


def sampling_statistics(queue: DataFrame, p: str = "match_probability", top: int = 10) -> DataFrame:
    """One row: probability and uncertainty of the first `top` of the queue, summed and divided by `top` however many there are."""
    first = queue.limit(top)
    return first.agg((F.coalesce(F.sum(p), F.lit(0.0)) / top).alias("mean_probability"), (F.coalesce(F.sum(uncertainty(F.col(p))), F.lit(0.0)) / top).alias("mean_uncertainty"))


def labelled_features(features: DataFrame, decisions: DataFrame, left: str = "left_norm", right: str = "right_norm") -> DataFrame:
    """Features of decided pairs with `label` 0 or 1; of repeated decisions the latest counts, pairs without features are skipped."""
    last = decisions.groupBy(F.least("left", "right").alias(left), F.greatest("left", "right").alias(right)).agg(F.max_by(F.col("is_match").cast("double"), F.struct("ts", "is_match")).alias("label"))
    return keep_first(features, left, right).join(last, [left, right])


def train(labelled: DataFrame, features: list[str], kind: str = "random_forest", least: int = 10, force: bool = False) -> PipelineModel | None:
    """A fitted pipeline with column `match_probability` from match_probability(); None under `least` labels unless forced.

    random_forest: 100 trees, classes weighted evenly, seed 42.  gradient_boosting: 100 rounds of depth 3, step 0.1,
    matches weighted twice.
    """
    if kind not in ("random_forest", "gradient_boosting"):
        raise ValueError(f"unknown classifier {kind}")
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    n = sum(counts.values())
    if n == 0 or (n < least and not force):
        return None
    if kind == "random_forest":
        weight = F.when(F.col("label") == 1, n / (2 * counts.get(1.0, n))).otherwise(n / (2 * counts.get(0.0, n)))
        model = RandomForestClassifier(numTrees=100, seed=42, maxDepth=12, weightCol="weight", featuresCol="vector")
    else:
        weight = F.when(F.col("label") == 1, 2.0).otherwise(1.0)
        model = GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, weightCol="weight", featuresCol="vector", seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="vector", handleInvalid="keep"), model]).fit(labelled.withColumn("weight", weight))


def match_probability(features: DataFrame, model: PipelineModel | None, only_class: float | None = None) -> DataFrame:
    """features with match_probability: the model's; without one the cross-encoder's score or else jaro_winkler.

    only_class: the one class a model was trained on; it then gets certainty, whatever the features say.
    """
    if only_class is not None:
        return features.withColumn("match_probability", F.lit(float(only_class)))
    if model is None:
        given = [F.col(c) for c in ("sentence_cross_encoder", "jaro_winkler") if c in features.columns]
        return features.withColumn("match_probability", F.coalesce(*given, F.lit(0.0)).cast("double"))
    return model.transform(features).withColumn("match_probability", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def feature_importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def state_problems(decisions: DataFrame, nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(problem, left, right): decisions on unknown names, and mismatches inside a match component."""
    from sluice.operators.graph import conflicts

    known = nodes.select("norm").distinct()
    a = decisions.join(known.select(F.col("norm").alias("left")), "left", "left_anti")
    b = decisions.join(known.select(F.col("norm").alias("right")), "right", "left_anti")
    unknown = a.select("left", "right").unionByName(b.select("left", "right")).distinct().select(F.lit("unknown name").alias("problem"), "left", "right")
    return unknown.unionByName(conflicts(decisions, components).select(F.lit("conflict").alias("problem"), "left", "right"))
