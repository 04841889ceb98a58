"""Whole runs: from trips to zones, features, predictions and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import skew
from waymark.operators import cohorts, enrich, ensemble, evaluate, forest, models, zones
from waymark.operators.features import feature_columns
from waymark.session import materialise

CAR = ("out_id",)
FOLDS = ("validate", "final")


@dataclass
class Examples:
    """Inputs of the two passes: ``train`` and ``queries`` carry a ``fold`` column, ``centres`` one row per zone."""

    train: DataFrame
    queries: DataFrame
    centres: DataFrame
    dictionary: DataFrame


def two_pass_examples(
    labelled: DataFrame, targets: DataFrame, threshold=500, parts: int = 5, keys: Sequence[str] = CAR, gp: str = "knn"
) -> Examples:
    """Training rows and queries of both passes.

    The ``validate`` pass trains on the earliest trips of a car and asks about its latest labelled ones; the ``final`` pass
    trains on all labelled trips and asks about the targets. Zones come from all labelled trips.
    """
    keys = list(keys)
    dictionary = materialise(zones.zone_dictionary(labelled, threshold, keys), "dictionary")
    split = cohorts.holdout_earliest(labelled, parts)
    snapped = zones.snap_trips(split, dictionary, keys)
    asked = zones.snap_trips(targets, dictionary, keys, sides=("start",))
    if gp == "knn":
        top = zones.car_top_centers(dictionary, 3, keys)
        snapped = zones.center_distances(snapped, top, 3, keys)
        asked = zones.center_distances(asked, top, 3, keys)
    columns = feature_columns(gp)
    base = [*keys, "r_key", *columns]
    known = enrich.with_calendar(snapped)
    answers = ["end_zoneid", "end_lat_e5", "end_lon_e5"]
    known = known.select(*base, *answers, "validate")
    hidden = enrich.with_calendar(asked).select(
        *base, *[F.lit(None).cast("bigint").alias(c) for c in answers]
    )
    both = F.when(F.col("validate") == 0, F.array(F.lit("validate"), F.lit("final"))).otherwise(F.array(F.lit("final")))
    train = known.withColumn("fold", F.explode(both)).drop("validate")
    queries = known.where("validate = 1").drop("validate").withColumn("fold", F.lit("validate")).unionByName(
        hidden.withColumn("fold", F.lit("final"))
    )
    return Examples(
        materialise(train, "train"), materialise(queries, "queries"), zones.zone_center_list(dictionary, keys), dictionary
    )


def model_runs(examples: Examples, runs: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """Probabilities of several models on the same examples, as one long table with a ``model`` column, written once."""
    out = None
    for name, fit in runs.items():
        one = fit(examples.train, examples.queries).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return materialise(out, "probabilities")


def knn_runs() -> dict[str, Callable[[DataFrame, DataFrame], DataFrame]]:
    """Three nearest-neighbour settings and the most frequent zone."""
    keys = ["fold", *CAR]
    runs = {
        f"m{i}": (lambda train, queries, k=k, p=p: models.knn_probabilities(train, queries, k, p, keys=keys))
        for i, (k, p) in enumerate(((19, 5), (5, 2), (1, 2)))
    }
    runs["m3"] = lambda train, queries: models.most_frequent_zone(train, queries, keys)
    return runs


def predictions(probabilities: DataFrame, examples: Examples, keys: Sequence[str] = ("model", "fold", "out_id")) -> DataFrame:
    """Predicted zone and position of every query of every model and fold."""
    return models.predicted_position(models.predicted_zone(probabilities, keys), examples.centres, keys)


def validation(predicted: DataFrame, examples: Examples) -> DataFrame:
    """Predictions of the validate pass beside their true ends, with miss and loss."""
    truth = examples.queries.where("fold = 'validate'").select("r_key", "end_zoneid", "end_lat_e5", "end_lon_e5")
    joined = predicted.where("fold = 'validate'").join(truth, "r_key")
    return evaluate.trip_loss(evaluate.miss_distance(joined))


def final_predictions(predicted: DataFrame) -> DataFrame:
    return predicted.where("fold = 'final'").drop("fold")


def forest_run(examples: Examples, trees: int = 100, depth: int = 4, fold: str | None = None, gp: str = "0") -> DataFrame:
    """Forest probabilities of both folds, or of one."""
    keys = ["fold", *CAR]
    train, queries = examples.train, examples.queries
    if fold:
        train, queries = train.where(F.col("fold") == fold), queries.where(F.col("fold") == fold)
    rows, asked = forest.feature_rows(train, queries, feature_columns(gp), keys)
    return forest.forest_probabilities(materialise(rows, "forest-rows"), asked, trees, depth, keys=keys)


def stacked_probabilities(probabilities: DataFrame, examples: Examples, trees: int = 100, depth: int = 4) -> DataFrame:
    """Second-level forest of each car: first-level probabilities are its features, in whole percent.

    It trains on the validate pass, where the true zone is known, and answers for the targets. Probabilities a model did not
    give are 0 and not stored. Feature numbers count a car's ``model#zone`` names.
    """
    stack = ensemble.stack_features(probabilities.where("fold = 'validate'")).withColumn("fold", F.lit("validate")).unionByName(
        ensemble.stack_features(probabilities.where("fold = 'final'")).withColumn("fold", F.lit("final"))
    )
    known = stack.where("fold = 'validate'").select("out_id", "feature").distinct()
    numbered = skew.with_position(known, ["out_id"], ["feature"], [F.substring("feature", 1, 6)], "at", "n_features", cold="")
    numbered = numbered.withColumn("at", (F.col("at") - 1).cast("int"))
    coded = stack.join(numbered.select("out_id", "feature", "at"), ["out_id", "feature"], "inner")
    entry = F.struct("at", F.rint(F.col("p") * 100).cast("int").alias("p"))
    wide = coded.groupBy("fold", "out_id", "r_key").agg(F.map_from_entries(F.collect_list(entry)).alias("x"))
    sizes = numbered.groupBy("out_id").agg(F.max("n_features").cast("int").alias("n_features"))
    rows = materialise(wide.join(sizes, ["out_id"], "inner"), "stack-rows")
    truth = examples.queries.where("fold = 'validate'").select("r_key", F.col("end_zoneid").alias("label"))
    train = materialise(rows.where("fold = 'validate'").drop("fold").join(truth, "r_key"), "stack-train")
    return forest.forest_probabilities(train, rows.where("fold = 'final'").drop("fold"), trees, depth, sparse=True)


def sweep(
    labelled: DataFrame,
    cars: DataFrame,
    runs: DataFrame,
    k: int = 5,
    power: int = 2,
    parts: int = 5,
) -> DataFrame:
    """Validation loss of every run and cohort, all runs in one job.

    ``cars`` gives each car's ``cohort``; ``runs`` holds ``run_id, cohort, threshold``, one threshold per cohort as tuned for
    that run. The run becomes part of the car key, so zones, features and neighbours are found for all runs together.
    """
    keys = ["run_id", "out_id"]
    split = cohorts.holdout_earliest(labelled, parts)
    placed = split.join(cars.select("out_id", "cohort"), ["out_id"], "inner")
    per_run = placed.join(F.broadcast(runs), "cohort")
    thresholds = per_run.select(*keys, "threshold").distinct()
    each = per_run.drop("threshold")
    dictionary = materialise(zones.zone_dictionary(each, thresholds, keys), "sweep-dictionary")
    snapped = materialise(enrich.with_calendar(zones.snap_trips(each, dictionary, keys, sides=("end",))), "sweep-trips")
    train, queries = snapped.where("validate = 0"), snapped.where("validate = 1")
    probabilities = models.knn_probabilities(train, queries, k, power, "0", keys)
    zone = models.predicted_zone(probabilities, keys)
    placed_zone = models.predicted_position(zone, zones.zone_center_list(dictionary, keys), keys)
    truth = queries.select(*keys, "r_key", "cohort", "end_zoneid", "end_lat_e5", "end_lon_e5")
    scored = evaluate.trip_loss(evaluate.miss_distance(placed_zone.join(truth, [*keys, "r_key"])))
    return evaluate.loss_accuracy(scored, ["run_id", "cohort"])


def best_run(losses: DataFrame) -> DataFrame:
    """For each cohort the run with the least loss, ties to the first run."""
    return losses.groupBy("cohort").agg(
        F.min_by("run_id", F.struct("loss", "run_id")).alias("run_id"), F.min("loss").alias("loss")
    )
