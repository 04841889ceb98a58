"""One query per operator over the given tables. Trips are derived from the ``events`` table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import (
    boosting,
    cohorts,
    enrich,
    ensemble,
    evaluate,
    features,
    forest,
    models,
    profiles,
    quality,
    zones,
)
from waymark.plans import pipeline
from waymark.session import materialise, new_table_path
from waymark.sources import bundles
from waymark.sources import trips as source
from waymark.sources.calendar import calendar

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

THRESHOLD = 500


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _trips(spark: SparkSession, sf: str) -> DataFrame:
    return source.derived_trips(spark, sf)


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return cohorts.labelled_and_targets(_trips(spark, sf))


def _second(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


def _day(date: str) -> Column:
    return F.date_format(date, "yyyy-MM-dd").alias(date)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- sources and sinks

_LABELLED = ("r_key", "out_id", "start_time", "end_time", "start_lat_e5", "start_lon_e5", "end_lat_e5", "end_lon_e5")


def _shown(trips: DataFrame, columns=_LABELLED) -> DataFrame:
    return trips.select(*[_second(c) if c.endswith("_time") else F.col(c) for c in columns])


@query
def trips_labelled(spark, sf):
    return _shown(_split(spark, sf)[0])


@query
def trips_unlabelled(spark, sf):
    path = source.write_unlabelled_csv(_split(spark, sf)[1], new_table_path(spark, "targets-csv"))
    back = source.read_unlabelled_csv(spark, path).where("end_lat_e5 is null")
    back = back.withColumn("r_key", F.col("r_key").cast("bigint")).withColumn("out_id", F.col("out_id").cast("bigint"))
    return _shown(back, ("r_key", "out_id", "start_time", "start_lat_e5", "start_lon_e5"))


@query
def trips_csv_roundtrip(spark, sf):
    path = source.write_csv(_split(spark, sf)[0], new_table_path(spark, "trips-csv"))
    back = source.read_labelled_csv(spark, path)
    return _shown(back.withColumn("r_key", F.col("r_key").cast("bigint")).withColumn("out_id", F.col("out_id").cast("bigint")))


def _examples(spark: SparkSession, sf: str) -> pipeline.Examples:
    return pipeline.two_pass_examples(*_split(spark, sf), threshold=THRESHOLD)


def _runs(spark: SparkSession, sf: str, *names: str) -> tuple[pipeline.Examples, DataFrame]:
    examples = _examples(spark, sf)
    runs = pipeline.knn_runs()
    return examples, pipeline.model_runs(examples, {n: runs[n] for n in names or runs})


def _predictions(spark: SparkSession, sf: str, *names: str) -> tuple[pipeline.Examples, DataFrame, DataFrame]:
    examples, probabilities = _runs(spark, sf, *names)
    return examples, probabilities, pipeline.predictions(probabilities, examples)


def _scored(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    examples, _, predicted = _predictions(spark, sf, *names)
    return pipeline.validation(predicted, examples)


@query
def bundle_roundtrip(spark, sf):
    examples, probabilities, predicted = _predictions(spark, sf)
    path = bundles.save_bundle(
        {
            "validation": pipeline.validation(predicted, examples),
            "predictions": pipeline.final_predictions(predicted),
            "probabilities_target": probabilities.where("fold = 'final'").drop("out_id"),
            "probabilities_train": probabilities.where("fold = 'validate'"),
        },
        new_table_path(spark, "bundle"),
    )
    out = None
    for table in bundles.TABLES:
        df = bundles.load_bundle(spark, path, table)
        if "out_id" not in df.columns:
            df = bundles.attach_car(df, _trips(spark, sf))
        one = df.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("out_id").alias("cars"))
        one = one.select(F.lit(table).alias("tab"), "model", "n", "cars")
        out = one if out is None else out.unionByName(one)
    return out


@query
def select_runs(spark, sf):
    losses = evaluate.loss_accuracy(_scored(spark, sf), ["model"])
    named = losses.select(
        bundles.run_name(F.col("loss"), F.col("model"), F.lit(THRESHOLD), F.lit(5), F.lit(0)).alias("model")
    )
    return bundles.select_runs(named, ".*_m[012]_.*split_num5.*", top=2)


# ---- enrichment


@query
def trip_distance(spark, sf):
    return enrich.with_distance(_trips(spark, sf)).select("r_key", "out_id", "distance")


@query
def trip_calendar(spark, sf):
    return enrich.with_calendar(_trips(spark, sf)).select(
        "r_key", _day("start_base"), F.col("day"), "weekday", "weekend", "hour_c", (F.col("hour_c") / F.lit(100.0)).alias("hour")
    )


def _january(spark: SparkSession) -> DataFrame:
    """The calendar of the test data's month."""
    return calendar(spark, "2024-01-01", "2024-01-31", [("2024-01-01", "2024-01-01")], ["2024-01-14"])


@query
def trip_holiday(spark, sf):
    return enrich.with_holiday(_trips(spark, sf), _january(spark)).select("r_key", "holiday")


@query
def trip_hour_of_week(spark, sf):
    return enrich.with_calendar(_trips(spark, sf)).select("r_key", "hour_wk")


@query
def trip_duration(spark, sf):
    return enrich.with_duration(_trips(spark, sf)).select("r_key", "duration")


@query
def trip_geohash(spark, sf):
    names = [f"geo{p}{s}" for p in range(4, 10) for s in ("", "_end")]
    return enrich.with_geohash(_trips(spark, sf)).select("r_key", *names)


@query
def geohash_codes(spark, sf):
    return enrich.geohash_codes(_trips(spark, sf))


def _profiled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    trips = enrich.with_distance(_trips(spark, sf))
    return trips, profiles.car_distance_profile(trips)


@query
def far_trips(spark, sf):
    return enrich.far_trips(*_profiled(spark, sf)).select("r_key", "out_id", "distance", "far")


@query
def departure_time_gap(spark, sf):
    return enrich.departure_time_gaps(_trips(spark, sf))


@query
def weekly_trips(spark, sf):
    return enrich.weekly_trips(_trips(spark, sf)).select("out_id", "week_sn", "trips", _day("week_start"))


@query
def date_dimension(spark, sf):
    dates = _table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    wide = enrich.date_dimension(dates)
    texts = [c for c in wide.columns if c not in ("week_sn", "as_text")]
    since = F.datediff("date", F.lit("2012-01-01").cast("date")).cast("bigint").alias("days_since")
    return wide.select("week_sn", "as_text", since, *[_day(c) for c in texts])


# ---- profiles


@query
def car_distance_profile(spark, sf):
    return _profiled(spark, sf)[1]


@query
def trips_with_profile(spark, sf):
    return profiles.attach_profile(*_profiled(spark, sf)).select(
        "r_key", "out_id", "distance", "distance_min", "distance_max", "distance_mean"
    )


@query
def score_cars(spark, sf):
    return profiles.score_cars(_split(spark, sf)[1])


@query
def trips_scored_cars(spark, sf):
    labelled, targets = _split(spark, sf)
    return profiles.only_cars(labelled, targets).select("r_key", "out_id")


@query
def car_geo_footprint(spark, sf):
    return profiles.car_geo_footprint(_trips(spark, sf))


@query
def car_geo_footprint_both(spark, sf):
    labelled, targets = _split(spark, sf)
    return profiles.footprints_side_by_side(labelled, targets)


@query
def rare_geo_cells(spark, sf):
    return profiles.rare_geo_cells(_trips(spark, sf))


def _dictionary(spark: SparkSession, sf: str, threshold=THRESHOLD) -> DataFrame:
    return zones.zone_dictionary(_trips(spark, sf), threshold)


def _snapped(spark: SparkSession, sf: str) -> DataFrame:
    return zones.snap_trips(_trips(spark, sf), materialise(_dictionary(spark, sf), "dictionary"))


@query
def end_zone_profile(spark, sf):
    joined = profiles.attach_end_zone_profile(_snapped(spark, sf))
    return joined.select("r_key", "out_id", "end_zoneid", _second("first_visit"), _second("last_visit"), "visits")


@query
def start_zone_profile(spark, sf):
    snapped = enrich.with_distance(_snapped(spark, sf)).withColumn(
        "duration_s", F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time"))
    )
    snapped = materialise(snapped.select("r_key", "out_id", "start_zoneid", "start_sn", "end_zoneid", "end_sn", "distance", "duration_s"), "start-zones")
    profile = profiles.start_zone_profile(snapped)
    joined = profiles.attach_start_zone_profile(snapped, profile)
    measures = [c for c in profile.columns if c.startswith("sz_")]
    return joined.select("r_key", "out_id", *[F.round(c, 4).alias(c) for c in measures])


# ---- zones


@query
def car_addresses(spark, sf):
    return zones.car_addresses(_trips(spark, sf))


@query
def address_gaps(spark, sf):
    return zones.address_gaps(zones.car_addresses(_trips(spark, sf)))


@query
def car_thresholds(spark, sf):
    return zones.car_thresholds(_profiled(spark, sf)[1], 5).select("out_id", "distance_mean", "threshold")


def _address_zones(spark: SparkSession, sf: str) -> DataFrame:
    addresses = zones.with_threshold(zones.car_addresses(_trips(spark, sf)), THRESHOLD)
    return zones.address_zones(addresses)


@query
def address_zones(spark, sf):
    return _address_zones(spark, sf).select("out_id", "lat_e5", "lon_e5", "zoneid")


@query
def zone_centers(spark, sf):
    return zones.zone_centers(_address_zones(spark, sf)).drop("threshold")


@query
def zone_merge_pairs(spark, sf):
    return zones.zone_merge_pairs(materialise(_address_zones(spark, sf), "address-zones"))


@query
def zone_merge_map(spark, sf):
    return zones.zone_merge_map(materialise(_address_zones(spark, sf), "address-zones"))


@query
def zones_merged(spark, sf):
    return zones.build_zones(_trips(spark, sf), THRESHOLD).select(
        "out_id", "lat_e5", "lon_e5", "zoneid_raw", "zoneid", "center_lat", "center_lon", "distance_2_center"
    )


def _traffic(spark: SparkSession, sf: str) -> DataFrame:
    trips = _trips(spark, sf)
    return zones.zone_in_out(zones.build_zones(trips, THRESHOLD), trips)


@query
def zone_in_out(spark, sf):
    return _traffic(spark, sf)


@query
def zone_shares(spark, sf):
    return zones.zone_shares(_traffic(spark, sf))


@query
def zone_rank(spark, sf):
    return zones.zone_rank(_traffic(spark, sf)).select("out_id", "zoneid", "in_out", "sn")


@query
def zone_drop_ratio(spark, sf):
    return zones.zone_drop_ratio(_traffic(spark, sf)).select("out_id", "zoneid", "in_out", "drop_percent")


@query
def zone_dictionary(spark, sf):
    return _dictionary(spark, sf)


@query
def zone_dictionary_adaptive(spark, sf):
    trips, profile = _profiled(spark, sf)
    return zones.zone_dictionary(trips, zones.car_thresholds(profile, 5))


@query
def trips_snapped(spark, sf):
    names = [f"{side}_{c}" for side in ("start", "end") for c in ("zoneid", "sn", "lat_adj", "lon_adj")]
    return _snapped(spark, sf).select("r_key", "out_id", *names)


@query
def center_gaps(spark, sf):
    return zones.center_gaps(_dictionary(spark, sf))


@query
def zone_center_list(spark, sf):
    return zones.zone_center_list(_dictionary(spark, sf))


@query
def zone_distance_matrix(spark, sf):
    dictionary = materialise(_dictionary(spark, sf), "dictionary")
    used = zones.snap_trips(_trips(spark, sf), dictionary).where("start_zoneid is not null and end_zoneid is not null")
    wanted = used.select("out_id", F.col("start_zoneid").alias("zoneid_a"), F.col("end_zoneid").alias("zoneid_b")).distinct()
    return zones.zone_distances(wanted, dictionary)


@query
def zones_knn_reduced(spark, sf):
    return zones.zones_knn_reduced(_dictionary(spark, sf), threshold=4, least_zones=20)


@query
def zones_kmeans_reduced(spark, sf):
    return zones.zones_kmeans_reduced(materialise(_dictionary(spark, sf), "dictionary"), centers=5)


@query
def zones_renumbered(spark, sf):
    return zones.zones_renumbered(_dictionary(spark, sf)).select("out_id", "lat_e5", "lon_e5", "zoneid")


@query
def zones_visit_centered(spark, sf):
    return zones.zones_visit_centered(_snapped(spark, sf)).select("r_key", "out_id", "end_zoneid", "end_lat_adj", "end_lon_adj")


@query
def car_top_centers(spark, sf):
    return zones.car_top_centers(_dictionary(spark, sf), 4)


@query
def trip_center_distances(spark, sf):
    dictionary = materialise(_dictionary(spark, sf), "dictionary")
    snapped = zones.snap_trips(_trips(spark, sf), dictionary)
    measured = zones.center_distances(snapped, zones.car_top_centers(dictionary, 4), 4)
    return measured.select("r_key", "out_id", *[f"dis_center_{i}" for i in range(4)])


# ---- cohorts and splits


@query
def cohort_quantile(spark, sf):
    return cohorts.cohort_quantile(_snapped(spark, sf), 5)


@query
def cohort_geo(spark, sf):
    return cohorts.cohort_geo(_trips(spark, sf))


@query
def cohort_holdout(spark, sf):
    grouped = cohorts.with_cohort(_trips(spark, sf), cohorts.cohort_quantile(_snapped(spark, sf), 5))
    return cohorts.holdout_first_rows(grouped).select("r_key", "out_id", "cohort", "holdout")


@query
def cohort_partitions(spark, sf):
    labelled, targets = _split(spark, sf)
    groups = materialise(cohorts.cohort_geo(labelled), "cohorts")
    out = None
    for part, trips in (("train", labelled), ("test", targets)):
        path = source.write_csv(cohorts.with_cohort(trips, groups), new_table_path(spark, f"cohort-{part}"), "cohort")
        back = spark.read.option("header", True).csv(path)
        one = back.groupBy(F.col("cohort").cast("bigint").alias("cohort")).agg(
            F.count("*").alias("trips"), F.countDistinct("out_id").alias("cars")
        )
        one = one.withColumn("part", F.lit(part))
        out = one if out is None else out.unionByName(one)
    return out


@query
def holdout_latest(spark, sf):
    return cohorts.holdout_latest(_trips(spark, sf)).select("r_key", "out_id", "holdout")


@query
def holdout_earliest(spark, sf):
    return cohorts.holdout_earliest(_trips(spark, sf)).select("r_key", "out_id", "validate")


@query
def sample_cars(spark, sf):
    trips = _trips(spark, sf)
    busiest = profiles.score_cars(trips).limit(3)
    return cohorts.sample_cars(trips, 10, always=busiest)


@query
def worst_cars(spark, sf):
    best = ensemble.best_model_by_car(_scored(spark, sf)).select("out_id", "loss")
    return cohorts.worst_cars(best, profiles.score_cars(_split(spark, sf)[1]), 0.4, 5)


# ---- features and models


@query
def trip_features(spark, sf):
    return features.trip_features(enrich.with_calendar(_trips(spark, sf)))


@query
def features_scaled(spark, sf):
    labelled, targets = (enrich.with_calendar(df) for df in _split(spark, sf))
    columns = features.feature_columns("0")
    fitted = features.scaler(labelled, columns, ["out_id"])

    def part(name: str, df: DataFrame) -> DataFrame:
        scaled = features.scale_features(df.select("r_key", "out_id", *columns), fitted, columns, ["out_id"])
        return scaled.select(F.lit(name).alias("part"), "r_key", "out_id", *[F.round(c, 6).alias(c) for c in columns])

    return part("train", labelled).unionByName(part("test", targets))


@query
def geo_hour_traffic(spark, sf):
    return features.geo_hour_traffic(*_split(spark, sf))


@query
def geo_hour_matrix(spark, sf):
    return features.geo_hour_matrix(features.geo_hour_traffic(*_split(spark, sf)))


@query
def geo_hour_gram(spark, sf):
    return features.geo_hour_gram(features.geo_hour_traffic(*_split(spark, sf)))


def _embedding(spark: SparkSession, sf: str, components: int = 3) -> DataFrame:
    return features.geo_embedding(features.geo_hour_traffic(*_split(spark, sf)), components)


@query
def geo_embedding(spark, sf):
    return _embedding(spark, sf)


@query
def trips_embedded(spark, sf):
    joined = features.attach_embedding(_trips(spark, sf), _embedding(spark, sf))
    return joined.select("r_key", "out_id", "cell", *[f"geo_rd_c3_{i}" for i in range(3)])


@query
def train_near_targets(spark, sf):
    return features.train_near_targets(*_split(spark, sf), precision=6).select("r_key", "out_id")


@query
def train_top_zones(spark, sf):
    return features.train_top_zones(_snapped(spark, sf), 10).select("r_key", "out_id", "end_zoneid")


_TREE = ("weekday", "weekend", "hour_c", "start_zoneid")


def _tree_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    known = enrich.with_calendar(_snapped(spark, sf)).withColumn("start_zoneid", F.coalesce("start_zoneid", F.lit(0)))
    rows, asked = forest.feature_rows(known, known, _TREE)
    return materialise(rows, "tree-rows"), asked


@query
def tree_best_split(spark, sf):
    rows, _ = _tree_rows(spark, sf)
    _, splits = forest.grow(rows, trees=1, depth=1)
    return splits.select("out_id", F.col("feature").cast("bigint").alias("feature"), "twice_cut", "weight", F.round("gain", 6).alias("gain"))


@query
def tree_probabilities(spark, sf):
    rows, asked = _tree_rows(spark, sf)
    return forest.tree_shares(rows, asked, trees=1, depth=4).drop("tree")


@query
def feature_importance(spark, sf):
    rows, _ = _tree_rows(spark, sf)
    _, splits = forest.grow(rows, trees=1, depth=4)
    return forest.feature_importance(splits, _TREE).withColumn("importance", F.round("importance", 6))


def _fold_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and queries of the pass that learns from all labelled trips."""
    examples = _examples(spark, sf)
    final = [t.where("fold = 'final'") for t in (examples.train, examples.queries)]
    rows, asked = forest.feature_rows(*final, features.feature_columns("0"))
    return materialise(rows, "tree-rows"), asked


@query
def out_of_fold_probabilities(spark, sf):
    """Every labelled trip from a tree that has learned from the other four fifths."""
    return forest.cross_fitted(_fold_rows(spark, sf)[0], folds=5, depth=4).withColumn("p", F.round("p", 6))


@query
def forest_probabilities(spark, sf):
    return pipeline.forest_run(_examples(spark, sf), trees=100, depth=4).withColumn("p", F.round("p", 9))


def _boosted(spark: SparkSession, sf: str, settings: boosting.Settings, stop_early: bool) -> DataFrame:
    examples, keys = _examples(spark, sf), ["fold", "out_id"]
    held = examples.queries.where("fold = 'validate'") if stop_early else None
    return boosting.boosted_probabilities(examples.train, examples.queries, features.feature_columns("0"), settings, held, keys)


@query
def boosted_probabilities(spark, sf):
    found = _boosted(spark, sf, boosting.Settings(rounds=2, depth=4), stop_early=False)
    return found.withColumn("p", F.round("p", 6))


@query
def boosted_leafwise(spark, sf):
    """Trees bounded by their leaves alone, of any depth, and as many rounds as the library is run for; cars are too small for 20 rows a leaf."""
    return _boosted(spark, sf, replace(boosting.LEAF_WISE, rounds=50, least_rows=3), stop_early=True)


@query
def knn_probabilities(spark, sf):
    return _runs(spark, sf, "m0")[1].select("fold", "out_id", "r_key", "zoneid", "p")


@query
def knn_weighted(spark, sf):
    examples = _examples(spark, sf)
    found = models.knn_probabilities(examples.train, examples.queries, 5, 2, keys=["fold", "out_id"], weights="distance")
    return found.withColumn("p", F.round("p", 6))


@query
def fold_average(spark, sf):
    """Mean over the trees of five folds, for the targets."""
    each = forest.fold_shares(*_fold_rows(spark, sf), folds=5, depth=4)
    mean = models.fold_average(each, ["out_id", "r_key", "zoneid"])
    return mean.withColumn("p", F.round("p", 6))


@query
def predicted_zone(spark, sf):
    return models.predicted_zone(_runs(spark, sf)[1], ["model", "fold", "out_id"])


@query
def predicted_position(spark, sf):
    return _predictions(spark, sf)[2].select("model", "fold", "r_key", "out_id", "predict_zone_id", "predict_lat", "predict_lon")


@query
def two_pass_predictions(spark, sf):
    examples, _, predicted = _predictions(spark, sf, "m0")
    losses = pipeline.validation(predicted, examples).select("r_key", "fold", "final_loss")
    tags = [F.lit("knn").alias("model_type"), F.lit(THRESHOLD).alias("threshold"), F.lit("k=19,p=5").alias("kw")]
    return predicted.join(losses, ["r_key", "fold"], "left").select(
        "fold", "r_key", "out_id", "predict_zone_id", "predict_lat", "predict_lon", *tags, "final_loss"
    )


def _swept(spark: SparkSession, sf: str) -> DataFrame:
    labelled, _ = _split(spark, sf)
    cars = materialise(cohorts.cohort_geo(labelled), "cohorts")
    # a run has a threshold for every cohort; cars outside all cohorts (-1) take that of the last
    settings = {"r0": cohorts.COHORT_THRESHOLDS, "r1": (500,) * 6, "r2": (300, 400, 400, 400, 400, 400)}
    runs = [(run, cohort, metres[cohort]) for run, metres in settings.items() for cohort in (-1, 0, 1, 2, 3, 4, 5)]
    runs = spark.createDataFrame(runs, "run_id string, cohort bigint, threshold bigint")
    return pipeline.sweep(labelled, cars, runs)


@query
def threshold_sweep(spark, sf):
    return _swept(spark, sf)


@query
def sweep_best(spark, sf):
    return pipeline.best_run(_swept(spark, sf))


# ---- evaluation


@query
def miss_distance(spark, sf):
    return _scored(spark, sf).select("model", "r_key", F.rint("loss_dis").cast("bigint").alias("loss_dis"))


@query
def trip_loss(spark, sf):
    return _scored(spark, sf).select("model", "r_key", "final_loss")


@query
def loss_accuracy(spark, sf):
    return evaluate.loss_accuracy(_scored(spark, sf), ["model"])


@query
def loss_by_car(spark, sf):
    return evaluate.loss_by_car(_scored(spark, sf))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    scores = _table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 101) / F.lit(100.0)).alias("score"))
    return _table(spark, sf, "labels").join(scores, "doc_id")


@query
def multilabel_f(spark, sf):
    pairs = F.array(
        F.struct(F.lit("quality").alias("label"), F.col("quality").cast("bigint").alias("truth"), F.col("score").alias("score")),
        F.struct(F.lit("toxic").alias("label"), F.col("toxic").cast("bigint").alias("truth"), (F.lit(1) - F.col("score")).alias("score")),
    )
    long = _labels(spark, sf).select(F.col("doc_id").alias("r_key"), F.explode(pairs).alias("l")).select("r_key", "l.*")
    return evaluate.multilabel_f(long, 0.5)


def _binary(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).select(F.col("quality").cast("bigint").alias("truth"), "score")


@query
def precision_recall_f(spark, sf):
    scores = evaluate.precision_recall_f(_binary(spark, sf), beta=2.0)
    return scores.select(*[F.round(c, 9).alias(c) for c in scores.columns])


@query
def best_cutoff(spark, sf):
    return evaluate.best_cut_off(_binary(spark, sf))


# ---- ensembles


@query
def best_model_by_car(spark, sf):
    return ensemble.best_model_by_car(_scored(spark, sf))


@query
def mean_best_loss(spark, sf):
    return ensemble.mean_best_loss(ensemble.best_model_by_car(_scored(spark, sf)))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    examples, _, predicted = _predictions(spark, sf)
    best = ensemble.best_model_by_car(pipeline.validation(predicted, examples))
    return ensemble.merge_best(pipeline.final_predictions(predicted), best)


@query
def merged_predictions(spark, sf):
    return _merged(spark, sf).select("model", "r_key", "out_id", "predict_zone_id", "predict_lat", "predict_lon")


@query
def submission(spark, sf):
    return ensemble.submission(_split(spark, sf)[1], _merged(spark, sf))


@query
def coalesced_predictions(spark, sf):
    labelled, _ = _split(spark, sf)
    _, _, predicted = _predictions(spark, sf, "m0", "m1")
    final = pipeline.final_predictions(predicted)
    tuned = cohorts.with_cohort(final.where("model = 'm1'"), cohorts.cohort_geo(labelled)).drop("cohort")
    runs = tuned.withColumn("priority", F.lit(0)).unionByName(final.where("model = 'm0'").withColumn("priority", F.lit(1)))
    return ensemble.first_value_wins(runs, "priority", ["predict_lat", "predict_lon"])


@query
def concatenated_predictions(spark, sf):
    _, _, predicted = _predictions(spark, sf)
    final = pipeline.final_predictions(predicted)
    return bundles.select_runs(final, "^m[01]$").select("model", "r_key", "predict_lat", "predict_lon")


@query
def runs_any_form(spark, sf):
    """One run stored as positions and one as a column per zone."""
    examples, probabilities, predicted = _predictions(spark, sf, "m0", "m1")
    final = pipeline.final_predictions(predicted).where("model = 'm1'")
    paths = {"m1": new_table_path(spark, "positions"), "m0": new_table_path(spark, "wide")}
    final.select("r_key", "predict_lat", "predict_lon").write.parquet(paths["m1"])
    bundles.save_wide(probabilities.where("fold = 'final' and model = 'm0'"), paths["m0"])
    return bundles.read_any_form(spark, paths, examples.dictionary)


@query
def stack_features(spark, sf):
    _, probabilities = _runs(spark, sf)
    validate = ensemble.stack_features(probabilities.where("fold = 'validate'")).withColumn("fold", F.lit("validate"))
    return validate.unionByName(
        ensemble.stack_features(probabilities.where("fold = 'final'")).withColumn("fold", F.lit("final"))
    )


def _stacked(spark: SparkSession, sf: str) -> tuple[pipeline.Examples, DataFrame]:
    examples, probabilities = _runs(spark, sf)
    return examples, pipeline.stacked_probabilities(probabilities, examples, trees=100, depth=4)


@query
def stacked_probabilities(spark, sf):
    return _stacked(spark, sf)[1].withColumn("p", F.round("p", 9))


@query
def stacked_position(spark, sf):
    examples, probabilities = _stacked(spark, sf)
    return ensemble.stacked_position(models.predicted_zone(probabilities), examples.dictionary).select(
        "r_key", "out_id", "predict_zone_id", "predict_lat", "predict_lon"
    )


# ---- data quality and encoding


def _holed(spark: SparkSession, sf: str) -> DataFrame:
    """Events with some values missing or infinite."""
    i = F.col("event_id")
    return _table(spark, sf, "events").select(
        "event_id",
        F.when(i % 17 == 0, F.lit(None)).when(i % 23 == 0, float("inf")).otherwise(F.col("value")).alias("v"),
        F.when(i % 19 != 0, F.col("event_type")).alias("t"),
        F.when(i % 13 != 0, F.col("event_type")).alias("r"),
        (i % 5 != 0).alias("is_train"),
    )


@query
def impute_missing(spark, sf):
    filled = quality.impute_missing(_holed(spark, sf), F.col("is_train"), ["v"], ["t", "r"], {"r": "null"})
    return filled.select("event_id", F.round("v", 6).alias("v"), "t", "r")


@query
def label_encode(spark, sf):
    documents = _table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("lang"), "source"
    )
    return quality.label_encode(documents, ["lang", "source"])


@query
def numeric_exceptions(spark, sf):
    return quality.numeric_exceptions(_holed(spark, sf), ["v", "event_id"])


@query
def exception_report(spark, sf):
    return quality.exception_report(_holed(spark, sf), "event_id", ["v"])
