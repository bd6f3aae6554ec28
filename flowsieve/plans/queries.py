"""The query catalogue: every operator over the given tables, whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve import presets
from flowsieve.functions.labels import recode
from flowsieve.functions.names import normalise_names
from flowsieve.functions.network import prefix_flags
from flowsieve.functions.times import clock_parts, cyclic_time, parse_time, weekend_flag
from flowsieve.operators import anomaly, features, models, profile, quantiles, report, rows, selection, tuning
from flowsieve.operators import metrics as M
from flowsieve.operators.journal import Journal
from flowsieve.session import checkpoint_root, materialise, small_table
from flowsieve.sources.flows import RESCUED, scan_csv, scan_parquet, stack_sources

NUMERICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
EVENT_LABELS = {"error": 1, "click": 0, "purchase": 0, "signup": 0, "view": 0}
HOST_PREFIXES = {
    "blog http": "http://blog.",
    "blog https": "https://blog.",
    "www http": "http://www.",
    "www https": "https://www.",
    "m.https": "https://m.",
}
#: Eight columns or more each, as the forest takes eight features per tree.
OUTLIER_GROUPS = {
    "numbers": [*KEYS, *NUMERICS],
    "ratios": ["l_partkey", "l_suppkey", "unit_price", "charge", *NUMERICS],
}
ROUND = 6


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, ROUND)


# --- scans and sinks


def scan_flows(spark, d):
    schema = T.StructType(
        [
            T.StructField("l_orderkey", T.LongType()),
            T.StructField("l_linenumber", T.IntegerType()),
            T.StructField("l_suppkey", T.IntegerType()),
            T.StructField("l_quantity", T.DoubleType()),
            T.StructField("l_extendedprice", T.DoubleType()),
            T.StructField("l_returnflag", T.StringType()),
            T.StructField("l_shipdate", T.TimestampNTZType()),
        ]
    )
    return scan_parquet(spark, f"{d}/lineitem.parquet", schema)


def _by_flag(spark, d):
    li = table(spark, d, "lineitem")
    base = ["l_orderkey", "l_linenumber", "l_quantity"]
    return {
        "A": li.where("l_returnflag = 'A'").select(*base, "l_extendedprice"),
        "N": li.where("l_returnflag = 'N'").select("l_extendedprice", "l_tax", *base),
        "R": li.where("l_returnflag is null or l_returnflag not in ('A', 'N')").select("l_discount", *base),
    }


def stack(spark, d):
    return stack_sources(_by_flag(spark, d))


CSV_SCHEMA = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.LongType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
    ]
)


def _csv_folder(spark) -> str:
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/csv-{uuid.uuid4().hex}"


def scan_csv_sources(spark, d):
    """The detector's way in: headered CSV, a source per flag, columns in another order in each."""
    li = table(spark, d, "lineitem")
    folder, names = _csv_folder(spark), CSV_SCHEMA.names
    rest = "l_returnflag is null or l_returnflag not in ('A', 'N')"
    parts = {"A": ("l_returnflag = 'A'", names), "N": ("l_returnflag = 'N'", names[::-1]), "R": (rest, names[1:] + names[:1])}
    for source, (rule, order) in parts.items():
        li.where(rule).select(*order).write.option("header", True).csv(f"{folder}/{source}")
    return stack_sources({s: scan_csv(spark, f"{folder}/{s}", CSV_SCHEMA) for s in parts})


def scan_csv_mixed(spark, d):
    """One folder whose files have their columns in two orders, and numbers that are none."""
    spoiled = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        F.when(F.col("l_linenumber") == 3, F.lit("three")).otherwise(F.col("l_linenumber").cast("string")).alias("l_linenumber"),
        F.when(F.col("l_suppkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"),
        "l_returnflag",
    )
    folder, names = _csv_folder(spark), CSV_SCHEMA.names
    for rule, order in (("l_returnflag = 'R'", names[::-1]), ("l_returnflag is null or l_returnflag <> 'R'", names)):
        spoiled.where(rule).select(*order).write.mode("append").option("header", True).csv(folder)
    scanned = scan_csv(spark, folder, CSV_SCHEMA, rescue=True)
    lost = lambda c: F.coalesce(F.try_element_at(RESCUED, F.lit(c)), F.lit("")).alias(f"lost_{c}")
    return scanned.select(*names, lost("l_linenumber"), lost("l_quantity"))


def scan_row_id(spark, d):
    """Contiguous ids in scan order, over orders written as CSV in key order."""
    folder = _csv_folder(spark)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    orders.orderBy("o_orderkey").write.option("header", True).csv(folder)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType())])
    stored = materialise(scan_csv(spark, folder, schema, position=True), "scanned")
    return rows.scan_order_id(stored)


def row_id(spark, d):
    return rows.sorted_row_id(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


def frame_shape(spark, d):
    return rows.frame_shape(table(spark, d, "orders"))


# --- projections


def recode_label(spark, d):
    coded = recode(table(spark, d, "events"), "event_type", EVENT_LABELS, into="label")
    return coded.groupBy("event_type", "label").agg(F.count(F.lit(1)).alias("n"))


def drop_columns(spark, d):
    return rows.drop_columns(
        table(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_discount", "l_tax", "l_shipdate"]
    )


def select_features(spark, d):
    return rows.select_features(table(spark, d, "lineitem"), ["l_tax", "l_quantity", "l_discount"], "l_returnflag")


def messy_names(spark, d):
    li = table(spark, d, "lineitem")
    return normalise_names(
        li.select(
            F.col("l_orderkey").alias("Order Key"),
            F.col("l_linenumber").alias("Line 1.2."),
            F.col("l_quantity").alias("Qty/s"),
            F.col("l_tax").alias("Down/Up Ratio"),
        )
    )


def parse_time_query(spark, d):
    text = F.date_format("ts", "dd/MM/yyyy hh:mm:ss a")
    return (
        table(spark, d, "events")
        .select("event_id", text.alias("ts_text"))
        .withColumn("ts_parsed", parse_time(F.col("ts_text")))
    )


def time_parts(spark, d):
    minute, hour = clock_parts(F.col("ts"))
    return table(spark, d, "events").select("event_id", minute.alias("minute_part"), hour.alias("hour_part"))


def cyclic(spark, d):
    parts = table(spark, d, "events").select("event_id", *cyclic_time(F.col("ts")))
    return parts.select("event_id", *[r6(c).alias(c) for c in parts.columns[1:]])


def weekend(spark, d):
    return table(spark, d, "events").select("event_id", weekend_flag(F.col("ts")).alias("weekend"))


def prefixes(spark, d):
    return table(spark, d, "pages").select("page_id", "url", *prefix_flags(F.col("url"), HOST_PREFIXES))


def _embedding_width(df: DataFrame) -> int:
    """The common length of all rows; others would lose dimensions silently."""
    least, most = df.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        raise ValueError(f"embeddings of {least} to {most} numbers")
    return most


def assemble(spark, d):
    emb = table(spark, d, "embeddings")
    names = [f"e{i}" for i in range(_embedding_width(emb))]
    flat = emb.select(*[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    vectors = features.assemble(flat, names)
    stats = vectors.agg(
        Summarizer.metrics("mean", "std", "min", "max").summary(F.col("features")).alias("s")
    ).select(*[vector_to_array(f"s.{m}").alias(m) for m in ("mean", "std", "min", "max")])
    return stats.select(F.posexplode(F.arrays_zip("mean", "std", "min", "max")).alias("dim", "v")).select(
        "dim",
        r6("v.mean").alias("mean_value"),
        r6("v.std").alias("std_value"),
        r6("v.min").alias("min_value"),
        r6("v.max").alias("max_value"),
    )


def _rounded(df, columns):
    return df.select(*[r6(c).alias(c) if c in columns else c for c in df.columns])


ROW = ["l_orderkey as order_id", "l_linenumber as line_id"]
SCALED = [*KEYS, *NUMERICS]


def scale_std(spark, d):
    li = table(spark, d, "lineitem").selectExpr(*ROW, *SCALED)
    return _rounded(features.scale_std(li, SCALED), SCALED)


def _scaled_by_detector(spark, d, *, centre: bool) -> DataFrame:
    """Numeric columns through the vector and the scaler that the detector uses."""
    li = table(spark, d, "lineitem").selectExpr(*ROW, *[f"double({c}) as {c}" for c in SCALED])
    vectors = features.assemble(li, SCALED)
    scaled = features.fit_scaler(vectors, vectors.count(), centre=centre)(vectors)
    values = scaled.withColumn("_v", vector_to_array("scaled_features"))
    return values.select("order_id", "line_id", *[r6(F.col("_v")[i]).alias(c) for i, c in enumerate(SCALED)])


def scale_centred(spark, d):
    return _scaled_by_detector(spark, d, centre=True)


def scale_vector(spark, d):
    return _scaled_by_detector(spark, d, centre=False)


# --- filters


def drop_negative(spark, d):
    return rows.drop_negative(table(spark, d, "customer"), "c_acctbal")


def exclude_ids(spark, d):
    orders = table(spark, d, "orders")
    high = orders.where("o_totalprice > 490000").select("o_orderkey")
    return rows.exclude_ids(orders, high, "o_orderkey")


def quantile_cut(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    low, high = quantiles.exact_quantiles(events, [("value", 0.0001), ("value", 0.01)])
    return events.select(
        "event_id",
        "value",
        anomaly.flag("value", low).alias("flag_0001"),
        anomaly.flag("value", high).alias("flag_01"),
    )


# --- profiling


def constants(spark, d):
    li = table(spark, d, "lineitem").withColumn("always_one", F.lit(1))
    return profile.constant_columns(li)


def _twins(spark, d):
    return table(spark, d, "lineitem").select(
        *KEYS,
        *NUMERICS,
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("quantity_twin"),
        (F.col("l_extendedprice") / 2 - F.col("l_discount")).alias("price_twin"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
    )


TWINS = [*KEYS, *NUMERICS, "quantity_twin", "price_twin"]


def corr_matrix(spark, d):
    return profile.corr_matrix(_twins(spark, d), TWINS).withColumn("r", r6("r"))


def corr_gaps(spark, d):
    """Columns with nulls in different rows: each pair has the rows that have both."""
    holed = _twins(spark, d).withColumns(
        {
            "l_discount": F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")),
            "l_extendedprice": F.when(F.col("l_quantity") > 7, F.col("l_extendedprice")),
            "price_twin": F.when(F.col("l_partkey") % 5 < 3, F.col("price_twin")),
        }
    )
    found = profile.corr_matrix(holed, TWINS)
    return found.withColumn("r", r6("r"))


def corr_with_label(spark, d):
    return profile.corr_with_label(_twins(spark, d), TWINS, "label").withColumn("r", r6("r"))


def corr_prune(spark, d):
    twins = _twins(spark, d)
    gone = profile.corr_prune(twins, TWINS, "label")
    left = twins.drop(*gone)
    return left.agg(
        *[F.count(c).alias(f"n_{c}") if c in left.columns else F.lit(0).cast("long").alias(f"n_{c}") for c in TWINS]
    )


# --- folds and evaluation


def folds(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    return rows.stratified_folds(events, label="event_type", key=["event_id"])


def fold_balance(spark, d):
    return rows.fold_balance(folds(spark, d), label="event_type")


def train_test_fold(spark, d):
    train, test = rows.train_test(materialise(folds(spark, d), "folds", partition_by=["fold"]), 0)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _judged(spark, d):
    events = recode(table(spark, d, "events"), "event_type", EVENT_LABELS, into="label")
    return events.select("event_id", "label", (F.col("value") > 150).cast("int").alias("prediction"))


def confusion(spark, d):
    return M.confusion_matrix(_judged(spark, d))


def binary_metrics(spark, d):
    wide = M.binary_metrics(confusion(spark, d))
    return wide.select(*[r6(c).alias(c) for c in wide.columns])


def auc_hard(spark, d):
    return M.auc_hard(confusion(spark, d)).select(r6("auc_hard").alias("auc_hard"))


def fold_report(spark, d):
    judged = rows.stratified_folds(_judged(spark, d), label="label", key=["event_id"])
    matrix = M.confusion_matrix(judged, by=["fold"]).withColumn("model", F.lit("value_over_150"))
    wide = M.binary_metrics(matrix)
    table_ = M.long_metrics(wide, ["model", "fold"], ["accuracy", "precision", "recall", "f1"])
    found = report.fold_report(table_)
    return found.select(
        "model",
        "metric",
        *[r6(F.col("per_fold")[i]).alias(f"fold_{i}") for i in range(5)],
        r6("mean").alias("mean_value"),
    )


def auc_score(spark, d):
    """Scores of which few are equal."""
    li = table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"),
    )
    return M.exact_auc(li).withColumn("auc", F.round("auc", 9))


def report_append(spark, d):
    """Two runs appended, the first one twice, and what a reader finds then."""
    path = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/report-{uuid.uuid4().hex}"
    judged = rows.stratified_folds(_judged(spark, d), label="label", key=["event_id"])
    for run, some in (("all", judged), ("even", judged.where("event_id % 2 = 0")), ("all", judged)):
        matrix = M.confusion_matrix(some, by=["fold"]).withColumn("model", F.lit("value_over_150"))
        long = M.long_metrics(M.binary_metrics(matrix), ["model", "fold"], ["accuracy", "precision", "recall", "f1"])
        report.append_metrics(long, path, run)
    return report.read_runs(spark, path).select("run_id", "model", "fold", "metric", r6("value").alias("value"))


def param_grid(spark, d):
    grid = models.param_grid(table(spark, d, "embeddings"), F.max(F.size("embedding")))
    return grid.withColumn("reg_param", F.round("reg_param", 12)).withColumn(
        "reg_param_by_n", F.round("reg_param_by_n", 12)
    )


# --- outliers


def _priced(spark, d):
    return table(spark, d, "lineitem").withColumns(
        {
            "unit_price": F.col("l_extendedprice") / F.greatest("l_quantity", F.lit(1)),
            "charge": F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")),
        }
    )


def iforest_scores(spark, d):
    li = _priced(spark, d)
    scored = anomaly.score_forests(li, anomaly.fit_forests(li, OUTLIER_GROUPS, key=KEYS))
    return scored.withColumns({f"score_{g}": r6(f"score_{g}") for g in OUTLIER_GROUPS})


def anomaly_rows(spark, d):
    one = {"numbers": OUTLIER_GROUPS["numbers"]}
    flagged = anomaly.flag_outliers(_priced(spark, d), one, key=KEYS, contamination=0.001)
    return flagged.where(F.col("anomaly_numbers") == -1)


def multi_group_outliers(spark, d):
    return anomaly.drop_outliers(_priced(spark, d), OUTLIER_GROUPS, key=KEYS, contamination=0.001)


# --- selection and models (iterative fits: no SQL form)


ORDER_FEATURES = ["is_final", "o_totalprice", "o_custkey", "priority"]


def _orders(spark, d, *, flipped: bool) -> DataFrame:
    """Orders with a label that one feature decides, or all but each tenth row's.

    So the right predictor, every importance and every fold score are known, and SQL can say them.
    """
    final = (F.col("o_orderstatus") == "F").cast("int")
    label = final.bitwiseXOR((F.col("o_orderkey") % 10 == 0).cast("int")) if flipped else final
    flat = table(spark, d, "orders").select(
        "o_orderkey",
        label.cast("int").alias("label"),
        final.cast("double").alias("is_final"),
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.col("o_custkey").cast("double").alias("o_custkey"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
    )
    return features.assemble(flat, ORDER_FEATURES).select("o_orderkey", "label", "features")


def _order_folds(spark, d, *, flipped: bool, seed: int, fold: str) -> DataFrame:
    folds = rows.stratified_folds(
        _orders(spark, d, flipped=flipped), label="label", key=["o_orderkey"], k=presets.FOLDS, seed=seed, into=fold
    )
    return materialise(folds, "orders", partition_by=[fold])


def tree_importance(spark, d):
    return selection.tree_importance(_orders(spark, d, flipped=False), ORDER_FEATURES)


def rfecv_curve(spark, d):
    """Every number of features, five folds, trees as deep as Spark grows them."""
    design = _order_folds(spark, d, flipped=False, seed=presets.SELECTION_SEED, fold="selection_fold")
    return selection.curve_table(design, selection.elimination_curve(design, len(ORDER_FEATURES)))


def rfecv_support(spark, d):
    design = _order_folds(spark, d, flipped=False, seed=presets.SELECTION_SEED, fold="selection_fold")
    return selection.support_table(design, selection.rfecv(design, ORDER_FEATURES))


def _fit(spark, d, spec):
    """Every row predicted by the model of the folds it is not in; first candidate of the grid."""
    design = _order_folds(spark, d, flipped=True, seed=presets.CV_SEED, fold="fold")

    def held_out(f):
        parts = tuning.make_parts(*rows.train_test(design, f), [spec])
        return tuning.fit_predict(parts, spec, spec.candidates[0], width=len(ORDER_FEATURES))[0]

    answered = [
        p.select("o_orderkey", "label", F.col("prediction").cast("int").alias("prediction"), "fold")
        for p in tuning.run_all(spark, [lambda f=f: held_out(f) for f in range(presets.FOLDS)], 4)
    ]
    return reduce(DataFrame.unionByName, answered)


def fit_logistic(spark, d):
    return _fit(spark, d, models.logistic())


def fit_forest(spark, d):
    return _fit(spark, d, models.forest())


def fit_mlp(spark, d):
    """The same; the five fits are side by side on one store of the rows."""
    design, spec = _order_folds(spark, d, flipped=True, seed=presets.CV_SEED, fold="fold"), models.perceptron()
    found = tuning.fit_predict_folds(design, spec, spec.candidates[0], width=len(ORDER_FEATURES), k=presets.FOLDS)
    return found.select("o_orderkey", "label", F.col("prediction").cast("int").alias("prediction"), "fold")


def grid_search(spark, d):
    """All candidates of all three grids over five folds. The time of a fit is not part of the result."""
    design = _order_folds(spark, d, flipped=True, seed=presets.CV_SEED, fold="inner_fold")
    found = tuning.grid_search(
        design, models.default_models(), width=len(ORDER_FEATURES), k=presets.FOLDS, parallelism=4
    )
    searched = small_table(spark, [row for search in found for row in search.rows()], tuning.SEARCH_COLUMNS)
    return searched.withColumn("avg_accuracy", r6("avg_accuracy")).drop("fit_seconds")


def nested_cv(spark, d):
    """The whole job: full grids, five outer and five inner folds, with a journal. Time is not part of the result."""
    folded = rows.stratified_folds(
        _orders(spark, d, flipped=True),
        label="label",
        key=["o_orderkey"],
        k=presets.FOLDS,
        seed=presets.CV_SEED,
        rank="fold_rank",
    )
    design = materialise(folded, "orders", partition_by=["fold"])
    journal = Journal(spark, f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/journal-{uuid.uuid4().hex}")
    done = tuning.nested_cv(
        design,
        models.default_models(),
        width=len(ORDER_FEATURES),
        key=["o_orderkey"],
        parallelism=4,
        rank="fold_rank",
        journal=journal,
    )
    # Scores of equal predictions differ between models; what decides the labels does not.
    return done.metrics.where("metric not in ('fit_seconds', 'auc_score')").withColumn("value", r6("value"))


def flagship(spark, d):
    """Label, time features, folds, a logistic fit, and its metrics on the held-out fold."""
    events = recode(table(spark, d, "events"), "event_type", EVENT_LABELS, into="label")
    timed = events.select(
        "event_id", "label", "value", *cyclic_time(F.col("ts")), weekend_flag(F.col("ts")).alias("weekend")
    )
    inputs = [c for c in timed.columns if c not in ("event_id", "label")]
    design = features.assemble(timed, inputs).select("event_id", "label", "features")
    folded = materialise(rows.stratified_folds(design, label="label", key=["event_id"]), "flagship")
    parts = tuning.make_parts(*rows.train_test(folded, 0), [models.logistic()])
    predictions, _ = tuning.fit_predict(parts, models.logistic(), {"C": 20}, width=len(inputs))
    matrix = M.confusion_matrix(predictions).withColumn("model", F.lit("LogisticRegression"))
    wide = M.binary_metrics(matrix, cells=True)
    rate = lambda a, b: F.col(a) / (F.col(a) + F.col(b))
    return wide.withColumn("auc_hard", (rate("tp", "fn") + rate("tn", "fp")) / 2)


def catalogue() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "scan_flows": scan_flows,
        "stack_sources": stack,
        "scan_csv_sources": scan_csv_sources,
        "scan_csv_mixed": scan_csv_mixed,
        "scan_row_id": scan_row_id,
        "row_id": row_id,
        "frame_shape": frame_shape,
        "recode_label": recode_label,
        "drop_columns": drop_columns,
        "select_features": select_features,
        "normalise_names": messy_names,
        "parse_time": parse_time_query,
        "time_parts": time_parts,
        "cyclic_time": cyclic,
        "weekend_flag": weekend,
        "prefix_flags": prefixes,
        "assemble_features": assemble,
        "scale_std": scale_std,
        "scale_centred": scale_centred,
        "scale_vector": scale_vector,
        "drop_negative": drop_negative,
        "exclude_ids": exclude_ids,
        "quantile_cut": quantile_cut,
        "constant_columns": constants,
        "corr_matrix": corr_matrix,
        "corr_gaps": corr_gaps,
        "corr_with_label": corr_with_label,
        "corr_prune": corr_prune,
        "stratified_folds": folds,
        "fold_balance": fold_balance,
        "train_test_fold": train_test_fold,
        "confusion_matrix": confusion,
        "binary_metrics": binary_metrics,
        "auc_hard": auc_hard,
        "auc_score": auc_score,
        "fold_report": fold_report,
        "report_append": report_append,
        "param_grid": param_grid,
        "iforest_scores": iforest_scores,
        "anomaly_rows": anomaly_rows,
        "multi_group_outliers": multi_group_outliers,
        "tree_importance": tree_importance,
        "rfecv_curve": rfecv_curve,
        "rfecv_support": rfecv_support,
        "fit_logistic": fit_logistic,
        "fit_forest": fit_forest,
        "fit_mlp": fit_mlp,
        "grid_search": grid_search,
        "nested_cv": nested_cv,
    }
