"""From flow files to evaluated detectors.

Four tables are written on the way, each because several later passes read it: the prepared
rows, the outlier scores, the selection design, and the fold-partitioned design.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve import presets
from flowsieve.functions.labels import recode
from flowsieve.functions.names import normalise
from flowsieve.functions.network import prefix_flags
from flowsieve.functions.times import cyclic_time, parse_time, weekend_flag
from flowsieve.operators import anomaly, profile, report, rows, selection, tuning
from flowsieve.operators.features import assemble
from flowsieve.operators.journal import Journal
from flowsieve.operators.models import ModelSpec, default_models
from flowsieve.session import materialise, materialised, small_table
from flowsieve.sources.flows import scan_flows


@dataclass
class DetectorConfig:
    """Every choice of a run; the defaults are those of the fixed values.

    ``outliers``: ``forest`` fits the detectors, ``recorded`` deletes the listed row ids (of
    the original three files in their order). ``correlated``: ``recorded`` drops the listed columns, ``measured`` applies the rule.
    ``features``: ``eliminate`` runs recursive elimination, ``recorded`` keeps the listed
    survivors, ``all`` keeps everything. ``select_inside_fold`` repeats outlier removal,
    pruning and elimination on each outer training part alone, so that held-out rows
    influence none of them and are all scored. ``journal`` is a folder for the finished fits of this very job, which
    is resumed from there.
    """

    sources: dict[str, str]
    unmapped: str = "error"
    trim_labels: bool = False
    strict_time: bool = True
    lenient_numbers: bool = False
    outlier_groups: dict[str, list[str]] = field(default_factory=lambda: dict(presets.OUTLIER_GROUPS))
    outliers: str = "forest"
    contamination: float = presets.CONTAMINATION
    forest_trees: int = presets.FOREST_TREES
    correlated: str = "recorded"
    threshold: float = presets.CORRELATION_THRESHOLD
    features: str = "eliminate"
    select_inside_fold: bool = False
    step: float = 1
    tree_depth: int = 30
    k_select: int = presets.FOLDS
    k_outer: int = presets.FOLDS
    k_inner: int = presets.FOLDS
    models: list[ModelSpec] = field(default_factory=default_models)
    centre: bool = False
    parallelism: int = 4
    journal: str | None = None


ROW_ID = "row_id"
RANK = "fold_rank"
INTERNAL = (ROW_ID, "label")


def normal(names) -> list[str]:
    return [normalise(n) for n in names]


def derive(df: DataFrame, *, strict_time: bool = True) -> DataFrame:
    """Add the time and subnet columns and drop the raw ones. The time is parsed once."""
    ts = F.col("_ts")
    timed = df.withColumn("_ts", parse_time(F.col("timestamp"), strict=strict_time))
    wide = timed.select(
        "*",
        *cyclic_time(ts),
        weekend_flag(ts).alias("weekend"),
        *prefix_flags(F.col("dst_ip"), presets.DST_PREFIXES),
        *prefix_flags(F.col("src_ip"), presets.SRC_PREFIXES),
    )
    return wide.drop("_ts", *normal(presets.DROP_RAW))


def prepare(spark: SparkSession, cfg: DetectorConfig) -> DataFrame:
    """Read, stack, recode, derive; one written table with contiguous row ids. The raw text
    is scanned once, and only columns that survive are parsed."""
    raw = scan_flows(spark, cfg.sources, lenient=cfg.lenient_numbers)
    coded = recode(raw, "label", presets.LABEL_MAP, unmapped=cfg.unmapped, trim=cfg.trim_labels)
    slim = rows.drop_columns(coded, normal(presets.DROP_CONSTANT))
    stored = materialise(derive(slim, strict_time=cfg.strict_time), "prepared")
    return rows.scan_order_id(stored, order=["_source"], into=ROW_ID).drop("_source")


def clean(df: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Remove negative durations and outliers, then redundant columns."""
    valid = rows.drop_negative(df, "flow_duration")
    if cfg.outliers == "recorded":
        ids = [(i,) for group in presets.RECORDED_OUTLIERS.values() for i in group]
        kept = rows.exclude_ids(valid, small_table(df.sparkSession, ids, f"{ROW_ID} long"), ROW_ID)
    else:
        groups = {g: normal(cols) for g, cols in cfg.outlier_groups.items()}
        kept = anomaly.drop_outliers(
            valid, groups, key=[ROW_ID], contamination=cfg.contamination, trees=cfg.forest_trees
        )
    if cfg.correlated == "recorded":
        return rows.drop_columns(kept, normal(presets.DROP_CORRELATED))
    varied = profile.drop_constant(kept, keep=INTERNAL)
    columns = [c for c in varied.columns if c not in INTERNAL]
    return varied.drop(*profile.corr_prune(varied, columns, "label", threshold=cfg.threshold))


def _design(df: DataFrame, names: list[str]) -> DataFrame:
    return assemble(df, names).select(ROW_ID, "label", "features")


def _narrow(df: DataFrame, indices: list[int]) -> DataFrame:
    sliced = VectorSlicer(inputCol="features", outputCol="_kept", indices=indices).transform(df)
    return sliced.drop("features").withColumnRenamed("_kept", "features")


def _eliminate(design: DataFrame, names: list[str], cfg: DetectorConfig) -> selection.Elimination:
    folds = rows.stratified_folds(
        design, label="label", key=[ROW_ID], k=cfg.k_select, seed=presets.SELECTION_SEED, into="selection_fold"
    )
    with materialised(folds, "selection", partition_by=["selection_fold"]) as folded:
        return selection.rfecv(
            folded, names, k=cfg.k_select, step=cfg.step, max_depth=cfg.tree_depth
        )


@dataclass
class DetectorResult:
    """Column counts per stage (label included), the kept features and the evaluation.

    With selection inside folds there is no common feature list: ``selected`` is empty.
    """

    widths: dict[str, int]
    selected: list[str]
    elimination: selection.Elimination | None
    evaluation: tuning.NestedResult


def _candidates(cleaned: DataFrame, cfg: DetectorConfig) -> list[str]:
    if cfg.features == "recorded":
        return normal(presets.FINAL_FEATURES)
    return [c for c in cleaned.columns if c not in INTERNAL]


def _folded(df: DataFrame, cfg: DetectorConfig) -> DataFrame:
    folds = rows.stratified_folds(
        df, label="label", key=[ROW_ID], k=cfg.k_outer, seed=presets.CV_SEED, rank=RANK
    )
    return materialise(folds, "design", partition_by=["fold"])


def _evaluate(folded: DataFrame, cfg: DetectorConfig, width: int, prepare=None) -> tuning.NestedResult:
    return tuning.nested_cv(
        folded,
        cfg.models,
        width=width,
        key=[ROW_ID],
        k_outer=cfg.k_outer,
        k_inner=cfg.k_inner,
        centre=cfg.centre,
        parallelism=cfg.parallelism,
        prepare=prepare,
        rank=RANK,
        journal=Journal(folded.sparkSession, cfg.journal) if cfg.journal else None,
    )


def _select_before(prepared: DataFrame, cfg: DetectorConfig) -> DetectorResult:
    """Clean and select on all rows, then evaluate."""
    cleaned = clean(prepared, cfg)
    names = _candidates(cleaned, cfg)
    design, found = _design(cleaned, names), None
    if cfg.features == "eliminate":
        found = _eliminate(design, names, cfg)
        design = _narrow(design, found.selected)
        names = [names[i] for i in found.selected]
    widths = {"cleaned": len(cleaned.columns) - 1, "selected": len(names) + 1}
    return DetectorResult(widths, names, found, _evaluate(_folded(design, cfg), cfg, len(names)))


def _select_inside(prepared: DataFrame, cfg: DetectorConfig) -> DetectorResult:
    """Deal out the folds first, then clean and select on each training part."""

    def prepare_fold(train, test):
        kept = clean(train.drop("fold", RANK), cfg)
        names = _candidates(kept, cfg)
        train, test = _design(kept, names), _design(test, names)
        if cfg.features == "eliminate":
            chosen = _eliminate(train, names, cfg).selected
            return _narrow(train, chosen), _narrow(test, chosen), len(chosen)
        return train, test, len(names)

    folded = _folded(rows.drop_negative(prepared, "flow_duration"), cfg)
    return DetectorResult({}, [], None, _evaluate(folded, cfg, 0, prepare_fold))


def run(
    spark: SparkSession, cfg: DetectorConfig, output: str | None = None, run_id: str | None = None
) -> DetectorResult:
    """The whole way; with ``output``, appends the metrics tables and a text report there, once per ``run_id``."""
    prepared = prepare(spark, cfg)
    result = (_select_inside if cfg.select_inside_fold else _select_before)(prepared, cfg)
    result.widths["prepared"] = len(prepared.columns) - 1
    if output:
        write_report(result.evaluation, output, run_id or uuid.uuid4().hex)
    return result


def write_report(evaluation: tuning.NestedResult, output: str, run_id: str) -> None:
    report.append_metrics(evaluation.metrics, f"{output}/fold_metrics", run_id)
    report.append_metrics(evaluation.searches, f"{output}/searches", run_id)
    summary = report.fold_report(evaluation.metrics)
    text = report.render_text(summary, evaluation.confusions, evaluation.best)
    report.append_text(evaluation.metrics, text, f"{output}/report_text", run_id)
