import pytest
from pyspark.sql import functions as F

from flow_fixture import PLANTED, flow_frame
from flowsieve.functions.names import normalise
from flowsieve.operators import models, report
from flowsieve.plans import detector


@pytest.fixture(scope="module")
def cfg(flow_files):
    return detector.DetectorConfig(
        sources=flow_files,
        contamination=0.0025,
        step=0.25,
        tree_depth=4,
        k_select=2,
        k_outer=2,
        k_inner=2,
        models=[models.logistic([20], max_iter=15), models.forest([5], max_depth=4)],
    )


@pytest.fixture(scope="module")
def prepared(spark, cfg):
    return detector.prepare(spark, cfg)


def test_preparation(prepared):
    assert len(prepared.columns) - 1 == 82
    assert prepared.count() == 2000
    ids = prepared.agg(F.min("row_id"), F.max("row_id"), F.countDistinct("row_id")).first()
    assert tuple(ids) == (0, 1999, 2000)
    frame = flow_frame()
    row = prepared.where("row_id = 1234").first()
    source = frame.iloc[1234]
    assert row.label == int(source["Label"] != "Normal")
    assert row.dst_192_168_3_ == int(source["Dst IP"].startswith("192.168.3."))
    assert row.flow_duration == pytest.approx(source["Flow Duration"])


def test_cleaning_drops_extremes_and_recorded_columns(prepared, cfg):
    cleaned = detector.clean(prepared, cfg)
    assert len(cleaned.columns) - 1 == 61
    frame = flow_frame()
    extreme = [int(f.split("-")[1]) for f in frame.attrs["extreme"]]
    assert cleaned.where(F.col("row_id").isin(extreme)).count() == 0
    assert 2000 - 4 * 5 <= cleaned.count() <= 1995


def test_recorded_outliers_are_deleted_by_id(prepared, cfg, monkeypatch):
    from dataclasses import replace

    from flowsieve import presets

    assert [len(g) for g in presets.RECORDED_OUTLIERS.values()] == [34, 33, 15, 25]
    monkeypatch.setattr(presets, "RECORDED_OUTLIERS", {"group_1": [3, 5], "group_2": [5, 10**6]})
    cleaned = detector.clean(prepared, replace(cfg, outliers="recorded"))
    assert cleaned.count() == 1998 and cleaned.where("row_id in (3, 5)").count() == 0


def test_measured_pruning_drops_one_of_each_twin(prepared, cfg):
    from dataclasses import replace

    from flow_fixture import TWINS

    cleaned = detector.clean(prepared, replace(cfg, correlated="measured"))
    for copy, original in TWINS.items():
        assert (normalise(copy) in cleaned.columns) + (normalise(original) in cleaned.columns) == 1


def test_whole_run(spark, cfg, tmp_path):
    result = detector.run(spark, cfg, str(tmp_path / "out"))
    assert result.widths["prepared"] == 82 and result.widths["cleaned"] == 61
    assert set(result.selected) & {normalise(p) for p in PLANTED}
    scores = result.evaluation.metrics.where("metric = 'accuracy'").groupBy("model").agg(F.avg("value").alias("a"))
    assert all(r.a > 0.85 for r in scores.collect())
    stored = report.read_runs(spark, str(tmp_path / "out" / "fold_metrics"))
    assert stored.where("metric = 'recall'").count() == 4
    text = "\n".join(r.value for r in report.read_runs(spark, str(tmp_path / "out" / "report_text"), "text").collect())
    assert "LogisticRegression" in text and "Confusion matrices" in text


def test_recorded_features_need_no_elimination(spark, cfg):
    from dataclasses import replace

    one = replace(cfg, features="recorded", outliers="recorded", centre=True, models=cfg.models[:1], k_outer=2)
    result = detector.run(spark, one)
    assert result.widths["selected"] == 28 and result.elimination is None


def test_selection_inside_folds(spark, cfg):
    from dataclasses import replace

    one = replace(cfg, select_inside_fold=True, models=cfg.models[:1], k_outer=2, k_select=2, step=0.5)
    result = detector.run(spark, one)
    assert result.evaluation.confusions.count() == 2 and result.elimination is None
    total = result.evaluation.confusions.agg(F.sum(F.expr("tn + fp + fn + tp"))).first()[0]
    assert total == 2000  # held-out rows are never removed
    assert result.evaluation.metrics.where("metric = 'accuracy'").agg(F.min("value")).first()[0] > 0.8
