import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsieve.operators import metrics as M
from flowsieve.operators import report


def pairs(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int")


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=40))
def test_against_plain_counting(spark, rows):
    matrix = M.confusion_matrix(pairs(spark, rows))
    c = matrix.first()
    y, p = np.array(rows).T
    assert (c.tn, c.fp, c.fn, c.tp) == tuple(int(((y == a) & (p == b)).sum()) for a in (0, 1) for b in (0, 1))
    m = M.binary_metrics(matrix).first()
    assert np.isclose(m.accuracy, (y == p).mean())
    assert np.isclose(m.precision, y[p == 1].mean() if (p == 1).any() else 0)
    assert np.isclose(m.recall, p[y == 1].mean() if (y == 1).any() else 0)
    if len(set(y)) == 2:
        assert np.isclose(M.auc_hard(matrix).first()[0], (p[y == 1].mean() + 1 - p[y == 0].mean()) / 2)


def test_hard_auc_equals_the_evaluator(spark):
    df = pairs(spark, [(0, 0), (0, 1), (0, 0), (1, 1), (1, 0), (1, 1), (1, 1)])
    as_score = df.selectExpr("label", "cast(prediction as double) as prediction")
    assert np.isclose(M.auc_hard(M.confusion_matrix(df)).first()[0], M.auc_score(as_score, raw="prediction"))


def test_undefined_ratios_are_zero_and_auc_fails(spark):
    silent = M.confusion_matrix(pairs(spark, [(1, 0), (0, 0)]))
    m = M.binary_metrics(silent).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 0.5)
    with pytest.raises(Exception, match="both classes"):
        M.auc_hard(M.confusion_matrix(pairs(spark, [(1, 0), (1, 1)]))).collect()


def test_other_values_are_refused(spark):
    with pytest.raises(Exception, match="must be 0 or 1"):
        M.confusion_matrix(pairs(spark, [(1, 2)])).collect()
    with pytest.raises(Exception, match="must be 0 or 1"):
        M.confusion_matrix(pairs(spark, [(None, 1)])).collect()


def test_report(spark, tmp_path):
    values = [("m", f, "accuracy", 0.5 + f / 10) for f in (2, 0, 1)]
    metrics = spark.createDataFrame(values, "model string, fold int, metric string, value double")
    row = report.fold_report(metrics).first()
    assert row.per_fold == [0.5, 0.6, 0.7] and np.isclose(row["mean"], 0.6)
    for _ in range(2):
        assert report.append_metrics(metrics, str(tmp_path / "m"))
    stored = report.read_runs(spark, str(tmp_path / "m"))
    assert stored.count() == 6 and stored.select("run_id").distinct().count() == 2
    matrix = spark.createDataFrame([("m", 0, 4, 1, 2, 3)], "model string, fold int, tn long, fp long, fn long, tp long")
    best = spark.createDataFrame([("m", 0, "{'C': 20}")], "model string, fold int, params string")
    text = report.render_text(report.fold_report(metrics), matrix, best)
    assert "accuracy mean: 0.600000000" in text and "[[4, 1], [2, 3]]" in text and "{'C': 20}" in text
    for _ in range(2):
        report.append_text(metrics, text, str(tmp_path / "t"))
    lines = [r.value for r in report.read_runs(spark, str(tmp_path / "t"), "text").collect()]
    assert lines.count("m") == 2


def test_append_is_idempotent(spark, tmp_path):
    """A repeated run adds nothing, a lost attempt is not read, and attempts side by side count once."""
    path, rows = str(tmp_path / "r"), spark.range(3).withColumn("model", F.lit("m"))
    with pytest.raises(ValueError, match="no run"):
        report.read_runs(spark, path)
    assert report.append_once(rows, path, "one") and not report.append_once(rows, path, "one")
    rows.write.parquet(f"{path}/two~lost")  # written, and lost before it was marked
    assert sorted(r.run_id for r in report.read_runs(spark, path).collect()) == ["one"] * 3
    assert report.append_once(rows, path, "two", partition_by=("model",))
    plain, racing = report._marked, []

    def late(*a):  # another attempt is marked between the look and the mark
        if not racing:
            racing.append(1)
            report.append_once(rows, path, "three")
            return {}
        return plain(*a)

    report._marked, won = late, None
    try:
        won = report.append_once(rows, path, "three")
    finally:
        report._marked = plain
    assert won in (True, False)
    counts = {r["run_id"]: r["count"] for r in report.read_runs(spark, path).groupBy("run_id").count().collect()}
    assert counts == {"one": 3, "two": 3, "three": 3}
    with pytest.raises(ValueError, match="no name"):
        report.append_once(rows, path, "a/b")


def brute_auc(pairs_):
    pos, neg = [s for y, s in pairs_ if y], [s for y, s in pairs_ if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("distinct", [1, 3, 1000])
def test_exact_auc(spark, distinct):
    rng = np.random.default_rng(distinct)
    values = [(int(rng.integers(2)), float(rng.integers(distinct)) / 7) for _ in range(400)]
    df = spark.createDataFrame(values + [(1, -0.0), (0, 0.0)], "label int, score double").repartition(7)
    row = M.exact_auc(df).first()
    assert abs(row.auc - brute_auc(values + [(1, 0.0), (0, 0.0)])) < 1e-12
    assert (row.n_pos, row.n_neg) == (sum(y for y, _ in values) + 1, sum(1 - y for y, _ in values) + 1)
    with pytest.raises(ValueError, match="both classes"):
        M.exact_auc(df.where("label = 1"))
    for hole in ("cast(null as double)", "double('nan')"):
        with pytest.raises(Exception, match="must not be missing"):
            M.exact_auc(df.selectExpr("label", f"if(score > 0, score, {hole}) as score"))
