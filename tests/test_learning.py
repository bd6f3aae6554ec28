import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowsieve.operators import models, rows, selection, tuning, votes
from flowsieve.operators.journal import Journal

NAMES = ["copy", "flat", "noise_a", "noise_b"]


@pytest.fixture(scope="module")
def design(spark):
    noise = lambda i: (F.xxhash64("id", F.lit(i)) % 1000) / 1000.0
    df = spark.range(600).select(
        F.col("id").alias("key"),
        (noise(0) > 0.2).cast("int").alias("label"),
        noise(1).alias("noise_a"),
        noise(2).alias("noise_b"),
    )
    vectors = df.select(
        "key",
        "label",
        array_to_vector(F.array(F.col("label").cast("double"), F.lit(1.0), "noise_a", "noise_b")).alias("features"),
    )
    folded = rows.stratified_folds(vectors, label="label", key=["key"], k=3, seed=3, into="selection_fold")
    return rows.stratified_folds(folded, label="label", key=["key"], k=3).cache()


def test_importance_goes_to_the_copy(design):
    got = {r.feature: r.importance for r in selection.tree_importance(design, NAMES).collect()}
    assert got["copy"] == 1.0 and got["flat"] == 0.0


def test_elimination_keeps_the_copy(design):
    found = selection.rfecv(design, NAMES, k=3, max_depth=3)
    assert found.sizes == [4, 3, 2, 1]
    assert all(len(s) == 3 for s in found.scores.values())
    assert found.scores[1] == [1.0, 1.0, 1.0]
    assert found.best_size == 1  # every size is perfect, the smallest wins
    assert [NAMES[i] for i in found.selected] == ["copy"]
    assert sorted(found.rank) == [1, 2, 3, 4]
    table = {r.feature: (r["rank"], r.selected) for r in selection.support_table(design, found).collect()}
    assert table["copy"] == (1, 1) and table["noise_b"][1] == 0
    curve = selection.curve_table(design, found.scores).collect()
    assert {r.n_features: r.mean_accuracy for r in curve}[1] == 1.0


def test_elimination_rules():
    assert selection.weakest([0.5, 0.0, 0.0], [4, 7, 9], 1) == [9]
    assert selection.weakest([0.1, 0.3, 0.2], [4, 7, 9], 2) == [4, 9]
    assert selection.step_size(0.2, 64) == 12 and selection.step_size(0.01, 5) == 1 and selection.step_size(2, 5) == 2
    assert selection.level_sizes(10, 4, 1) == [10, 6, 2, 1]
    assert selection.best_size({3: [0.5], 2: [0.7], 1: [0.7]}) == 1


def test_grid_search_and_ties(design):
    spec = models.logistic([20, 50], max_iter=10)
    found = tuning.grid_search(design, [spec], width=4, fold="fold", k=3, parallelism=3)[0]
    assert found.mean_scores == [1.0, 1.0] and found.best == 0
    assert [r[-1] for r in found.rows()] == [1, 0]
    assert all(s > 0 for per_fold in found.seconds for s in per_fold)


def test_nested_cv_with_all_three_models(design):
    specs = [models.logistic([20], max_iter=10), models.forest([5]), models.perceptron([(3,)], max_iter=25)]
    done = tuning.nested_cv(design, specs, width=4, key=["key"], k_outer=2, k_inner=2, parallelism=4)
    matrix = done.confusions.collect()
    assert len(matrix) == 6
    for name in ("LogisticRegression", "RF_Classifier", "MLPClassifier"):
        assert sum(r.tn + r.fp + r.fn + r.tp for r in matrix if r.model == name) == 400
    accuracy = done.metrics.where("metric = 'accuracy'").agg(F.min("value")).first()[0]
    assert accuracy > 0.9
    assert {r.metric for r in done.metrics.select("metric").distinct().collect()} == {
        "accuracy", "precision", "recall", "f1", "auc_hard", "auc_score", "fit_seconds"
    }
    assert done.searches.count() == 6 and done.best.count() == 6


def test_parameters_carry_over():
    assert models.reg_param(20) == 0.05 and models.reg_param(20, 100) == 0.0005
    assert models.layer_sizes(27, (50, 50)) == [27, 50, 50, 2]


def test_default_estimators(spark):
    lr, rf, mlp = models.default_models()
    built = lr.build({"C": 40}, 27, 1000)
    assert (built.getRegParam(), built.getMaxIter(), built.getElasticNetParam()) == (0.025, 100, 0.0)
    built = rf.build({"n_estimators": 200}, 27, 1000)
    assert (built.getNumTrees(), built.getFeatureSubsetStrategy()) == (200, "sqrt")
    assert mlp.build({"hidden_layer_sizes": (100,)}, 27, 1000).getLayers() == [27, 100, 2]
    assert models.logistic(scale_by_n=True).build({"C": 40}, 27, 1000).getRegParam() == 1 / 40000


def flaky(spec, counts, limit):
    """``spec`` whose fits are counted and fail from ``limit`` on."""

    def build(*args):
        counts.append(args[0])
        if len(counts) > limit:
            raise RuntimeError("killed")
        return spec.build(*args)

    return models.ModelSpec(spec.name, spec.scaled, spec.candidates, build, spec.trees_of)


def test_a_killed_search_goes_on_where_it_stopped(spark, design, tmp_path):
    """The second run fits only what the first did not finish, and finds what an undisturbed one finds."""
    plain = [models.logistic([20, 50], max_iter=5), models.forest([4, 2], max_depth=3)]
    journal = Journal(spark, str(tmp_path / "journal"))
    search = lambda specs, j: tuning.grid_search(design, specs, width=4, fold="fold", k=3, journal=j, outer=7)
    first, second = [], []
    with pytest.raises(RuntimeError, match="killed"):
        search([flaky(s, first, 7) for s in plain], journal)
    found = search([flaky(s, second, 99) for s in plain], journal)
    assert len(first) in (8, 9) and len(second) == 9 - 6  # three fits a fold: two candidates and one forest for both
    whole = search(plain, None)
    assert [f.scores for f in found] == [w.scores for w in whole]
    again = []
    assert [f.scores for f in search([flaky(s, again, 0) for s in plain], journal)] == [w.scores for w in whole]
    assert again == []
    # other rows than those that an entry was fitted on: it does not count
    fewer = design.where("key % 4 > 0")
    tuning.grid_search(fewer, [flaky(plain[0], again, 99)], width=4, fold="fold", k=3, journal=journal, outer=7)
    assert len(again) == 6


def test_a_killed_nested_search_refits_nothing_twice(spark, design, tmp_path):
    spec, runs = models.logistic([20, 50], max_iter=5), []
    for limit in (8, 99, 0):
        counts = []
        nested = lambda: tuning.nested_cv(
            design, [flaky(spec, counts, limit)], width=4, key=["key"], k_outer=2, k_inner=2, journal=Journal(spark, str(tmp_path))
        )
        if limit == 8:
            with pytest.raises(RuntimeError, match="killed"):
                nested()
        else:
            runs.append(sorted(map(tuple, nested().confusions.collect())))
            assert len(counts) == (0 if limit == 0 else 10 - 7)
    assert runs[0] == runs[1]


def test_first_trees_answer_for_smaller_forests(spark, design):
    """Votes from the leaf table against walking each tree, and against Spark's own prediction of all trees."""
    noisy = design.withColumn("label", F.when(F.xxhash64("key") % 5 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    model = models.forest([9], max_depth=4).build({"n_estimators": 9}, 4, 600).fit(noisy)
    found = votes.prefix_predictions(noisy, model, [9, 4, 1], ["all", "four", "one"])
    whole = model.transform(noisy).select("key", "prediction")
    assert found.join(whole, "key").where("all <> prediction").count() == 0
    shown = [t.toDebugString for t in model.trees]
    assert len(shown) == 9
    walked = noisy.select("key", "features").collect()
    by_key = {r["key"]: r for r in found.collect()}
    for r in walked[:80]:
        shares = []
        for tree in model.trees:
            p = tree.predictProbability(r["features"])
            shares.append(p[1])
        for name, n in (("one", 1), ("four", 4), ("all", 9)):
            ones = sum(shares[:n])
            zeros = sum(1 - s for s in shares[:n])
            assert abs(ones - zeros) < 1e-9 or by_key[r["key"]][name] == float(ones > zeros)
    assert found.where("one <> all").count() > 0


def test_one_scoring_job_a_fold(spark, design, monkeypatch):
    """All candidates of all models are counted in one aggregate per fold."""
    calls, plain = [], tuning._count
    monkeypatch.setattr(tuning, "_count", lambda *a: calls.append(sum(len(f.candidates) for f in a[1])) or plain(*a))
    specs = [models.logistic([20, 50], max_iter=5), models.forest([4, 2], max_depth=3), models.perceptron([(3,)], max_iter=5)]
    found = tuning.grid_search(design, specs, width=4, fold="fold", k=3, parallelism=3)
    assert calls == [5, 5, 5] and [len(f.candidates) for f in found] == [2, 2, 1]
