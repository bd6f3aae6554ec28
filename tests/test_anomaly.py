import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import anomaly

GROUPS = {"first": ["a", "b", "c"], "second": ["c", "d", "e"]}
EXTREME = [3, 500, 999]


def points(spark, n=3000, partitions=8):
    noise = [((F.xxhash64("id", F.lit(i)) % 100000) / 1000.0).cast("double").alias(c) for i, c in enumerate("abcde")]
    df = spark.range(n, numPartitions=partitions).select("id", *noise)
    return df.select("id", *[F.when(F.col("id").isin(EXTREME), F.lit(1e7) + F.col(c)).otherwise(F.col(c)).alias(c) for c in "abcde"])


def fitted(df, **options):
    return anomaly.fit_forests(df, GROUPS, key=["id"], features=2, **{"trees": 20, **options})


def depth_of(forest, root, x):
    at = root
    while forest.child[at] != at:
        at = forest.child[at] + (x[forest.feature[at]] > forest.threshold[at])
    return forest.depth[at] / anomaly.MILLION


def test_scores_equal_a_walk_down_each_tree(spark):
    df = points(spark)
    forests = fitted(df)
    for row in anomaly.score_forests(df, forests).limit(40).collect():
        for name, forest in forests.items():
            x = [row[c] for c in GROUPS[name]]
            mean = sum(depth_of(forest, r, x) for r in forest.roots) / len(forest.roots)
            assert math.isclose(row[f"score_{name}"], -(2 ** (-mean / anomaly.average_path(256))), rel_tol=1e-12)


def test_every_tree_isolates_its_whole_sample(spark):
    for forest in fitted(points(spark)).values():
        assert len(forest.roots) == 20
        bounds = [*forest.roots[1:], len(forest.child)]
        for low, high in zip(forest.roots, bounds):
            at = np.arange(low, high)
            assert (forest.child[at] >= at).all() and (forest.child[at] < high).all()
            assert len(at) % 2 == 1 and len(at) <= 511
            inner = at[forest.child[at] != at]
            reached = np.concatenate([forest.child[inner], forest.child[inner] + 1])
            assert sorted(reached) == list(range(low + 1, high))


def test_sample_has_exact_size_without_repeats(spark):
    df = points(spark, 60_000).select("id", *"abcde")
    drawn = anomaly._draw(df, list("abcde"), ["id"], 60_000, 20, 256, 1)
    counts = drawn.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(*"abcde").alias("d"))
    assert {(r.tree, r.n, r.d) for r in counts.collect()} == {(t, 256, 256) for t in range(20)}


@pytest.mark.parametrize("bound", [1 << 40, 1 << 57, 1 << 62])
def test_numbers_below_the_bound_equal_a_plain_walk(bound):
    prime, numbers = anomaly.PRIME, anomaly._tree_numbers(1, 7)
    a, b = (np.array([(k * (i + 12345) ** 3) % prime for i in range(3000)], dtype=np.int64) for k in (911, 1013))
    expected = []
    for i in range(len(a)):
        for t, (m, n, o, p) in enumerate(numbers.tolist()):
            u = (((int(a[i]) * m + n) % prime) << anomaly.PRIME_BITS) + (int(b[i]) * o + p) % prime
            if u < bound:
                expected.append((i, t, u))
    assert list(zip(*(found.tolist() for found in anomaly.taking_part(a, b, numbers, bound)))) == expected


def test_a_row_is_digested_once_for_all_trees(spark):
    """Within a function over the trees Spark worked the digest out again for each tree."""
    drawn = anomaly._draw(points(spark, 100).select("id", *"abcde"), list("abcde"), ["id"], 100, 20, 16, 1)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "lambda" not in plan


def test_forest_does_not_depend_on_partitioning(spark):
    one, many = fitted(points(spark, partitions=1)), fitted(points(spark, partitions=8))
    for name in GROUPS:
        assert np.array_equal(one[name].threshold, many[name].threshold)
        assert np.array_equal(one[name].child, many[name].child)


def test_extremes_are_flagged_and_few_others(spark):
    df = points(spark)
    kept = anomaly.drop_outliers(df, GROUPS, key=["id"], contamination=0.001, trees=30, features=3)
    gone = {r.id for r in df.join(kept, "id", "left_anti").select("id").collect()}
    assert set(EXTREME) <= gone
    assert len(gone) <= len(GROUPS) * (int(0.001 * 2999) + 1)
    assert kept.columns == df.columns


def test_ties_at_the_cut_are_kept(spark):
    df = points(spark, 400).select("id", *[F.lit(1.0).alias(c) for c in "abcde"])
    flagged = anomaly.flag_outliers(df, GROUPS, key=["id"], contamination=0.05, trees=5, features=2)
    assert flagged.where("anomaly_first = -1 or anomaly_second = -1").count() == 0


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_unusable_values_are_refused(spark, bad):
    df = points(spark, 100).withColumn("b", F.when(F.col("id") == 5, F.lit(bad)).otherwise(F.col("b")))
    with pytest.raises(ValueError, match="infinity in .*b"):
        fitted(df)


@pytest.mark.parametrize("n", [600, 60_000])
def test_repeated_keys_are_taken_alike_at_any_size(spark, n):
    df = points(spark, n).withColumn("id", F.col("id") % 3)
    one, other = fitted(df), fitted(df.repartition(3))
    assert all((one[g].threshold == other[g].threshold).all() for g in one)


def test_too_many_features_are_refused(spark):
    with pytest.raises(ValueError, match="do not fit"):
        anomaly.fit_forests(points(spark, 50), GROUPS, key=["id"], features=8)


def test_small_table_and_average_path(spark):
    forests = fitted(points(spark, 10), trees=3)
    assert all(len(f.roots) == 3 for f in forests.values())
    assert anomaly.average_path(1) == 0 and anomaly.average_path(2) == 1
    assert math.isclose(anomaly.average_path(256), 10.2448, abs_tol=1e-3)
