import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from flowsieve.llm import mixing as M


def fill(sizes, weights, total, most=M.MOST):
    """Share by weight, round by round: what is above the most is shared again among the others."""
    target = [0.0] * len(sizes)
    free = {k for k, n in enumerate(sizes) if n > 0 and weights[k] > 0}
    left = float(total)
    while free:
        unit = left / sum(weights[k] for k in free)
        full = {k for k in free if weights[k] * unit > most * sizes[k]}
        if not full:
            for k in free:
                target[k] = weights[k] * unit
            break
        for k in full:
            target[k] = most * sizes[k]
            left -= target[k]
        free -= full
    return target


def test_targets_are_filled_by_weight(spark):
    def targets(sizes, weights, share):
        rows = [(f"={k:02d}", n) for k, n in enumerate(sizes)]
        sources = spark.createDataFrame(rows, "key string, source_size bigint").repartition(3)
        return [r["target"] for r in M.fill_targets(sources, tuple(weights), share).orderBy("key").collect()]

    assert targets([100, 100, 100], [5, 2, 1], 4 / 3) == [200, 400 / 3, 200 / 3]
    assert targets([10, 1000], [5, 1], 1.5) == [20, 1495]
    assert targets([10, 0], [5, 2], 1.5) == [15, 0]
    assert targets([10, 10], [5, 2], 3.0) == [20, 20]
    assert targets([], [5], 1.5) == []
    sizes = [3**k % 1009 for k in range(40)]
    expected = fill(sizes, [M.WEIGHTS[k % 3] for k in range(40)], 1.5 * sum(sizes))
    assert targets(sizes, M.WEIGHTS, 1.5) == expected and max(t / n for t, n in zip(expected, sizes)) == 2


def test_span_bounds_the_table_and_not_the_result():
    lengths, counts = np.arange(3, 900, 7), np.full(129, 50)
    for span in (8, 64, 1 << 16):
        taken = M.fit_lengths(lengths, counts, 1_234_567, span)
        spare = lengths[taken < counts].min()
        assert 0 <= 1_234_567 - int((taken * lengths).sum()) < spare


def test_splits_may_change_between_the_steps(spark, monkeypatch, tmp_path):
    """Executors come and go: the numbers of rows must not follow the splits of a scan."""
    docs = spark.range(4000).selectExpr("id % 3 as doc_id", "repeat('w ', cast(id % 2 + 3 as int)) as text", "'s' as source")
    docs.repartition(12).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    plain, calls = M.materialise, []

    def shaken(df, name, *more):
        done = plain(df, name, *more)
        calls.append(name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(1 + 5 * (len(calls) % 3)))
        return done

    monkeypatch.setattr(M, "materialise", shaken)
    try:
        for given in (docs, docs.unionByName(docs.where("false")), docs.repartition(7)):
            for _, target, taken, longest in _check(given, M.mix(given)):
                assert abs(target - taken) < longest
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_knapsack_finds_the_best_sum():
    rng = random.Random(2)
    for _ in range(200):
        k = rng.randrange(1, 5)
        lengths = np.array(sorted(rng.sample(range(0, 30), k)))
        counts = np.array([rng.randrange(0, 4) for _ in range(k)])
        budget = rng.randrange(0, 80)
        taken = M.fit_lengths(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        got = int((taken * lengths).sum())
        sums = {sum(a * b for a, b in zip(c, lengths)) for c in product(*[range(n + 1) for n in counts])}
        best = max(s for s in sums if s <= budget)
        # Even shares come first, so only a sum of what is left is sure; it is never above the budget.
        assert got <= budget and best - got <= max(lengths, default=0)
    big = M.fit_lengths(np.arange(1, 20_000), np.full(19_999, 3), 123_456_789)
    assert int((big * np.arange(1, 20_000)).sum()) == 123_456_789


def _check(df, mixed):
    rows = mixed.collect()
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in rows if r["source"] == s) for s in sources]
    weights = [M.WEIGHTS[k % 3] for k in range(len(sources))]
    targets = fill(sizes, weights, 1.5 * sum(sizes))
    for s, n, t in zip(sources, sizes, targets):
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == n and abs(r["target"] - t) < 1e-6 for r in own)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
        yield s, t, sum(r["taken"] for r in own), max(r["size"] for r in own)


def test_real_table(tables):
    docs = tables("documents")
    mixed = M.mix(docs)
    for _, target, taken, longest in _check(docs, mixed):
        assert abs(target - taken) <= longest
    key = [F.col(c) for c in ("doc_id", "size", "taken")]
    again = M.mix(docs.repartition(5))
    assert sorted(map(tuple, mixed.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))


def test_edge_rows(edge, nothing):
    mixed = M.mix(edge)
    assert mixed.count() == edge.count()
    assert {c.lower() for c in edge.columns} <= {c.lower() for c in mixed.columns}
    list(_check(edge, mixed))
    assert M.mix(nothing).count() == 0


def test_one_length_holds_nearly_all_rows(spark, monkeypatch):
    """Copies of one text: part of them is taken, found in buckets and not by sorting all."""
    monkeypatch.setattr(M, "BUCKET", 16)
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("doc_id"),
        F.lit("a b c d").alias("text"),
        F.when(F.col("id") < 2600, "s").otherwise("t").alias("source"),
    )
    for _, target, taken, longest in _check(docs, M.mix(docs)):
        assert abs(target - taken) <= longest
