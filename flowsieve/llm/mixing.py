"""Mixing sources to target weights by exact sums of document lengths.

Documents are counted by source and exact length. A source's target is met by whole passes over it
and, for what is left, by a number of documents of each length: first each length's even share, then
the longest that still fit, then a bounded knapsack, solved by dynamic programming over the sums that
can be reached. Which documents of a length are taken depends on a seeded digest of each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import fresh, located, row_key, text_of, words
from flowsieve.operators.rows import sorted_row_id
from flowsieve.session import broadcast_if_small, materialise, ship_package

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Sums that the knapsack looks at, and documents per ranked bucket.
SPAN, BUCKET = 1 << 16, 4096


def fill_targets(
    sources: DataFrame, weights: tuple[float, ...], share: float, most: float = MOST
) -> DataFrame:
    """``key``, ``source_size`` and ``target`` of sources given by ``key`` and ``source_size``.

    In the order of their keys they have ``weights`` in turn and share ``share`` times all sizes by weight; what is
    above ``most`` times a size goes to the others by weight. A source of size 0 gets 0. If all are full the rest is
    not shared out. One number is sought, the words a unit of weight gets; each round of the search is one
    aggregate, and there are as many as there are steps in which sources get full.
    """
    ranked = materialise(sorted_row_id(sources, ["key"], into="at"), "sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("at", F.lit(len(weights))).cast("int"))
    size = F.col("source_size")
    able, cap = (size > 0) & (weight > 0), size * F.lit(float(most))
    total = share * (ranked.agg(F.sum(size)).first()[0] or 0)
    unit, full = 0.0, -1
    while True:
        over = able & (weight * F.lit(unit) > cap)
        n, capped, free = ranked.agg(
            F.count_if(over), F.sum(F.when(over, size)), F.sum(F.when(able & ~over, weight))
        ).first()
        if n == full:
            break
        full, unit = n, (total - most * (capped or 0)) / free if free else math.inf
    target = F.when(~able, 0.0).when(weight * F.lit(unit) > cap, cap).otherwise(weight * F.lit(unit))
    return ranked.select("key", "source_size", target.alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, span: int = SPAN) -> np.ndarray:
    """How many of each length to take, at most ``counts``, for the largest sum up to ``budget``.

    The knapsack is exact over what the even shares leave, or over about ``span`` of it after the longest
    documents that fit. Either way the sum is below the budget by less than the shortest length of which
    one is left over.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    whole = int((lengths * counts).sum())
    budget = max(0, min(int(budget), whole))
    if budget == whole:
        return counts.copy()
    taken = np.array([int(c) * budget // whole for c in counts], np.int64)
    left = budget - int((lengths * taken).sum())
    down = np.argsort(-lengths, kind="stable")
    for k in down:
        if left <= span:
            break
        if lengths[k] > 0:
            more = min(int(counts[k] - taken[k]), (left - span // 2) // int(lengths[k]))
            if more > 0:
                taken[k] += more
                left -= more * int(lengths[k])
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    by = np.full(left + 1, -1, np.int64)
    for k in down[::-1]:
        size, spare = int(lengths[k]), int(counts[k] - taken[k])
        if size <= 0 or size > left or spare <= 0:
            continue
        new = np.flatnonzero(reach)
        while spare and len(new):
            new = new[new + size <= left] + size
            new = new[~reach[new]]
            reach[new] = True
            by[new] = k
            spare -= 1
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        taken[by[at]] += 1
        at -= int(lengths[by[at]])
    return taken


PLAN = "key string, size bigint, n bigint, source_size bigint, target double, passes bigint, extra bigint"


def _planned(span: int):
    """``passes`` over each length and ``extra`` documents of it, for one source."""

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        size, n = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
        target, whole = float(frame["target"].iat[0]), int((size * n).sum())
        passes = int(target // whole) if whole else 0
        extra = fit_lengths(size, n, round(target - passes * whole), span)
        return frame.assign(passes=passes, extra=extra)[[c.split()[0] for c in PLAN.split(", ")]]

    return plan


def _rank(key: Column, place: Column, seed: int) -> Column:
    """Order within a length: by a seeded digest; rows with equal keys are spread by place in the table."""
    high = F.xxhash64(F.lit(seed), key).bitwiseAND(F.lit(-(1 << 32)))
    low = F.shiftrightunsigned(F.xxhash64(place), 32)
    return high.bitwiseOR(low)


def _source_key(source: Column) -> Column:
    """Sources as text that joins with itself; null has a key of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def _last_ranks(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """``last``: the rank of the last document taken of each source and length.

    Ranks are dealt to buckets of some thousand; counts tell in which bucket the last one lies, and
    only that bucket is sorted. So a length that very many documents have is never in one task.
    """
    part = plan.where("extra > 0 and extra < n").select(
        "key", "size", "extra", F.ceil(F.log2(F.greatest(F.col("n") / BUCKET, F.lit(1.0)))).cast("int").alias("bits")
    )
    bucket = F.when(F.col("bits") == 0, F.lit(0).cast("bigint")).otherwise(F.expr("shiftright(rank, 64 - bits)"))
    dealt = narrow.join(broadcast_if_small(part), ["key", "size"]).withColumn("bucket", bucket)
    counts = dealt.groupBy("key", "size", "bucket").agg(
        F.count(F.lit(1)).alias("c"), F.first("extra").alias("extra")
    )
    upto = F.sum("c").over(Window.partitionBy("key", "size").orderBy("bucket"))
    cut = (
        counts.withColumn("upto", upto)
        .where("upto >= extra and upto - c < extra")
        .select("key", "size", "bucket", (F.col("extra") - F.col("upto") + F.col("c")).alias("need"))
    )
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("rank"))
    cut = materialise(cut, "cut")
    ranked = dealt.drop("extra", "bits").join(broadcast_if_small(cut), ["key", "size", "bucket"]).withColumn("place", place)
    return ranked.where("place = need").select("key", "size", F.col("rank").alias("last"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    seed: int = 11,
    span: int = SPAN,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` added (replacing namesakes).

    Sources in the order of their code points, null last, get ``weights`` in turn and share ``share``
    times all words; a target is at most twice its source. ``taken`` is size times the copies in the
    mix: 0, 1 or 2. Null texts have size 0, as have texts without words; such rows take 0. Rows of
    equal id and text may differ in ``taken``, as only part of them may be needed. An empty table
    gives an empty one. A source is missed by less than the shortest document of it that is left over; up to
    ``span`` words of a target are fitted by the knapsack. The driver gets sums over all sources, a task
    the lengths of one source. Rows are known by their place in the table in each of the three times they are
    read. Texts are held one by one. What is decided, a row per source and length, is broadcast where it measures 64 MB at most; beyond that it is
    shuffled, as a written table, so that Spark can split a length that very many documents have.
    """
    spark = docs.sparkSession
    ship_package(spark)
    key, size, rank, place = fresh(docs, "_source", "_size", "_rank", "_place")
    counted = located(docs, place).withColumns(
        {
            key: _source_key(F.col(source)),
            size: F.size(words(text_of(text))).cast("bigint"),
            rank: _rank(row_key(F.col(id_col), F.col(text)), F.col(place), seed),
        }
    )
    narrow = materialise(
        counted.select(F.col(key).alias("key"), F.col(size).alias("size"), F.col(rank).alias("rank")), "sizes"
    )
    histogram = materialise(narrow.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sums = histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = fill_targets(sums, weights, share)
    plan = materialise(histogram.join(goals, "key").groupBy("key").applyInPandas(_planned(span), PLAN), "plan")
    last = plan.join(_last_ranks(narrow, plan), ["key", "size"], "left").select(
        F.col("key").alias(key),
        F.col("size").alias(size),
        F.struct("source_size", "target", "passes", "extra", "n", "last").alias("plan"),
    )
    (goal,) = fresh(counted, "_plan")
    last = materialise(last, "last").withColumnRenamed("plan", goal)
    joined = counted.join(broadcast_if_small(last), [key, size])
    more = F.when(F.col(goal)["extra"] == F.col(goal)["n"], 1).when(F.col(rank) <= F.col(goal)["last"], 1).otherwise(0)
    return joined.select(
        *[c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")],
        F.col(size).alias("size"),
        F.col(goal)["source_size"].alias("source_size"),
        F.col(goal)["target"].alias("target"),
        (F.col(size) * (F.col(goal)["passes"] + more)).alias("taken"),
    )
