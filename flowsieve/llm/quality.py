"""Quality rules: counted heuristics, then a hashed n-gram log-likelihood ratio.

A document's hashed one- and two-word features are scored under two multinomials, one of a
trusted target and one of the raw corpus. The mean log ratio per feature decides, against a
threshold that trusted documents set which their own weights were not fitted on. Nothing is
drawn at random. Weights are whole numbers (millionths of a nat), so that sums and the verdict do
not depend on the order of addition.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import NOT_BREAK, fresh, let, where_late, words

BUCKETS = 1 << 18
#: At most so many trusted rows are fitted; they are the ones with the smallest digests.
TRUSTED_ROWS = 200_000
#: Trusted documents are scored in so many parts, each under weights of the others.
FOLDS = 4
#: So large a share of them may score below the threshold.
LOST = 0.02
#: What the threshold (nats per feature) is without held-out documents, and how many of them weigh as much.
PRIOR, PRIOR_WEIGHT = -1.0, 4
UNIT = 1_000_000
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
ADDED = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "log_ratio",
    "kept",
]


def _pairs(h: Column, apart: int) -> Column:
    """Hashes of each value with the one ``apart`` places on."""
    n = F.greatest(F.size(h) - apart, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, apart + 1, n), lambda x, y: F.xxhash64(x, y))


def _windows(h: Column, pairs: Column) -> Column:
    """Hashes of all runs of five words, from those of two neighbours."""
    n = F.greatest(F.size(h) - 4, F.lit(0))
    return F.zip_with(F.slice(_pairs(pairs, 2), 1, n), F.slice(h, 5, n), lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column) -> Column:
    """Words that lie in windows found twice or more: sort, mark equal neighbours, join their spans."""
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def repeated(s):
        return F.filter(
            s,
            lambda v, i: F.coalesce(F.get(s, i + 1)["h"] == v["h"], F.lit(False))
            | F.coalesce((i > 0) & (F.get(s, i - 1)["h"] == v["h"]), F.lit(False)),
        )

    starts = F.sort_array(F.transform(let(placed, repeated), lambda v: v["p"].cast("bigint")))
    nothing = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(
        starts,
        nothing,
        lambda a, p: F.struct(
            (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")
        ),
        lambda a: a["n"],
    )


def _prepared(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with text, words, word hashes and neighbour hashes under names of their own."""
    t, w, h, p = fresh(docs, "_text", "_words", "_hashes", "_pairs")
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(w, words(F.col(t))).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    return df.withColumn(p, _pairs(F.col(h), 1)), {"t": t, "w": w, "h": h, "p": p}


def _log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of target to raw corpus for every bucket, in millionths; 0 without a target."""
    if not target.sum():
        return np.zeros(len(raw), np.int32)
    all_raw, all_target = int(raw.sum()) + len(raw), int(target.sum()) + len(raw)
    pairs, place = np.unique(np.stack([raw, target]), axis=1, return_inverse=True)
    ratios = [
        round(UNIT * (math.log((m + 1) / all_target) - math.log((n + 1) / all_raw))) for n, m in zip(*pairs.tolist())
    ]
    return np.array(ratios, np.int32)[place.ravel()]


def _weigh(df: DataFrame, into: str, hashes: Column, weights: np.ndarray) -> DataFrame:
    """``df`` with the sum of the weights of ``hashes``.

    The weights are the one value of a query of their own: the plan's text, which Spark writes anew at
    every change of plan, does not have them. As a column they are copied once a row: a megabyte, some 50 µs.
    """
    made = pa.table([pa.array([weights.astype(np.int32)], pa.list_(pa.int32()))], ["w"])
    (table,) = fresh(df, "_weights")
    total = F.aggregate(
        hashes,
        F.lit(0).cast("bigint"),
        lambda a, x: a + F.get(F.col(table), F.pmod(x, F.lit(len(weights))).cast("int")),
    )
    df = df.withColumn(table, df.sparkSession.createDataFrame(made).scalar())
    return df.withColumn(into, total).drop(table)


def _counted(df: DataFrame, c: dict[str, str]) -> DataFrame:
    """The counts and ``base_failed`` added to what ``_prepared`` returns."""
    t, w, h, p = (F.col(c[k]) for k in "twhp")
    lines, win = fresh(df, "_lines", "_windows")
    df = df.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_BREAK))).withColumn(win, _windows(h, p))
    count = lambda x: F.size(x).cast("bigint")
    repeats = F.when(
        F.size(F.array_distinct(F.col(win))) == F.size(F.col(win)), F.lit(0).cast("bigint")
    ).otherwise(_covered(F.col(win)))
    df = df.withColumns(
        {
            "n_words": count(w),
            "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace(t, SYMBOLS, "")).cast("bigint"),
            "n_dup_lines": count(F.col(lines)) - count(F.array_distinct(F.col(lines))),
            "n_repeat_words": repeats,
        }
    )
    return df.withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    ).drop(lines, win)


def _size() -> Column:
    """Features of a document."""
    return F.lit(2) * F.col("n_words") - 1


def fit(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    trusted_rows: int = TRUSTED_ROWS,
) -> tuple[np.ndarray, float]:
    """Log ratio of target to raw corpus for every bucket, in millionths, and the threshold.

    ``trusted`` has the ids of the target; ids that are null or not in ``docs`` do nothing, repeats
    count once. Counts are smoothed by one. All of ``docs`` makes the raw corpus. Without a trusted
    document every weight is 0. Scores depend on the size of the corpus, so the threshold does too:
    trusted documents that pass the base rules are scored under weights fitted without their part
    of ``FOLDS``, and a share of ``LOST`` is below it. The fewer they are, the more it is drawn to ``PRIOR``, which
    counts as ``PRIOR_WEIGHT`` of them. The driver gets ``buckets`` rows.
    """
    ids = (
        trusted.select(F.col(id_col).alias("i"))
        .where("i is not null")
        .distinct()
        .orderBy(F.xxhash64("i"), "i")
        .limit(trusted_rows)
        .withColumn("fold", F.pmod(F.xxhash64("i", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    )
    cut = docs.select(F.col(id_col).alias("i"), F.col(text).alias("text"))
    df, c = _prepared(cut, "text")
    marked = df.join(F.broadcast(ids), "i", "left")
    folds = [F.count_if(F.col("fold") == k).alias(f"t{k}") for k in range(FOLDS)]
    counts = (
        marked.select("fold", F.explode(F.concat(c["h"], c["p"])).alias("g"))
        .groupBy(F.pmod("g", F.lit(buckets)).cast("int").alias("b"))
        .agg(F.count(F.lit(1)).alias("raw"), *folds)
        .toArrow()
    )
    places = counts["b"].to_numpy()
    raw, *parts = (np.zeros(buckets, np.int64) for _ in range(FOLDS + 1))
    for into, name in zip([raw, *parts], counts.column_names[1:]):
        into[places] = counts[name].to_numpy()
    target = sum(parts)
    weights = _log_ratios(raw, target)
    if not target.any():
        return weights, PRIOR
    without = [_log_ratios(raw, target - part) for part in parts]
    return weights, _held_out(cut.join(F.broadcast(ids), "i"), without)


def _held_out(docs: DataFrame, without: list[np.ndarray]) -> float:
    """The threshold from documents with their ``fold`` and the weights without each."""
    names = [f"w{k}" for k in range(len(without))]
    # At most FOLDS + 1 whole numbers a bucket, whatever the size of the corpus.
    table = F.broadcast(
        docs.sparkSession.createDataFrame(
            pa.table([pa.array(range(len(without[0])), pa.int32()), *map(pa.array, without)], ["b", *names])
        )
    )
    df, c = _prepared(docs, "text")
    df = where_late(_counted(df, c).withColumn("place", F.monotonically_increasing_id()), ~F.col("base_failed"))
    each = df.select("place", "fold", _size().alias("size"), F.explode(F.concat(c["h"], c["p"])).alias("g"))
    scored = (
        each.select("place", "fold", "size", F.pmod("g", F.lit(len(without[0]))).cast("int").alias("b"))
        .join(table, "b")
        .groupBy("place", "size")
        .agg(F.sum(F.get(F.array(*names), F.col("fold"))).alias("score"))
    )
    # Rounded down, so that the document at the threshold stays.
    n, least = scored.agg(
        F.count(F.lit(1)), F.expr(f"percentile_disc({LOST}) within group (order by floor(score / size))")
    ).first()
    return (n * int(least or 0) / UNIT + PRIOR_WEIGHT * PRIOR) / (n + PRIOR_WEIGHT)


def judge(
    docs: DataFrame,
    weights: np.ndarray,
    *,
    text: str = "text",
    threshold: float = PRIOR,
) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``log_ratio`` and ``kept`` added (replacing namesakes).

    A null text is an empty one: no words, so it fails. Rows are judged one by one, so repeated
    rows get equal verdicts and an empty table stays empty. A text is held whole, with a few hashes a
    word, however long. ``log_ratio`` is null without words. The score is at least the threshold in whole numbers, so a tie is kept.
    """
    df, c = _prepared(docs, text)
    (score,) = fresh(df, "_score")
    df = _counted(_weigh(df, score, F.concat(c["h"], c["p"]), weights), c)
    return df.withColumns(
        {
            "log_ratio": F.when(F.col("n_words") > 0, F.col(score) / _size() / UNIT),
            "kept": ~F.col("base_failed") & (F.col(score) >= F.lit(round(threshold * UNIT)) * _size()),
        }
    ).drop(score, *c.values())


def quality_rules(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Fit on all of ``docs`` and judge each of them."""
    weights, threshold = fit(docs, trusted, id_col=id_col, text=text, **kw)
    return judge(docs, weights, text=text, threshold=threshold)
