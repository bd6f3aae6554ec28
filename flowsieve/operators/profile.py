"""Column profiling and pruning: constants, correlation, redundancy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve import presets
from flowsieve.functions.names import check_columns
from flowsieve.session import small_table


#: A variance below this share of the mean square is rounding, not spread.
RESOLVED = 1e-13


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_values, is_constant) per column, from one pass.

    Constant means at most one distinct non-null value. Minimum and maximum suffice and
    combine before the shuffle, unlike a distinct count.
    """
    columns = columns or df.columns
    check_columns(df, columns)
    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(c).alias("n_values"),
                F.coalesce(F.min(c) == F.max(c), F.lit(True)).cast("int").alias("is_constant"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.inline(F.array(*one.columns)))


def drop_constant(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    found = constant_columns(df).where("is_constant = 1").collect()  # at most one row per column
    return df.drop(*[r["column_name"] for r in found if r["column_name"] not in keep])


MOMENTS = ("n", "x", "xx", "xy")


def _moments(columns: list[str], shift: list[float]):
    """Sums over a task's rows for every ordered pair: rows with both values, and of these x, x squared and x times y."""

    def run(batches):
        total = np.zeros((len(MOMENTS), len(columns), len(columns)))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]) - shift
            there = ~np.isnan(x)
            x[~there] = 0.0
            there = there.astype(float)
            total += [there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x]
        i, j = np.indices(total.shape[1:])
        cells = [pa.array(v.ravel()) for v in (i.astype(np.int32), j.astype(np.int32), *total)]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", *MOMENTS])

    return run


def correlation(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Pearson matrix from one pass; only columns x columns numbers reach the driver.

    A pair is judged on the rows that have both values: a null or NaN leaves that pair and no other. Values are
    shifted by one that occurs, so that sums do not cancel. The coefficient is NaN where it is undefined: a
    column constant on the rows of the pair, fewer than two of them, or an infinity.
    """
    check_columns(df, columns)
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    names = numbers.columns
    head = numbers.limit(100).agg(*[F.first(F.nanvl(c, F.lit(None)), ignorenulls=True).alias(c) for c in names]).first()
    shift = [v if v is not None and math.isfinite(v) else 0.0 for v in head]
    parts = numbers.mapInArrow(_moments(names, shift), "i int, j int, " + ", ".join(f"{m} double" for m in MOMENTS))
    sums = parts.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS]).toPandas()
    n, x, xx, xy = np.zeros((len(MOMENTS), len(columns), len(columns)))
    for into, m in zip((n, x, xx, xy), MOMENTS):
        into[sums["i"], sums["j"]] = sums[m]
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = n * xx - x * x
        spread[~(spread > RESOLVED * n * xx)] = np.nan
        r = (n * xy - x * x.T) / np.sqrt(spread * spread.T)
    r = np.clip(r, -1.0, 1.0)
    return {(a, b): float(r[i, j]) for i, a in enumerate(columns) for j, b in enumerate(columns)}


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (x, y, r), each once, x before y in column order."""
    r = correlation(df, columns)
    pairs = [(a, b, r[a, b]) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return small_table(df.sparkSession, pairs, "x string, y string, r double")


def corr_with_label(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    r = correlation(df, [*columns, label])
    rows = [(c, r[c, label]) for c in columns]
    return small_table(df.sparkSession, rows, "column_name string, r double")


def redundant(r: dict[tuple[str, str], float], columns: list[str], label: str, threshold: float) -> list[str]:
    """Columns to drop: go through pairs with \\|r\\| >= threshold, strongest first, and drop
    the member less correlated with the label; the later column on a tie."""
    strength = lambda c: 0.0 if math.isnan(r[c, label]) else abs(r[c, label])
    pairs = [
        (-abs(r[a, b]), i, j)
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i < j and abs(r[a, b]) >= threshold
    ]
    gone: set[str] = set()
    for _, i, j in sorted(pairs):
        a, b = columns[i], columns[j]
        if a not in gone and b not in gone:
            gone.add(a if strength(a) < strength(b) else b)
    return [c for c in columns if c in gone]


def corr_prune(
    df: DataFrame, columns: list[str], label: str, *, threshold: float = presets.CORRELATION_THRESHOLD
) -> list[str]:
    """Names of the redundant columns, from one correlation pass that includes the label."""
    return redundant(correlation(df, [*columns, label]), columns, label, threshold)
