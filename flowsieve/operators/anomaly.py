"""Isolation forests (Liu, Ting and Zhou, 2008) over groups of columns.

The table is read once to count and check it, once to draw the training rows, and once to
score. Training rows number at most trees x sample size, whatever the size of the table.

No generator with a state is used. Every choice is read off a digest of what it is for: the seed, the tree,
the node and the kind of choice, or the seed and the row's key. So a choice can be made anywhere, in any
order, again, and by SQL too.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve import presets
from flowsieve.functions.names import check_columns
from flowsieve.operators.quantiles import exact_quantiles
from flowsieve.session import broadcast_if_small, materialise, materialised, ship_package

EULER_GAMMA = 0.5772156649015329

NODE_FIELDS = ["feature", "threshold", "child", "depth"]
NODE_SCHEMA = "grp string, tree int, node int, feature int, threshold double, child int, depth double"
MILLION = 1_000_000
#: Prime of the row digests, and its bits.
PRIME, PRIME_BITS = (1 << 31) - 1, 31
SCORE_ROWS = 1024  # rows scored at a time: keeps the working arrays in cache


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree over ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def choice(*what) -> str:
    """32 hex digits that belong to a choice; smaller ones come first where one of several is chosen."""
    return md5("~".join(map(str, what)).encode()).hexdigest()


def chosen_features(seed: int, tree: int, width: int, k: int) -> list[int]:
    """The ``k`` of ``width`` columns that a tree looks at."""
    return sorted(sorted(range(width), key=lambda j: choice(seed, tree, "feature", j))[:k])


def node_choices(seed: int, tree: int) -> tuple[Callable[[int, int], str], Callable[[int], float]]:
    """Order of a column at a node, and the place of a node's cut between 0 and 1."""
    order = lambda node, j: choice(seed, tree, node, j)
    place = lambda node: int(choice(seed, tree, node, "cut")[:15], 16) / 2.0**60
    return order, place


def grow_tree(x: np.ndarray, features: list[int], limit: int, choices) -> list[tuple]:
    """Nodes (feature, threshold, child, depth) of one isolation tree, breadth first.

    A node is cut at the first of ``features`` that varies in it, in the order that ``choices`` gives them there.
    Values above the threshold go to ``child + 1``, others to ``child``. A leaf is its own
    child behind an infinite threshold; its depth includes the expected depth below it, in whole
    millionths, so that sums of depths do not depend on the order of addition. Choices know nodes by
    their place in the full binary tree: the root is 1, below k are 2k and 2k + 1.
    """
    order, place = choices
    nodes: list[tuple] = [()]
    todo = deque([(0, 1, np.arange(len(x)), 0)])
    while todo:
        me, name, rows, depth = todo.popleft()
        split = None
        if depth < limit and len(rows) > 1:
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            varied = [j for j in features if low[j] < high[j]]
            if varied:
                f = min(varied, key=lambda j: order(name, j))
                cut = float(low[f] + place(name) * (high[f] - low[f]))
                split = (f, cut if cut < high[f] else float(low[f]))
        if split is None:
            nodes[me] = (0, math.inf, me, float(round(MILLION * (depth + average_path(len(rows))))))
            continue
        child = len(nodes)
        nodes[me] = (*split, child, float(MILLION * depth))
        nodes += [(), ()]
        above = x[rows, split[0]] > split[1]
        todo.append((child, 2 * name, rows[~above], depth + 1))
        todo.append((child + 1, 2 * name + 1, rows[above], depth + 1))
    return nodes


@dataclass
class Forest:
    """Trees of one group, laid out as flat node arrays; ``depth`` is in millionths."""

    columns: list[str]
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    steps: int
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2^(-mean depth / c(sample size)): the lower, the more isolated."""
        if self.scale <= 0:  # trees of one row tell nothing
            return np.full(len(x), -0.5)
        total = np.empty(len(x))
        for start in range(0, len(x), SCORE_ROWS):
            part = np.ascontiguousarray(x[start : start + SCORE_ROWS])
            total[start : start + len(part)] = self._depths(part)
        return -np.exp2(-total / MILLION / len(self.roots) / self.scale)

    def _depths(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf depth per row, walking all rows down all trees together."""
        values, row_start = x.ravel(), (np.arange(len(x)) * x.shape[1])[:, None]
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        index = np.empty_like(at)
        value, bound = np.empty(at.shape), np.empty(at.shape)
        # clip only skips the bounds check; every index is in range
        for _ in range(self.steps):
            self.feature.take(at, out=index, mode="clip")
            index += row_start
            values.take(index, out=value, mode="clip")
            self.threshold.take(at, out=bound, mode="clip")
            self.child.take(at, out=index, mode="clip")
            np.add(index, value > bound, out=at)
        return self.depth.take(at).sum(axis=1)


def _tree_numbers(seed: int, trees: int) -> np.ndarray:
    """Multiple and addend of the high and of the low half of a row's number, per tree."""
    return np.array([[int(choice(seed, "tree", t)[k : k + 7], 16) + 1 for k in (0, 7, 14, 21)] for t in range(trees)], dtype=np.int64)


def taking_part(a: np.ndarray, b: np.ndarray, numbers: np.ndarray, bound: int):
    """Row, tree and number of every number below ``bound``. Most are ruled out by their high half alone."""
    at, tree, number = [], [], []
    for start in range(0, len(a), SCORE_ROWS):
        high = (a[start : start + SCORE_ROWS, None] * numbers[:, 0] + numbers[:, 1]) % PRIME
        i, t = np.nonzero(high <= bound >> PRIME_BITS)
        low = (b[start + i] * numbers[t, 2] + numbers[t, 3]) % PRIME
        u = (high[i, t] << PRIME_BITS) + low
        inside = u < bound
        at.append(start + i[inside])
        tree.append(t[inside])
        number.append(u[inside])
    empty = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate([empty, *found]) for found in (at, tree, number))


def _draw(df: DataFrame, columns: list[str], key: list[str], rows: int, trees: int, sample: int, seed: int):
    """``sample`` rows per tree without replacement, as (tree, place, columns).

    A row has one digest, of its key; a tree maps it, by multiples and remainders of its own, to 62 bits. A row takes
    part in a tree if its number there is below twice the share wanted, which is decided in the scan, by NumPy over
    rows x trees; of these, the smallest make the sample. About 2 x trees x sample rows leave the scan, and a task passes
    on at most ``sample`` rows per tree. Rows of equal key go by their values. It is the same rule for a table of any size.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    # columns of the table go by their places, so their names cannot clash with these
    places = [f"x{i}" for i in range(len(columns))]
    values = [F.col(c).cast("double").alias(x) for c, x in zip(columns, places)]
    drawn = df.select(F.md5(F.concat_ws("~", F.lit(f"{seed}~draw"), *parts)).alias("h"), *values)
    digits = lambda at: (F.conv(F.substring("h", at, 14), 16, 10).cast("bigint") % PRIME)
    drawn = drawn.select(digits(1).alias("a"), digits(15).alias("b"), *places)
    numbers = _tree_numbers(seed, trees)
    bound = min(int(2.0 * sample / rows * 2.0 ** (2 * PRIME_BITS)), 1 << (2 * PRIME_BITS))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, tree, u = taking_part(pdf["a"].to_numpy(), pdf["b"].to_numpy(), numbers, bound)
            yield pdf[places].iloc[at].assign(tree=tree, u=u)

    schema = ", ".join([*[f"{x} double" for x in places], "tree int", "u bigint"])
    x = F.struct(*[F.col(x).alias(c) for c, x in zip(columns, places)])
    drawn = drawn.mapInPandas(numbered, schema).select("tree", "u", x.alias("x"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("u", "x"))
    return drawn.withColumn("place", place).where(F.col("place") <= sample).select("tree", "place", "x.*")


def fit_forests(
    df: DataFrame,
    groups: dict[str, list[str]],
    *,
    key: list[str],
    trees: int = presets.FOREST_TREES,
    sample: int = presets.FOREST_SAMPLE,
    features: int = presets.FOREST_FEATURES,
    seed: int = presets.FOREST_SEED,
) -> dict[str, Forest]:
    """One forest per column group, all from the same drawn rows and in the same passes.

    ``key`` should identify a row: rows of equal key are drawn together. The result does not
    depend on partitioning. A null, NaN or
    infinity in any group column is an error, as is a group with fewer than ``features``
    columns.
    """
    columns = list(dict.fromkeys(c for g in groups.values() for c in g))
    check_columns(df, [*key, *columns])
    for name, cols in groups.items():
        if not 1 <= features <= len(cols):
            raise ValueError(f"{features} features per tree do not fit group {name} of {len(cols)}")
    unusable = [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in columns]
    summary = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.when(u, 1)).alias(f"bad_{i}") for i, u in enumerate(unusable)],
    ).first()
    bad = [c for i, c in enumerate(columns) if summary[f"bad_{i}"]]
    if bad:
        raise ValueError(f"null, NaN or infinity in {bad}")
    ship_package(df.sparkSession)
    rows = summary["rows"]
    if rows == 0:
        raise ValueError("no rows to fit on")
    sample = min(sample, rows)
    limit = math.ceil(math.log2(max(sample, 2)))
    layout = {name: [columns.index(c) for c in cols] for name, cols in groups.items()}

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[columns].to_numpy(dtype=float)
        out = []
        for name, at in layout.items():
            # the same choices for every group: groups differ only in their columns
            chosen = chosen_features(seed, tree, len(at), features)
            nodes = grow_tree(x[:, at], chosen, limit, node_choices(seed, tree))
            out += [(name, tree, i, *node) for i, node in enumerate(nodes)]
        return pd.DataFrame(out, columns=["grp", "tree", "node", *NODE_FIELDS])

    drawn = _draw(df, columns, key, rows, trees, sample, seed)
    # at most groups x trees x (2 x sample - 1) nodes
    nodes = drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    forests = {}
    for name, cols in groups.items():
        mine = nodes[nodes["grp"] == name].sort_values(["tree", "node"]).reset_index(drop=True)
        first = mine.index.to_numpy() - mine["node"].to_numpy()
        forests[name] = Forest(
            columns=list(cols),
            roots=np.flatnonzero(mine["node"].to_numpy() == 0),
            feature=mine["feature"].to_numpy(dtype=np.intp),
            threshold=mine["threshold"].to_numpy(dtype=float),
            child=(mine["child"].to_numpy() + first).astype(np.intp),
            depth=mine["depth"].to_numpy(dtype=float),
            steps=limit,
            scale=average_path(sample),
        )
    return forests


def score_forests(df: DataFrame, forests: dict[str, Forest], *, prefix: str = "score_") -> DataFrame:
    """Add one score column per group, all from one Arrow pass over the rows."""
    columns = list(dict.fromkeys(c for f in forests.values() for c in f.columns))
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(forests)
    schema = T.StructType([T.StructField(prefix + name, T.DoubleType()) for name in forests])

    def scores(*series: pd.Series) -> pd.DataFrame:
        named = dict(zip(columns, series))
        out = {}
        for name, forest in shared.value.items():
            x = np.column_stack([named[c].to_numpy(dtype=float) for c in forest.columns])
            out[prefix + name] = forest.score(x)
        return pd.DataFrame(out)

    udf = F.pandas_udf(scores, schema)
    return df.withColumn("_scores", udf(*[F.col(c).cast("double") for c in columns])).select(
        *df.columns, *[F.col(f"_scores.{f.name}") for f in schema]
    )


def flag(score: str, cut: float) -> Column:
    """-1 strictly below the cut, 1 otherwise: rows tied at the cut are kept."""
    return F.when(F.col(score) < F.lit(cut), -1).otherwise(1)


def flag_outliers(
    df: DataFrame,
    groups: dict[str, list[str]],
    *,
    key: list[str],
    contamination: float = presets.CONTAMINATION,
    **forest_options,
) -> DataFrame:
    """Add ``anomaly_<group>`` (-1 outlier, 1 not) for every group.

    Each group is judged on all rows, never on what another group left over. Only keys and scores
    are written, for the exact quantiles; the rows are scored again when the result is read.
    """
    forests = fit_forests(df, groups, key=key, **forest_options)
    names = [f"score_{g}" for g in groups]
    with materialised(_narrow_scores(df, forests, key), "scores") as stored:
        cuts = exact_quantiles(stored, [(n, contamination) for n in names])
    return score_forests(df, forests).select(
        *df.columns, *[flag(n, c).alias(f"anomaly_{g}") for g, n, c in zip(groups, names, cuts)]
    )


def _narrow_scores(df: DataFrame, forests: dict[str, Forest], key: list[str]) -> DataFrame:
    columns = dict.fromkeys([*key, *[c for f in forests.values() for c in f.columns]])
    return score_forests(df.select(*columns), forests).select(*key, *[f"score_{g}" for g in forests])


def drop_outliers(
    df: DataFrame,
    groups: dict[str, list[str]],
    *,
    key: list[str],
    contamination: float = presets.CONTAMINATION,
    **options,
) -> DataFrame:
    """Rows that no group flags, with the columns of ``df``.

    The flagged keys, about the contaminated share of the rows per group, are written; the wide rows
    are not, and are scored once only. Rows that share a flagged key go together.
    """
    forests = fit_forests(df, groups, key=key, **options)
    names = [f"score_{g}" for g in groups]
    with materialised(_narrow_scores(df, forests, key), "scores") as stored:
        cuts = exact_quantiles(stored, [(n, contamination) for n in names])
        low = reduce(or_, [flag(n, c) == -1 for n, c in zip(names, cuts)])
        gone = materialise(stored.where(low).select(*key).distinct(), "outliers")
    return df.join(broadcast_if_small(gone), key, "left_anti").select(*df.columns)
