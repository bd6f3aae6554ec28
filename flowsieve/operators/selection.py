"""Tree importance and recursive elimination with cross-validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve import presets
from flowsieve.operators.histograms import ALL, Store, binned, grow, held_out_accuracy
from flowsieve.session import small_table


def tree_importance(design: DataFrame, names: list[str], *, max_depth: int = 30) -> DataFrame:
    """(feature, importance) of one decision tree over all rows."""
    (tree,) = grow(binned(design, len(names)), [ALL], [list(range(len(names)))], max_depth)
    return small_table(
        design.sparkSession, list(zip(names, tree.importances())), "feature string, importance double"
    )


def weakest(importances, kept: list[int], drop: int) -> list[int]:
    """The ``drop`` least important of ``kept``; among equals the later column goes first."""
    order = sorted(range(len(kept)), key=lambda i: (importances[i], -kept[i]))
    return [kept[i] for i in order[:drop]]


def step_size(step: float, width: int) -> int:
    """A fraction below 1 means that share of the initial width, rounded down, at least 1."""
    return max(1, int(step * width)) if 0 < step < 1 else int(step)


def level_sizes(width: int, step: int, smallest: int) -> list[int]:
    sizes = [width]
    while sizes[-1] > smallest:
        sizes.append(max(smallest, sizes[-1] - step))
    return sizes


def _eliminate(
    store: Store, outs: list[int], sizes: list[int], max_depth: int, score: bool
) -> tuple[list[list[list[int]]], dict[int, list[float]]]:
    """Columns kept at each size and, if asked for, the held-out accuracy there, for every held-out fold in ``outs``.

    Trees of all folds are grown in the same passes; a new one after every elimination.
    """
    kept = [list(range(store.width)) for _ in outs]
    levels, scores = [], {}
    for i, size in enumerate(sizes):
        levels.append([list(own) for own in kept])
        last = i + 1 == len(sizes)
        if last and not score:
            break
        trees = grow(store, outs, kept, max_depth)
        if score:
            scores[size] = held_out_accuracy(store, trees)
        if not last:
            for own, tree in zip(kept, trees):
                for gone in weakest(tree.importances(), list(own), size - sizes[i + 1]):
                    own.remove(gone)
    return levels, scores


@dataclass
class Elimination:
    names: list[str]
    sizes: list[int]
    scores: dict[int, list[float]]
    rank: list[int]

    @property
    def best_size(self) -> int:
        return best_size(self.scores)

    @property
    def selected(self) -> list[int]:
        return [i for i, r in enumerate(self.rank) if r == 1]


def best_size(scores: dict[int, list[float]]) -> int:
    """Size with the highest mean accuracy; the smaller size on a tie."""
    return min(scores, key=lambda n: (-sum(scores[n]) / len(scores[n]), n))


def _curve(store: Store, k: int, step: float, smallest: int, max_depth: int) -> dict[int, list[float]]:
    sizes = level_sizes(store.width, step_size(step, store.width), smallest)
    return _eliminate(store, list(range(k)), sizes, max_depth, True)[1]


def elimination_curve(
    design: DataFrame,
    width: int,
    *,
    k: int = presets.FOLDS,
    step: float = 1,
    smallest: int = 1,
    max_depth: int = 30,
    fold: str = "selection_fold",
) -> dict[int, list[float]]:
    """Held-out accuracy per number of features, one value per fold.

    ``design`` (``label``, ``features``, fold column) is read twice, for its cut points and to be stored in bins.
    Folds eliminate independently; each size is a few passes over the bins for all of them.
    """
    return _curve(binned(design, width, fold=fold), k, step, smallest, max_depth)


def rfecv(
    design: DataFrame,
    names: list[str],
    *,
    k: int = presets.FOLDS,
    step: float = 1,
    smallest: int = 1,
    max_depth: int = 30,
    fold: str = "selection_fold",
) -> Elimination:
    """Find the best number of features over the folds, then eliminate down to it on all rows.

    Rank 1 is selected; higher ranks left earlier.
    """
    width = len(names)
    store = binned(design, width, fold=fold)
    scores = _curve(store, k, step, smallest, max_depth)
    sizes = level_sizes(width, step_size(step, width), best_size(scores))
    levels = [own for (own,) in _eliminate(store, [ALL], sizes, max_depth, False)[0]]
    rank = [1] * width
    for level, kept in enumerate(levels):
        for c in range(width):
            if c not in kept and rank[c] == 1:
                rank[c] = len(levels) - level + 1
    return Elimination(names, list(scores), scores, rank)


def curve_table(design: DataFrame, scores: dict[int, list[float]]) -> DataFrame:
    rows = [(n, f, s) for n, per_fold in scores.items() for f, s in enumerate(per_fold)]
    table = small_table(design.sparkSession, rows, "n_features int, fold int, accuracy double")
    return table.groupBy("n_features").agg(
        F.count(F.lit(1)).cast("int").alias("folds"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
    )


def support_table(design: DataFrame, found: Elimination) -> DataFrame:
    rows = [(n, r, int(r == 1)) for n, r in zip(found.names, found.rank)]
    return small_table(design.sparkSession, rows, "feature string, rank int, selected int")
