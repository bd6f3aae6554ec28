"""Exact quantiles by narrowing ranks, for any number of rows and any spread of values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative rank error of a sketch is one in so many.
ACCURACY = 10_000


@dataclass
class _Search:
    """Looking for place ``rank`` of a column; so far it lies strictly between two values.

    ``before`` values are at or below ``low``, ``count`` lie between."""

    column: str
    rank: int
    low: float
    high: float
    before: int
    count: int

    def inside(self) -> Column:
        x = F.col(self.column).cast("double")
        return F.when((x > F.lit(self.low)) & (x < F.lit(self.high)), x)

    def shares(self) -> list[float]:
        """The wanted share of the values inside, and a bit less and more than a sketch may err."""
        share = (self.rank - self.before + 0.5) / self.count
        return [min(max(share + d, 0.0), 1.0) for d in (-2 / ACCURACY, 0.0, 2 / ACCURACY)]

    def learn(self, value: float, below: int, upto: int) -> float | None:
        """What the number of values below and up to ``value`` tells: the answer, or a closer bound."""
        if below <= self.rank < upto:
            return value
        if upto <= self.rank and value > self.low:
            self.count -= upto - self.before
            self.low, self.before = value, upto
        elif below > self.rank and value < self.high:
            self.count = below - self.before
            self.high = value
        return None


def _bracket(df: DataFrame, searches: list[_Search]) -> list[list[float]]:
    row = df.agg(
        *[
            F.percentile_approx(s.inside(), s.shares(), F.lit(ACCURACY)).alias(f"v{i}")
            for i, s in enumerate(searches)
        ]
    ).first()
    return [sorted(set(row[f"v{i}"])) for i in range(len(searches))]


def _ranks(df: DataFrame, points: list[tuple[str, float]]) -> list[tuple[int, int]]:
    """How many values of the column lie below each point, and up to it."""
    count = lambda test: F.count(F.when(test, 1))
    aggregates = []
    for i, (column, value) in enumerate(points):
        x = F.col(column).cast("double")
        aggregates += [count(x < F.lit(value)).alias(f"b{i}"), count(x <= F.lit(value)).alias(f"u{i}")]
    row = df.agg(*aggregates).first()
    return [(row[f"b{i}"], row[f"u{i}"]) for i in range(len(points))]


def exact_quantiles(df: DataFrame, targets: list[tuple[str, float]]) -> list[float]:
    """Linearly interpolated quantiles of double columns, nulls ignored, one per target.

    An exact ``percentile`` aggregate gathers all distinct values in one buffer and a sorted
    limit sends a growing share of rows to one task. Here a mergeable sketch of bounded size
    proposes values around the wanted places, an exact count tells on which side of them each
    place lies, and the next sketch looks only between. Each round leaves about one in two
    thousand of the values, whatever their spread; four rounds are enough for 10^12. All
    targets share the passes. ``df`` should be a stored table.
    """
    columns = sorted({c for c, _ in targets})
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    summary = df.agg(
        *[
            e.alias(f"{name}_{i}")
            for i, c in enumerate(columns)
            for name, e in (("n", F.count(c)), ("bad", F.count(F.when(bad(c), 1))))
        ]
    ).first()
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], _Search] = {}
    places = []
    for column, p in targets:
        n, wrong = (summary[f"{k}_{columns.index(column)}"] for k in ("n", "bad"))
        if n == 0:
            raise ValueError(f"no values in {column}")
        if wrong:
            raise ValueError(f"NaN or infinity in {column}")
        position = p * (n - 1)
        below = min(int(math.floor(position)), n - 1)
        above = min(below + 1, n - 1)
        places.append((column, below, above, position - below))
        for rank in (below, above):
            open_[column, rank] = _Search(column, rank, -math.inf, math.inf, 0, n)
    while open_:
        searches = list(open_.values())
        brackets = _bracket(df, searches)
        points = sorted({(s.column, v) for s, values in zip(searches, brackets) for v in values})
        counts = dict(zip(points, _ranks(df, points)))
        for target, s in list(open_.items()):
            for point in points:  # what was counted for one place helps the others
                if point[0] == s.column:
                    answer = s.learn(point[1], *counts[point])
                    if answer is not None:
                        found[target] = answer
                        del open_[target]
                        break
    result = []
    for column, below, above, weight in places:
        a, b = found[column, below], found[column, above]
        result.append(a if weight == 0 else a + (b - a) * weight)
    return result
