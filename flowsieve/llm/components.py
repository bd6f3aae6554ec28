"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.session import materialise

#: Edges of a written file at least; later rounds have fewer and fewer.
FILE_ROWS = 5_000


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them and the node itself.

    ``small``: the smaller neighbours and the node; else the larger ones. The smallest neighbour is
    found by a combined aggregate and joined back, so that the star of a hot node stays in many rows.
    """
    if not small:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if small:
        out = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(low.select("a", F.col("m").alias("b")))
    else:
        out = edges.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node but the roots.

    ``edges`` has two columns of one type; order and repeats do not matter. Every round is written
    to the checkpoint folder, so lost executors cost one round at most. A round has no more files than the edges
    before it are worth.
    """
    a, b = edges.columns
    found = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    found, seen = materialise(found, "edges"), None
    for _ in range(rounds):
        state = found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return found.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        stars = _star(_star(found, small=False), small=True)
        found = materialise(stars.coalesce(state[0] // FILE_ROWS + 1), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
