"""Row identity, stratified folds, and deletion of rows.

None of these send a class, a file or the whole table through one task: ranks are counted
within hash or scan cells and shifted by running totals of a small table of counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.names import check_columns
from flowsieve.session import broadcast_if_small, materialise

ROWS_PER_CELL = 1_000_000
#: Hex digits of the first count at most, and of a whole digest.
FIRST_DIGITS, DIGEST_DIGITS = 4, 32


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    check_columns(df, columns)
    return df.drop(*columns)


def select_features(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Features in the given order, then the target."""
    check_columns(df, [*features, label])
    return df.select(*features, label)


def drop_negative(df: DataFrame, column: str) -> DataFrame:
    """Remove rows below zero; null and NaN stay."""
    return df.where(~F.coalesce(F.col(column) < 0, F.lit(False)))


def exclude_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not listed. Listing an id twice, or one that is already
    gone, is harmless. The list is reduced to distinct ids before it is moved."""
    listed = ids.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(broadcast_if_small(listed), key, "left_anti")


# --- contiguous row ids


def _running(counts: DataFrame, order: list[str]) -> Column:
    """Total of ``n`` over the rows before this one, in ``order``."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(before), F.lit(0))


def scan_order_id(df: DataFrame, *, order: list[str] | None = None, into: str = "row_id") -> DataFrame:
    """0..N-1 in scan order (``order`` columns first, then file and place in file).

    ``df`` must be a written table carrying ``_file``, ``_block`` and ``_at`` from
    ``sources.flows.scan_csv(position=True)``. Data rows are not shuffled or sorted: each
    block's first id comes from a table with one row per block, and the place in the block
    is read off ``_at``, which counts upward within a block. That table is written once and keyed
    by a digest of the block, checked to be unique, so that a million blocks are about 30 MB to
    broadcast.
    """
    order = order or []
    cell = [*order, "_file", "_block"]
    blocks = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    digest = F.xxhash64(*cell).alias("_cell")
    starts = materialise(
        blocks.select(digest, (_running(blocks, cell) - F.col("_first")).alias("_shift")), "starts"
    )
    if starts.count() != starts.select("_cell").distinct().count():
        raise RuntimeError("two blocks have one digest")
    return (
        df.withColumn("_cell", digest)
        .join(broadcast_if_small(starts), "_cell")
        .withColumn(into, F.col("_at") + F.col("_shift"))
        .drop("_cell", "_shift", "_file", "_block", "_at")
    )


def sorted_row_id(df: DataFrame, keys: list[str], *, into: str = "row_id") -> DataFrame:
    """0..N-1 in key order.

    One range shuffle. The scan position closes the sort key, so that equal keys, even a
    third of all rows, are spread over several ranges. The sorted rows are written once:
    range bounds are sampled, and only a written table guarantees that the counts and the
    final ids see the same ranges.
    """
    check_columns(df, keys)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.orderBy(*keys, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.shiftright("_at", 33)), "sorted")
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    starts = parts.select("_part", _running(parts, ["_part"]).alias("_start"))
    return (
        placed.join(broadcast_if_small(starts), "_part")
        .withColumn(into, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_at", "_start")
    )


# --- stratified shuffled folds


def shuffle_hash(key: list[str], seed: int) -> Column:
    """Seeded digest of a row's key; its order is the shuffled order. Kept as 16 bytes, which
    halves what is shuffled and sorted; they order like the hex text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    return F.unhex(F.md5(F.concat_ws("~", F.lit(str(seed)), *parts)))


def _cell(digits: int) -> Column:
    """Class and leading hex digits of the digest."""
    return F.concat("_stratum", F.lit("~"), F.substring(F.hex("_h"), 1, digits))


def _first_digits(rows: int) -> int:
    """Leading digits that give cells of about ROWS_PER_CELL rows, as far as the first count goes."""
    return max(1, min(FIRST_DIGITS, math.ceil(math.log(max(rows, 1) / ROWS_PER_CELL + 1, 16))))


def _celled(df: DataFrame, label: str, key: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with its digest ``_h`` and ``_cell``, and a stored table of the rows of each cell.

    The first count has at most 16^FIRST_DIGITS cells a class, and combines before the shuffle. Cells that are
    too large still are counted again by two digits more, and only their rows are, until none is. Copies of one key,
    which no digit parts, are left together.
    """
    missing = F.raise_error(F.lit(f"null in {label}: cannot stratify")).cast("string")
    hashed = df.withColumn("_h", shuffle_hash(key, seed)).withColumn(
        "_stratum", F.coalesce(F.col(label).cast("string"), missing)
    )
    bits = F.xxhash64("_h")
    sizes = [F.count(F.lit(1)).alias("n"), F.min(bits).alias("_low"), F.max(bits).alias("_high")]
    count = lambda rows: rows.groupBy(F.col(label).alias("_class"), "_cell").agg(*sizes)
    fine = count(hashed.withColumn("_cell", _cell(FIRST_DIGITS)))
    fine = materialise(fine, "cells")
    total = fine.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    digits = _first_digits(total)
    spare = FIRST_DIGITS - digits
    cells = fine.withColumn("_cell", F.expr(f"left(_cell, length(_cell) - {spare})")).groupBy("_class", "_cell")
    cells = cells.agg(F.sum("n").alias("n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    hashed = hashed.withColumn("_cell", _cell(digits))
    while digits < DIGEST_DIGITS:
        large = cells.where((F.col("n") > ROWS_PER_CELL) & (F.col("_low") < F.col("_high")))
        large = materialise(large.select("_cell", F.lit(True).alias("_large")), "large")
        if large.isEmpty():
            break
        digits += 2
        known = hashed.join(broadcast_if_small(large), "_cell", "left")
        hashed = known.withColumn("_cell", F.when(F.col("_large"), _cell(digits)).otherwise(F.col("_cell")))
        finer = count(hashed.where("_large").drop("_large"))
        cells = cells.join(broadcast_if_small(large.drop("_large")), "_cell", "left_anti").unionByName(finer.select(*cells.columns))
        cells = materialise(cells, "cells")
        hashed = hashed.drop("_large")
    return hashed, cells


def stratified_folds(
    df: DataFrame,
    *,
    label: str,
    key: list[str],
    k: int = 5,
    seed: int = 1,
    into: str = "fold",
    spread_copies: bool = False,
    rank: str | None = None,
) -> DataFrame:
    """Assign each row a fold 0..k-1, shuffled, with every class spread evenly.

    Rows are ranked by (class, digest, key) and dealt out in turn, so folds differ by at
    most one row in total and within each class. Cells are (class, digest prefix): the
    prefix leads the sort key, hence cell start + place in cell equals the global rank. Prefixes are as
    long as it takes for a cell to have at most ``ROWS_PER_CELL`` rows.
    Two passes over the rows: one counts cells, one ranks within them after the only
    shuffle; very large tables are counted again in part. The result depends only on keys, labels and seed, not on partitioning.

    The key must identify a row within its class; a repeat fails the job when folds are read.
    ``spread_copies`` allows repeats: the scan position then always joins the digest, so copies
    are spread over all cells, and folds depend on the order of the scan, which is fixed by
    writing the table first. ``rank`` names a column for the place in the whole order, from which
    ``inner_fold`` tells the folds of a training part without ranking again.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    check_columns(df, [label, *key])
    columns = df.columns
    if spread_copies:
        df, key = materialise(df.withColumn("_tie", F.monotonically_increasing_id()), "tied"), [*key, "_tie"]
    hashed, counts = _celled(df, label, key, seed)
    classes = counts.groupBy("_class").agg(F.sum("n").alias("n"))
    short = F.raise_error(
        F.concat(F.lit(f"class has fewer rows than {k} folds: "), F.col("_class").cast("string"))
    ).cast("bigint")
    classes = classes.select(
        "_class",
        F.when(F.col("n") < k, short).otherwise(_running(classes, ["_class"])).alias("_before"),
    )
    earlier = Window.partitionBy("_class").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.withColumn("_within", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(classes, "_class")
        .select("_cell", (F.col("_before") + F.col("_within")).alias("_start"))
    )
    ranking = Window.partitionBy("_cell").orderBy("_h", *key)
    place = F.row_number().over(ranking) - 1
    # the digest is the same for nulls and empty texts, so the keys themselves are compared
    alike = F.lag(F.struct(*key)).over(ranking).eqNullSafe(F.struct(*key))
    repeated = F.raise_error(F.lit(f"key {key} does not identify a row")).cast("int")
    return (
        hashed.withColumn("_place", F.when(alike, repeated).otherwise(place))
        .join(starts, "_cell")
        .withColumn("_rank", F.col("_start") + F.col("_place"))
        .withColumn(into, F.pmod("_rank", F.lit(k)).cast("int"))
        .select(*columns, *([F.col("_rank").alias(rank)] if rank else []), into)
    )


def inner_fold(rank: str, outer: int, k_outer: int, k_inner: int) -> Column:
    """Inner fold of a row outside outer fold ``outer``: ``stratified_folds`` of that part, by the same
    key and seed, ranks its rows in the same order, so the rank less the rows of the outer fold before
    it is the rank there."""
    r = F.col(rank)
    before = F.floor((r + (k_outer - 1 - outer)) / k_outer).cast("bigint")
    return F.pmod(r - before, F.lit(k_inner)).cast("int")


def fold_balance(df: DataFrame, *, label: str, fold: str = "fold") -> DataFrame:
    return df.groupBy(label, fold).agg(F.count(F.lit(1)).alias("n"))


def train_test(df: DataFrame, test_fold: int, *, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Everything outside one fold, and that fold. On a table partitioned by ``fold`` both
    filters prune partitions."""
    return df.where(F.col(fold) != test_fold), df.where(F.col(fold) == test_fold)


def frame_shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
