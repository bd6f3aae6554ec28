"""Small helpers that the text operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.session import materialise

#: What separates words everywhere here: blank, tab, line feed, vertical tab, form feed, return.
BREAK = r"[\x20\x09-\x0D]+"
NOT_BREAK = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text_of(c: str | Column) -> Column:
    """The text, with null as the empty one."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAK), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where lambdas use it again and again."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` does not have yet; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for base in bases:
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        names.append(name)
    return names


def set_aside(docs: DataFrame, added: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that an operator would replace renamed, and how to select them as they were."""
    clash = [c for c in docs.columns if c.lower() in {a.lower() for a in added}]
    renamed = dict(zip(clash, fresh(docs, *[f"_own_{c}" for c in clash])))
    return docs.withColumnsRenamed(renamed), [F.col(renamed.get(c, c)).alias(c) for c in docs.columns]


def where_late(df: DataFrame, condition: Column) -> DataFrame:
    """Filter by columns that are costly to work out, once they are.

    A plain filter is pushed below the projections, with their expressions written out in it, and
    what lambdas share is then worked out for every element. A row number, which may not move, stops that.
    """
    (row,) = fresh(df, "_row")
    return df.withColumn(row, F.monotonically_increasing_id()).where(condition & (F.col(row) >= 0)).drop(row)


def row_key(*columns: Column) -> Column:
    """16 bytes that tell rows of different content apart; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    lengths = [F.length(p).cast("string") for p in parts]
    return F.unhex(F.md5(F.concat_ws(",", *lengths, *parts)))


def _scans_one_table(df: DataFrame) -> bool:
    """Whether the rows of ``df`` are rows of a stored table, each at most once."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def located(df: DataFrame, into: str) -> DataFrame:
    """``df`` with 16 bytes that tell every row from all others, the same each time it is read.

    They come from the file and the place in it. A number given out in the scan would change with the
    splits, and these follow the executors there are. What is not a scan of Parquet is written first.
    """
    for rows in (df, None):
        if rows is None:
            rows = materialise(df, "rows")
        elif not _scans_one_table(df):
            continue
        where = rows.metadataColumn("_metadata")
        place = F.concat_ws(":", where["file_path"], where["row_index"].cast("string"))
        try:
            return rows.withColumn(into, F.unhex(F.md5(place)))
        except AnalysisException:  # files without numbered rows
            if rows is not df:
                raise
    raise AssertionError("a written table has numbered rows")
