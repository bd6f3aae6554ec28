"""Value recoding of one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.session import broadcast_if_small, small_table


def _unmapped(source: Column, name: str, policy: str) -> Column:
    if policy == "error":
        message = F.concat(F.lit(f"unmapped value in {name}: "), F.coalesce(source, F.lit("<null>")))
        return F.raise_error(message).cast("int")
    if policy == "null":
        return F.lit(None).cast("int")
    if policy == "keep":
        return source
    raise ValueError(f"unknown policy {policy!r}")


def recode(
    df: DataFrame,
    column: str,
    mapping: dict[str, int],
    *,
    unmapped: str = "error",
    trim: bool = False,
    into: str | None = None,
) -> DataFrame:
    """Replace the values of one column by a lookup; matching is exact unless ``trim``.

    ``unmapped``: ``error`` fails the job, ``null`` yields null, ``keep`` lets the text
    pass and therefore returns a string column. The map is a table that is joined, whatever its size.
    """
    into = into or column
    source = F.col(column)
    if trim:
        source = F.trim(source)
        trimmed: dict[str, int] = {}
        for k, v in mapping.items():  # blanks only, as in the column
            if trimmed.setdefault(k.strip(" "), v) != v:
                raise ValueError(f"{k!r} has two codes once trimmed")
        mapping = trimmed
    fallback = _unmapped(source, column, unmapped)
    kind = "string" if unmapped == "keep" else "int"
    table = small_table(df.sparkSession, list(mapping.items()), "_from string, _to int")
    joined = df.join(broadcast_if_small(table), source == F.col("_from"), "left")
    return joined.withColumn(into, F.coalesce(F.col("_to").cast(kind), fallback)).drop("_from", "_to")
