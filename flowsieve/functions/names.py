"""Column naming: one normal form, applied once at load."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", name).lower()


def quoted(name: str) -> str:
    """Backtick form, so that dots in a raw header are not read as field access."""
    return "`" + name.replace("`", "``") + "`"


def check_columns(df: DataFrame, wanted) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; present: {df.columns}")


def normalise_names(df: DataFrame) -> DataFrame:
    """Rename every column to its normal form in one projection; the header spelling is
    kept as column metadata under ``original``."""
    taken: dict[str, str] = {}
    for name in df.columns:
        other = taken.setdefault(normalise(name), name)
        if other != name or df.columns.count(name) > 1:
            raise ValueError(f"columns {other!r} and {name!r} both become {normalise(name)!r}")
    return df.select(
        *[F.col(quoted(n)).alias(normalise(n), metadata={"original": n}) for n in df.columns]
    )
