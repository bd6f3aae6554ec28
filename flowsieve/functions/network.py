"""Address-prefix flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.names import normalise


def prefix_flags(address: Column, prefixes: dict[str, str]) -> list[Column]:
    """One 0/1 column per named prefix; a missing address matches none."""
    return [
        F.coalesce(F.startswith(address, F.lit(prefix)), F.lit(False)).cast("int").alias(normalise(name))
        for name, prefix in prefixes.items()
    ]
