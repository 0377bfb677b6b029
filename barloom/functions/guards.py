"""Size-checked broadcasts and driver collects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from barloom.sources.sinks import materialize

BROADCAST_BYTES = 64 << 20
COLLECT_ROWS = 100_000


def row_bytes(df: DataFrame) -> int:
    """What a row takes in memory, about: 8 bytes a number, 32 a text, 256 anything nested."""
    kinds = [f.dataType.typeName() for f in df.schema.fields]
    return 8 + sum(256 if k in ("array", "map", "struct") else 32 if k in ("string", "binary") else 8 for k in kinds)


def broadcast_if_small(df: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when it takes at most ``limit`` bytes, else leave it to a shuffle join.

    The side is written once, so neither the count nor the join runs its lineage again.
    """
    written = materialize(df, "join-side")
    return F.broadcast(written) if written.count() * row_bytes(written) <= limit else written


def collect_bounded(df: DataFrame, *, limit: int = COLLECT_ROWS) -> list[Row]:
    """Collect a result that must stay small (parameters, cut-offs); refuse a larger one."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"expected at most {limit} rows on the driver")
    return rows
