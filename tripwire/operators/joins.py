"""Size-checked broadcast joins.

A side is broadcast only after its row count is known: it is materialised
once with a reliable ``checkpoint()`` (written to the shared
``spark.checkpoint.dir``, lineage cut, survives executor loss), counted, and
broadcast when under the bound; otherwise Spark's shuffle join runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwire.session import reliable_checkpoint

# Rows a broadcast side may hold (each node keeps a copy in memory).
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


def materialize_small(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Checkpoint ``df`` and report whether it fits the broadcast bound."""
    small = reliable_checkpoint(df)
    fits = small.limit(max_rows + 1).count() <= max_rows
    return small, fits


def bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
            known_rows: int | None = None) -> tuple[DataFrame, bool]:
    """``(df, fits)``: a row count known by construction, else checkpoint and count."""
    if known_rows is not None:
        return df, known_rows <= max_rows
    return materialize_small(df, max_rows)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = DEFAULT_MAX_BROADCAST_ROWS, known_rows: int | None = None) -> DataFrame:
    """``big.join(small)`` broadcasting ``small`` only when its checked size allows."""
    s, fits = bounded(small, max_rows, known_rows)
    return big.join(F.broadcast(s) if fits else s, on, how)
