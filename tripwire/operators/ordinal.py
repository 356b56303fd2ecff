"""Exact positions and running totals without an unbounded window partition.

``row_number() over (partition by g order by k)`` puts a whole group into one
task; a group holding a third of the data then runs on one core. Here the
ordering key is cut into monotone buckets whose size is bounded, so:

* per ``(group, bucket)`` counts are a small aggregate (partial + final);
* their prefix sum over buckets is a window over that aggregate only;
* the exact rank inside a bucket is a window over at most one bucket.

``position = rows in earlier buckets of the group + rank inside the bucket``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwire.functions.core import col

# Width of an integer-key bucket: at most 2**20 rows share one window partition
# when the ordering key is unique.
BUCKET_BITS = 20
# Hash-ordered data (60-bit md5 keys) is cut into 2**20 equal key ranges: the
# bucket-count aggregate stays <= 1M rows, a bucket holds rows / 1M rows.
HASH_BUCKET_BITS = 20


def int_bucket(order: str | Column, bits: int = BUCKET_BITS) -> Column:
    """Monotone bucket of a unique non-negative integer key (``key >> bits``)."""
    return F.shiftright(col(order).cast("bigint"), bits)


def hash_bucket(h60: str | Column, bits: int = HASH_BUCKET_BITS) -> Column:
    """Monotone bucket of a uniform 60-bit hash: its top ``bits`` bits."""
    return F.shiftright(col(h60).cast("bigint"), 60 - bits)


def with_position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = "pos",
) -> DataFrame:
    """Add a 0-based exact position of each row within ``by``, ordered by ``order``.

    ``bucket`` must be non-decreasing in ``order`` and bound the rows per
    ``(by, bucket)``. Equal to ``row_number() - 1`` over ``partition by by
    order by order``; ``order`` must be unique within ``by`` for determinism.
    """
    by = list(by)
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*by, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_bkt").orderBy(*order)
    return (
        b.join(offsets, [*by, "_bkt"])
        .withColumn(name, F.col("_off") + F.row_number().over(inside) - F.lit(1))
        .drop("_bkt", "_off")
    )


def split_exact(value: Column) -> tuple[Column, Column]:
    """A double as an exact decimal and the small double rest, so that sums of ordinary values do not
    depend on the order of additions, while tiny, huge, NaN and infinite ones are summed as doubles."""
    v = value.cast("double")
    plain = F.abs(v) < 1e9  # false for NaN, which is above all numbers
    exact = F.when(plain, v.cast("decimal(38,18)")).otherwise(F.lit(0).cast("decimal(38,18)"))
    return F.when(v.isNotNull(), exact), F.when(plain, v - exact.cast("double")).otherwise(v)


def with_running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    bucket: Column,
    value: str | Column,
    sum_name: str = "_rsum",
    count_name: str = "_rcnt",
) -> DataFrame:
    """Running ``sum(value)`` and ``count`` up to and including each row.

    Same bucket scheme as :func:`with_position`; the frame is
    ``rows between unbounded preceding and current row`` within ``by``.
    Values are split by :func:`split_exact`, so ordinary sums are exact on any
    partitioning and NaN or infinity stays in the sum from its row on.
    """
    by = list(by)
    exact, rest = split_exact(col(value))
    zero = F.lit(0).cast("decimal(38,18)")
    b = df.withColumn("_bkt", bucket).withColumn("_val", exact).withColumn("_rest", rest)
    agg = b.groupBy(*by, "_bkt").agg(F.sum("_val").alias("_s"), F.sum("_rest").alias("_r"), F.count("_val").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = agg.select(
        *by, "_bkt",
        F.coalesce(F.sum("_s").over(before), zero).alias("_s0"),
        F.coalesce(F.sum("_r").over(before), F.lit(0.0)).alias("_r0"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"),
    )
    inside = Window.partitionBy(*by, "_bkt").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = (F.col("_s0") + F.coalesce(F.sum("_val").over(inside), zero)).cast("decimal(38,18)").cast("double")
    small = F.col("_r0") + F.coalesce(F.sum("_rest").over(inside), F.lit(0.0))
    return (
        b.join(offsets, [*by, "_bkt"])
        .withColumn(sum_name, total + small)
        .withColumn(count_name, F.col("_c0") + F.count("_val").over(inside))
        .drop("_bkt", "_val", "_rest", "_s0", "_r0", "_c0")
    )
