"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripwire.session import scratch_path


def importable(spark: SparkSession) -> None:
    """Let local Python workers import this package wherever the driver found it; a cluster has it
    installed or shipped with --py-files, and a path missing there is ignored."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def _give_back() -> None:
    """Return what a task has freed to the system: a worker lives on, and the next stage's needs come on top."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with this package importable in the workers, which give memory back after each task."""
    importable(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        _give_back()

    return df.mapInArrow(task, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with no column of ``df`` (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(key: Column, m: int) -> Column:
    """crc32 of ``key`` as text, modulo ``m``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % m


def in_fold(key: Column, m: int, r: int) -> Column:
    """True for the rows whose crc remainder is ``r``; false for a null key."""
    return F.coalesce(crc_mod(key, m) == r, F.lit(False))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


#: Open scopes of scratch tables, the innermost last: per table its path and whether it outlives the scope.
_scopes: ContextVar[tuple[list, ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` makes inside are deleted from the shared folder at the end, but for those with
    ``keep``, which a returned plan still reads: they go at the end of the scope around this one, if there is one."""
    outer, tables = _scopes.get(), []
    token = _scopes.set((*outer, tables))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path, keep in tables:
            if not keep:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            elif outer:
                outer[-1].append((path, False))


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back: lineage is
    cut by files that every executor sees, and later reads prune columns."""
    path = scratch_path(df.sparkSession, name)
    if scopes := _scopes.get():
        scopes[-1].append((path, keep))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys of one broadcast; beyond it a bitmap of them is broadcast, of two bytes a key and so many bits at most.
BROADCAST_KEYS, BITMAP_BITS = 100_000, 30


def _bit_place(key: Column, bits: int) -> tuple[Column, Column, Column]:
    """Row, word and bit of a hash in a bitmap of ``2 ** bits`` bits, 64 words a row."""
    slot = key.bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftright(slot, 12), F.shiftright(slot, 6).bitwiseAND(F.lit(63)).cast("int"), slot.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(keys: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Bitmap ``(chunk_, words_)`` of the hashes in ``key_``, and its size as a power of two."""
    bits = min(max((16 * rows - 1).bit_length(), 12), BITMAP_BITS)
    chunk, word, bit = _bit_place(F.col("key_"), bits)
    words = keys.groupBy(chunk.alias("chunk_"), word.alias("word_")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits_"))
    full = words.groupBy("chunk_").agg(F.map_from_entries(F.collect_list(F.struct("word_", "bits_"))).alias("held_"))
    return full.select("chunk_", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda w: F.coalesce(F.get(F.map_values(F.map_filter("held_", lambda k, v: k == w)), F.lit(0)), F.lit(0).cast("long"))).alias("words_")), bits


def _let(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, Column, bool]:
    """A table to broadcast and a condition that holds for the rows of ``df`` whose hash may be among ``keys``; whether
    it holds for no others."""
    rows = keys.count()
    keys = keys.toDF("key_")
    if rows <= BROADCAST_KEYS:
        return F.broadcast(keys), df[column] == F.col("key_"), True
    bitmap, bits = _bitmap(keys, rows)
    chunk, word, bit = _bit_place(df[column], bits)
    held = F.call_function("shiftright", F.get("words_", word), bit).bitwiseAND(F.lit(1)) == 1
    return F.broadcast(bitmap), (chunk == F.col("chunk_")) & held, False


def among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column``, a 64-bit hash, is in the one column of ``keys`` (a written table). The keys
    are broadcast if they are few; if not, a bitmap of them is, and only the rows that it lets through are shuffled
    to the keys: wide rows without a key are never moved."""
    small, condition, exact = _let(df, column, keys)
    if exact:
        return df.join(small, condition, "left_semi")
    keys = keys.toDF("key_")
    return df.join(small, condition, "left_semi").join(keys, F.col(column) == F.col("key_"), "left_semi")


def parted(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``column``, a 64-bit hash, may be in the one column of ``keys`` (a written table, repeated
    keys are no harm), and those for which it is not: the latter need not be moved to meet the keys. No row is shuffled."""
    small, condition, _ = _let(df, column, keys)
    return df.join(small, condition, "left_semi"), df.join(small, condition, "left_anti")


def slices(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (binary) holds about ``max_bytes`` per piece; a longer
    single value is a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and held + n > max_bytes:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        if at < batch.num_rows:
            yield batch.slice(at)


def sample_by_hash(df: DataFrame, key: Column, bound: int, rows: int, seed: int) -> DataFrame:
    """About ``bound`` of ``rows`` rows, chosen by a hash of ``key``: no sort, no single task,
    the same rows on every run. Only for fitting a classifier."""
    if rows <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * bound / rows))
