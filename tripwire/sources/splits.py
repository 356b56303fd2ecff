"""Large JSON and CSV files read by byte ranges, although their records span lines.

A file is read as text, cut at one separator, so that Spark deals byte ranges of it
(blocks) to many tasks. What a piece means depends on what stands before it: whether a
quoted string is open, how many brackets are. Per block that is a small function of the
state at its start: the parity of its quotes, and the brackets it opens and closes for
either parity. Composing these functions over the blocks of a file, one row a block, gives
each block its true start and each piece its own; then pieces are joined up to the next one
that ends a record. No row holds more than one record. The text of JSON files crosses one
exchange, by block, and records of several pieces meet in a group; CSV lines are joined where
they are read, and only records that cross blocks are moved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Order of what stands after a file's last complete record.
REST = (1 << 62) - 1
_IN_BLOCK = ("file", "block")


def file_path() -> Column:
    """Path of a row's file, as listings report it (the reader's is URL-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def pieces(spark: SparkSession, paths: Sequence[str], sep: str) -> DataFrame:
    """``(file, block, at, size, piece)``: what stands between separators. Within a block (the offset of a byte
    range), ``at`` follows the file's order; ``size`` is that of the file."""
    raw = spark.read.option("lineSep", sep).option("recursiveFileLookup", "true").text(list(paths))
    return raw.select(file_path().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
                      F.col("_metadata.file_size").alias("size"), F.col("value").alias("piece"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``order``, increasing within a file: a block's offset, then one a piece."""
    w = Window.partitionBy(*_IN_BLOCK).orderBy("at")
    return rows.withColumn("order", F.col("block") + F.row_number().over(w) - 1)


def running(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with the sum of each value in its block, up to and including the row."""
    w = Window.partitionBy(*_IN_BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.sum(v).over(w) for name, v in values.items()})


def before(value: Column | str) -> Column:
    """Over a table of blocks: the sum of ``value`` in the earlier blocks of the file."""
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def records(rows: DataFrame, sep: str) -> DataFrame:
    """``(file, order, start, record)`` from numbered pieces with a column ``ends``: pieces joined by ``sep`` up to one
    that ends; ``order`` is that one's (``REST`` for what follows the last), ``start`` the first one's."""
    w = Window.partitionBy(*_IN_BLOCK).orderBy("at")
    ends = F.when(F.col("ends"), F.col("order"))
    firsts = rows.groupBy(*_IN_BLOCK).agg(F.min(ends).alias("first"))
    later = Window.partitionBy("file").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("file", "block", F.min("first").over(later).alias("next_block"))
    follows = F.coalesce(F.lag("ends").over(w), F.col("order") == 0)
    here = F.min(ends).over(Window.partitionBy(*_IN_BLOCK).orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"whole": F.col("ends") & follows, "here": here}).join(firsts, list(_IN_BLOCK))
    rows = rows.select("file", "order", "piece", "whole", F.coalesce("here", "next_block", F.lit(REST)).alias("record_at"))
    single = rows.filter("whole").select("file", "order", F.col("order").alias("start"), F.col("piece").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("order", "piece")))
    several = rows.filter(~F.col("whole")).groupBy("file", "record_at").agg(parts.alias("parts")).select(
        "file", F.col("record_at").alias("order"), F.get("parts", F.lit(0))["order"].alias("start"),
        F.array_join(F.transform("parts", lambda p: p["piece"]), sep).alias("record"))
    return single.unionByName(several)


# CSV ---------------------------------------------------------------------------
def _records_of_blocks(batches: Iterator[pa.RecordBatch], fragments: bool) -> Iterator[tuple]:
    """From lines ``(file, block, inside, piece)`` in order of their blocks, per batch and block: ``(file, order, start, text, ends)``, the last
    three as arrays. Either the records that lie within a block, or, for ``fragments``, what does not: the lines up to the first end where
    a block begins inside of quotes, and those after the last end (``ends`` is false)."""
    key = odd = at = first = None
    held: list[pa.Array] = []  # lines of the open record, from the row ``first`` on

    def one(ends: bool) -> tuple:
        text = pa.array(["\n".join(x for part in held for x in part.to_pylist())], pa.string())
        return key[0], np.array([key[1] + at - 1]), np.array([key[1] + first]), text, ends

    for batch in batches:
        file, block, inside, piece = (batch.column(k) for k in range(4))
        numbers = block.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        # Ranges of different files may begin at the same byte.
        places = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.union1d(cuts, np.flatnonzero(np.diff(places)) + 1)
        for lo, hi in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
            if hi == lo:
                continue
            here = (file[int(lo)].as_py(), int(numbers[lo]))
            if here != key:
                if key is not None and held and fragments:
                    yield one(False)
                key, odd, at, first, held = here, int(inside[int(lo)].as_py()), 0, 0, []
                started_inside = bool(odd)
            lines = piece.slice(int(lo), int(hi - lo))
            quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
            parity = (odd + np.cumsum(quotes)) & 1
            odd = int(parity[-1])
            stops = np.flatnonzero(parity == 0)
            if not len(stops):
                held.append(lines)
                at += len(lines)
                continue
            begin = 0
            if held or (started_inside and first == 0 and at == 0):
                # The record that was open at the start of these lines.
                begin, base = int(stops[0]) + 1, at
                held.append(lines.slice(0, begin))
                at += begin
                broken = started_inside and first == 0
                if broken == fragments:
                    yield one(True)
                at, held, stops = base, [], stops[1:]
            if len(stops):
                bounds = np.r_[begin, stops + 1]
                if not fragments:
                    texts = lines.slice(begin, int(bounds[-1]) - begin)
                    single = len(stops) == int(bounds[-1]) - begin
                    joined = texts if single else pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds - begin, pa.int32()), texts), "\n")
                    yield key[0], key[1] + at + stops, key[1] + at + bounds[:-1], joined, True
                begin = int(bounds[-1])
            first = at + begin
            if begin < len(lines):
                held = [lines.slice(begin)]
            at += len(lines)
    if key is not None and held and fragments:
        yield one(False)


#: A byte range as the reader names it. Its length belongs to it: ranges that are cut otherwise in a second read must not be taken for it.
_RANGE = ("raw", "block", "length")
_RECORD = "file string, order bigint, start bigint, record string, ends boolean"


def _assembled(lines: DataFrame, starts: DataFrame, fragments: bool) -> DataFrame:
    """Lines with the state at the start of their blocks, put together block by block where they are read."""
    names = [f.strip().split()[0] for f in _RECORD.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, order, start, text, ends in _records_of_blocks(batches, fragments):
            n = len(order)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file, pa.string()), n), pa.array(order, pa.int64()), pa.array(start, pa.int64()),
                                              text.cast(pa.string()), pa.array([ends] * n, pa.bool_())], names)

    known = F.broadcast(starts.select(*[F.col(c).alias(f"_{c}") for c in _RANGE], "file", "inside"))
    same = reduce(and_, [F.col(c) == F.col(f"_{c}") for c in _RANGE])
    changed = F.raise_error(F.concat(F.lit("byte ranges changed while reading "), F.col("raw"))).cast("string")
    rows = lines.join(known, same, "inner" if fragments else "left").withColumn("file", F.coalesce("file", changed))
    return rows.select("file", "block", "inside", "piece").mapInArrow(run, _RECORD)


def csv_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, order, start, record)``: the records of CSV files whose quoted fields may hold line ends (a quote
    inside a field is doubled). A field that is never closed raises.

    The quotes of each byte range are counted first (one row a range), which gives every range its state at the start; then
    the ranges' lines become records where they are read, in order, and no line is shuffled or sorted. Only the
    records that cross from one range to another meet in a group, two pieces a range at most.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(list(paths))
    lines = raw.select(F.col("_metadata.file_path").alias("raw"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("_metadata.file_block_length").alias("length"), F.col("value").alias("piece"))
    blocks = lines.groupBy(*_RANGE).agg((F.sum(_count(F.col("piece"), '"')) % 2).alias("odd"))
    blocks = blocks.withColumn("file", F.url_decode(F.replace(F.col("raw"), F.lit("+"), F.lit("%2B"))))
    starts = blocks.select(*_RANGE, "file", "odd", (before("odd") % 2 == 1).alias("inside"))
    whole = _assembled(lines, starts, fragments=False).select("file", "order", "start", "record")
    # Ranges that begin or end inside of quotes.
    parts = _assembled(lines, starts.filter("inside or odd = 1"), fragments=True)
    later = Window.partitionBy("file").orderBy(F.col("start").desc()).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("record_at", F.coalesce(F.min(F.when(F.col("ends"), F.col("order"))).over(later), F.lit(REST)))
    several = F.array_sort(F.collect_list(F.struct("start", "record")))
    joined = parts.groupBy("file", "record_at").agg(several.alias("parts")).select(
        "file", F.col("record_at").alias("order"), F.get("parts", F.lit(0))["start"].alias("start"),
        F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    found = whole.unionByName(joined)
    record = F.when(F.col("order") == REST, F.raise_error(F.concat(F.lit("unclosed quotes in "), F.col("file"))).cast("string")).otherwise(
        F.regexp_replace("record", "\r$", ""))
    return found.withColumn("record", record)


# JSON --------------------------------------------------------------------------
def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def json_elements(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(parts, files)`` of files that hold one JSON object each, split at the objects in its arrays.

    ``parts(file, order, keyed, json)`` has, for each object that is an element of a top-level array, a JSON object of its own:
    the element in the array ``_prev``, or, where other top-level keys stand before it (``keyed``), those and
    the element in its key's array; and one for the end of the file. ``files(file, error)`` says what is wrong
    with a file as a whole, or null.
    """
    rows = numbered(pieces(spark, paths, "}"))
    plain = F.regexp_replace("piece", r"(?s)\\.", "")  # without escapes
    rows = rows.withColumn("strings", F.split(plain, '"', -1))
    even = F.array_join(F.filter("strings", lambda x, i: i % 2 == 0), "")
    odd = F.array_join(F.filter("strings", lambda x, i: i % 2 == 1), "")
    odd_quotes = (F.size("strings") - 1) % 2
    # Brackets outside strings, with the closing one that follows the piece, if it begins outside (0) or inside (1).
    rows = rows.withColumns({
        "quoted": odd_quotes, "curly0": _count(even, "{") - (1 - odd_quotes), "curly1": _count(odd, "{") - odd_quotes,
        "square0": _count(even, "[") - _count(even, "]"), "square1": _count(odd, "[") - _count(odd, "]")}).drop("strings")
    rows = running(rows, quotes=F.col("quoted"))
    flipped = (F.col("quotes") - F.col("quoted")) % 2 == 1  # against the start of the block

    def either(name: str, inside: bool) -> Column:
        return F.when(flipped != inside, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    kinds = [(name, inside) for name in ("curly", "square") for inside in (False, True)]
    rows = running(rows, **{f"{name}_{inside}": either(name, inside) for name, inside in kinds})
    # The last row of a block has its totals.
    last = F.max_by(F.struct("quotes", *[f"{name}_{inside}" for name, inside in kinds]), "at").alias("t")
    blocks = rows.groupBy(*_IN_BLOCK).agg(last, F.sum(F.octet_length("piece") + 1).alias("bytes"), F.max("size").alias("size"),
                                          F.max_by(F.col("piece").rlike(r"^\s*$"), "at").alias("blank"))
    blocks = blocks.withColumn("inside", before(F.col("t.quotes") % 2) % 2 == 1)
    change = {name: F.when(F.col("inside"), F.col(f"t.{name}_True")).otherwise(F.col(f"t.{name}_False")) for name in ("curly", "square")}
    blocks = blocks.withColumns({f"{name}_in": v for name, v in change.items()})
    starts = blocks.select("file", "block", "inside", *[before(f"{name}_in").alias(f"{name}_at") for name in change])
    rows = rows.join(starts, list(_IN_BLOCK))
    depth = {name: F.col(f"{name}_at") + F.when(F.col("inside"), F.col(f"{name}_True")).otherwise(F.col(f"{name}_False")) for name in change}
    outside = (F.col("quotes") % 2 == 1) == F.col("inside")
    # An object that closes to the root's array: one open brace, one open bracket.
    rows = rows.withColumn("ends", outside & (depth["curly"] == 1) & (depth["square"] == 1))

    files = blocks.groupBy("file").agg(
        F.sum("bytes").alias("bytes"), F.max("size").alias("size"), F.max_by("blank", "block").alias("blank"),
        F.sum("curly_in").alias("curly"), F.sum("square_in").alias("square"), (F.sum(F.col("t.quotes")) % 2).alias("open"))
    # Whether the last piece is followed by a separator: its byte is in the file (which a mark of three bytes may begin).
    surplus = F.col("bytes") - F.col("size")
    closed = F.when(surplus.isin(0, -3), True).when(surplus.isin(1, -2), False).otherwise(~F.col("blank"))  # otherwise: compressed
    files = files.withColumn("closed", closed)
    files = files.withColumn("error", F.when(F.col("open") == 1, "an open string").when(
        (F.col("curly") + F.when(F.col("closed"), 0).otherwise(1) != 0) | (F.col("square") != 0), "open brackets").when(
        ~F.col("closed") & ~F.col("blank"), "text after the object"))

    found = records(rows.select("file", "block", "at", "order", "piece", "ends"), "}").join(files.select("file", "closed"), "file")
    body = F.when(F.col("start") == 0, F.col("record")).otherwise(F.concat(F.lit('{"_prev":['), F.regexp_replace("record", r"^\s*,", "")))
    end = F.when(F.col("order") < REST, F.lit("}]}")).when(F.col("closed"), F.lit("}")).otherwise(F.lit(""))
    keyed = (F.col("start") == 0) | ~F.col("record").rlike(r"^\s*,\s*\{")
    parts = found.select("file", "order", keyed.alias("keyed"), F.concat(body, end).alias("json"))
    return parts, files.select("file", "error")
