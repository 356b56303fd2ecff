"""SimHash fingerprints, and a search for all fingerprints within a Hamming radius.

Terms are pairs of successive words (the first word pairs with the text's start), A-Z
lower-cased, words between ASCII blanks. Each distinct term votes with weight
1 + ln(occurrences) on every bit, for or against as its hash has that bit.

Search by permuted block tables: the fingerprint is cut into more blocks than the radius;
there is a table for each choice of (blocks - radius) blocks, and two fingerprints within
the radius agree on all blocks of at least one choice. With no more blocks than the radius
there is a table for each block, and the asked fingerprints look up every value that differs
in so few bits (radius // blocks) as one block must. Equal fingerprints are one entry; pairs
are verified exactly, and no bucket is capped. Near copies of one text are put in one class
first, so that a search returns classes, and its rows do not grow with the square of a class.

Defined results: null texts count as empty; a text without words has the zero fingerprint;
equal texts have equal fingerprints; rows are ordered by id (nulls first), then text, so
repeated ids and rows have a defined next row; after the last row comes the first; one
single row is its own next; an empty table gives an empty result; columns are selected
by name, others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import arrow_map, slices, text_bytes, written
from tripwire.llm.graph import components

BITS = 128
#: Distance in which near copies (a similarity of 0.8 on five-word shingles) are searched, and the blocks for it.
NEAR, NEAR_BLOCKS = 17, 6
_LANES = BITS // 64
_KEPT = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes, known: dict) -> np.ndarray:
    """The text's fingerprint as 64-bit lanes."""
    words = text.lower().split()
    if not words:
        return np.zeros(_LANES, np.uint64)
    if len(known) > _KEPT:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    terms, times = np.unique(_mix(np.r_[np.uint64(1), h[:-1]] * np.uint64(0x9E3779B97F4A7C15) + h), return_counts=True)
    lanes = np.stack([_mix(terms + np.uint64((k + 1) * 0xD1B54A32D192ED03 % 2**64)) for k in range(_LANES)], axis=1)
    bits = np.unpackbits(lanes.view(np.uint8).reshape(len(terms), -1), axis=1)
    weights = (1 + np.log(times)).astype(np.float32)
    return np.packbits(2 * (weights @ bits.astype(np.float32)) > weights.sum()).view(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bits."""
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def _hex(lanes: np.ndarray) -> str:
    return lanes.tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``fingerprint`` (hexadecimal)."""
    schema = docs.select(id_col).schema.add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_hex(fingerprint(t, known)) for t in b.column(1).to_pylist()], pa.string())], schema.names)

    return arrow_map(docs.select(F.col(id_col), text_bytes(F.col(text_col)).alias("raw_text")), run, schema)


def _with_next(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows ``(id, text)`` dealt by ranges of ``id``, so that each range, read in order, ends with a copy
    (``tail``) of the row that follows it. Only bounds and first ids of the ranges come to the driver."""
    bounds = sorted(set(rows.approxQuantile("id", [k / buckets for k in range(1, buckets)], 0.1 / buckets))) if buckets > 1 else []
    kind = rows.schema["id"].dataType
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b <= F.col("id"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    first = {r["bucket"]: None if r["nulls"] else r["first"] for r in rows.groupBy("bucket").agg(F.min("id").alias("first"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()}
    if not first:
        return rows.withColumn("tail", F.lit(False))
    full = sorted(first)
    heads = F.array(*[F.lit(first.get(k)).cast(kind) for k in range(full[-1] + 1)])
    before = F.array(*[F.lit(full[full.index(k) - 1] if k in first else -1) for k in range(full[-1] + 1)])
    is_head = F.col("id").eqNullSafe(F.get(heads, F.col("bucket")))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail"))
    copy = F.when(is_head, F.struct(F.get(before, F.col("bucket")).alias("bucket"), F.lit(True).alias("tail")))
    placed = rows.select("id", "text", F.explode(F.array_compact(F.array(own, copy))).alias("at")).select("id", "text", "at.bucket", "at.tail")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "tail", F.col("id").asc_nulls_first(), "text")


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per row: id, ``n_chars``, the digest of the edited text (its last half replaced by the beginning of the
    next row's text), both fingerprints, ``near_edited`` and ``near_next`` (shares of equal bits). The text is
    shuffled once. ``id_col`` must be a number."""
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = docs.select(id_col).schema.add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add(
        "edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, kind = _WordHashes(), None, None

        def row(now: tuple, following: tuple) -> tuple:
            _, i, text, mine = now
            half = len(text) // 2
            edited = (text[: len(text) - half] + following[2][:half]).encode()
            other = fingerprint(edited, known)
            return (i, len(text), hashlib.sha256(edited).hexdigest(), _hex(mine), _hex(other), likeness(mine, other), likeness(mine, following[3]))

        for b in slices(batches, 1):
            out = []
            kind = b.schema.field(0).type
            for i, raw, bucket, tail in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is not None and last[0] == bucket:
                    now = (bucket, i, raw.decode(), fingerprint(raw, known))
                    out.append(row(last, now))
                    last = None if tail else now
                elif not tail:  # else the second row with the first id of the next range
                    last = (bucket, i, raw.decode(), fingerprint(raw, known))
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    placed = _with_next(rows, buckets)
    return arrow_map(placed.select("id", F.col("text").cast("binary").alias("raw_text"), "bucket", "tail"), run, schema)


# search ------------------------------------------------------------------------
def _blocks(blocks: int) -> list[tuple[int, int]]:
    """Start and length of each block in hexadecimal digits."""
    cuts = [round(k * (BITS // 4) / blocks) for k in range(blocks + 1)]
    return [(a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _tables(fp: Column, radius: int, blocks: int) -> Column:
    parts = [F.substring(fp, a, n) for a, n in _blocks(blocks)]
    return F.array(*[F.struct(F.lit(t).alias("table"), F.concat(*[parts[k] for k in chosen]).alias("block"))
                     for t, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def _distance(a: str, b: str) -> Column:
    """Hamming distance of two hexadecimal fingerprints, 15 digits at a time."""
    parts = [(k + 1, min(15, BITS // 4 - k)) for k in range(0, BITS // 4, 15)]
    out = F.lit(0)
    for at, n in parts:
        x, y = (F.conv(F.substring(F.col(c), at, n), 16, 10).cast("long") for c in (a, b))
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def _values(fp: str, blocks: int) -> Column:
    """The blocks of a hexadecimal fingerprint as numbers."""
    return F.array(*[F.conv(F.substring(F.col(fp), a, n), 16, 10).cast("long") for a, n in _blocks(blocks)])


def _probes(fp: str, radius: int, blocks: int) -> Column:
    """Per block every value within ``radius // blocks`` bits of the fingerprint's own, as ``(table, value)``."""
    own, out = _values(fp, blocks), []
    for t, (_, n) in enumerate(_blocks(blocks)):
        masks = F.array(*[F.lit(sum(1 << k for k in bits)).cast("long") for r in range(radius // blocks + 1) for bits in combinations(range(4 * n), r)])
        out.append(F.transform(masks, _probe(t, F.get(own, F.lit(t)))))
    return F.concat(*out)


def _probe(table: int, value: Column):
    return lambda mask: F.struct(F.lit(table).alias("table"), value.bitwiseXOR(mask).alias("value"))


def _probed(asked: DataFrame, entries: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``(query, found, rows)`` that differ in at most ``radius // blocks`` bits of some block."""
    probes = asked.select("query", F.explode(_probes("query", radius, blocks)).alias("p")).select("query", "p.table", "p.value")
    places = entries.select("found", "rows", F.posexplode(_values("found", blocks)).alias("table", "value"))
    return probes.join(places, ["table", "value"])


def within(queries: DataFrame, rows: DataFrame, radius: int = 3, blocks: int | None = None, fp_col: str = "fingerprint") -> DataFrame:
    """``(query, found, distance, rows)`` for every distinct fingerprint of ``queries`` and of ``rows`` within
    ``radius``, with the number of rows that have it."""
    blocks = blocks or radius + 1
    if not 0 < blocks <= BITS // 4:
        raise ValueError("blocks are of at least one digit each")
    entries = rows.groupBy(F.col(fp_col).alias("found")).agg(F.count(F.lit(1)).alias("rows"))
    asked = queries.select(F.col(fp_col).alias("query")).distinct()
    if blocks > radius:
        entries = entries.withColumn("t", F.explode(_tables(F.col("found"), radius, blocks)))
        asked = asked.withColumn("t", F.explode(_tables(F.col("query"), radius, blocks)))
        both = asked.join(entries, (asked["t.table"] == entries["t.table"]) & (asked["t.block"] == entries["t.block"]))
    else:
        both = _probed(asked, entries, radius, blocks)
    near = both.select("query", "found", "rows", _distance("query", "found").alias("distance")).filter(F.col("distance") <= radius)
    return near.distinct().select("query", "found", "distance", "rows")


def classes(rows: DataFrame, radius: int = NEAR, blocks: int = NEAR_BLOCKS, fp_col: str = "fingerprint") -> DataFrame:
    """``(found, rows, class)`` for every distinct fingerprint: the number of its rows, and its class, the least fingerprint that
    a chain of steps within ``radius`` joins it to. Steps are sought between fingerprints with an equal block and the
    least one of that block's list, so lists of any length are gone through once; classes need not be as large as they
    could be, for :func:`search` finds what lies between them. Written."""
    entries = written(rows.groupBy(F.col(fp_col).alias("found")).agg(F.count(F.lit(1)).alias("rows")), "entries")
    places = entries.select("found", F.posexplode(_values("found", blocks)).alias("table", "value"))
    heads = places.groupBy("table", "value").agg(F.min("found").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    steps = places.join(heads, ["table", "value"]).filter("found != head").select(F.col("found").alias("a"), F.col("head").alias("b")).distinct()
    steps = written(steps.filter(_distance("a", "b") <= radius), "steps")
    named = components(steps).select(F.col("key").alias("found"), F.col("root").alias("class"))
    return written(entries.join(named, "found", "left").withColumn("class", F.coalesce("class", "found")), "classes", keep=True)


def search(asked: DataFrame, named: DataFrame, radius: int = NEAR, blocks: int = NEAR_BLOCKS, fp_col: str = "fingerprint") -> DataFrame:
    """``(query, class, distance, rows)``: for each distinct asked fingerprint the classes (see :func:`classes`) besides its own that hold
    fingerprints within ``radius``, the least distance, and the number of rows within it. What is near in its own class, whose
    members may be farther apart than ``radius``, is told by :func:`search_own`.

    Classes of one fingerprint are looked up directly. Of larger ones a list has one entry for each block value and
    class; only where such an entry is met are the class's members with that value compared.
    """
    own = named.select(F.col("found").alias("query"), F.col("class").alias("own"))
    mine = asked.select(F.col(fp_col).alias("query")).distinct().join(own, "query")
    probes = mine.select("query", "own", F.explode(_probes("query", radius, blocks)).alias("p")).select("query", "own", "p.table", "p.value")
    sizes = named.groupBy("class").agg(F.count(F.lit(1)).alias("prints"))
    placed = named.join(sizes, "class").select("found", "rows", "class", "prints", F.posexplode(_values("found", blocks)).alias("table", "value"))
    near = _distance("query", "found") <= radius
    direct = probes.join(placed.filter("prints = 1").drop("prints"), ["table", "value"]).filter((F.col("class") != F.col("own")) & near)
    large = placed.filter("prints > 1").drop("prints")
    met = probes.join(large.select("table", "value", "class").distinct(), ["table", "value"]).filter("class != own")
    inside = met.join(large, ["table", "value", "class"]).filter(near)
    found = [x.select("query", "class", "found", "rows", _distance("query", "found").alias("distance")) for x in (direct, inside)]
    found = found[0].unionByName(found[1]).dropDuplicates(["query", "found"])
    return found.groupBy("query", "class").agg(F.min("distance").alias("distance"), F.sum("rows").alias("rows"))


def _lanes(fp: str) -> list[Column]:
    """A hexadecimal fingerprint as numbers, 15 digits at a time."""
    return [F.conv(F.substring(F.col(fp), k + 1, min(15, BITS // 4 - k)), 16, 10).cast("long") for k in range(0, BITS // 4, 15)]


#: Fingerprints of a class that one group compares with the asked ones of the class.
_SLICE = 10_000


def search_own(asked: DataFrame, named: DataFrame, radius: int = NEAR, fp_col: str = "fingerprint", slice_size: int = _SLICE) -> DataFrame:
    """``(query, class, distance, rows)`` as :func:`search`, for each distinct asked fingerprint's own class: the other rows within
    ``radius``, those with the same fingerprint among them, and the least distance of one. A class is a chain of
    steps, so that membership does not tell which of its members are near each other.

    Members are compared in slices of a class, each with the asked fingerprints of that class, as numbers; what a task finds is summed up
    per fingerprint before it is moved.
    """
    sizes = named.groupBy("class").agg(F.count(F.lit(1)).alias("prints"))
    sized = named.join(sizes, "class").withColumn("slices", F.ceil(F.col("prints") / F.lit(slice_size)).cast("int"))
    mine = asked.select(F.col(fp_col).alias("query")).distinct().join(sized, F.col("query") == F.col("found"))
    alone = mine.filter("prints = 1 and rows > 1").select("query", "class", F.lit(0).alias("distance"), (F.col("rows") - 1).alias("rows"))
    lanes = [f"lane{k}" for k in range(len(_lanes("found")))]
    members = sized.filter("prints > 1").select("class", "found", "rows", F.pmod(F.xxhash64("found"), F.col("slices")).cast("int").alias("slice"),
                                                *[v.alias(x) for x, v in zip(lanes, _lanes("found"), strict=True)])
    mine = mine.filter("prints > 1").select("class", "query", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
                                            *[v.alias(f"q_{x}") for x, v in zip(lanes, _lanes("query"), strict=True)])
    distance = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"q_{x}"))) for x in lanes), F.lit(0))
    pairs = mine.join(members, ["class", "slice"]).select("query", "class", "found", "rows", distance.alias("distance")).filter(F.col("distance") <= radius)
    # The asked row itself is one of the rows at distance 0.
    other = F.when((F.col("found") != F.col("query")) | (F.col("rows") > 1), F.col("distance"))
    near = pairs.groupBy("query", "class").agg(F.min(other).alias("distance"), (F.sum("rows") - 1).alias("rows")).filter("rows > 0")
    return near.unionByName(alone)
