"""Near-duplicate detection over SetSketch registers.

A document's set: distinct word shingles (A-Z lower-cased words between ASCII blanks; a
text of fewer words is one shingle). Every element is the seed of its own stream of random
points, each a moment and one of ``m`` registers; a register takes the earliest moment of
all elements, so it is the least of exponential variables, one for each element. It is kept
as the exponent to the base ``BASE``, rounded down and cut to 16 bits. Elements stop once
their next point is later than all registers, so a set of n elements costs some
n + m log m points. Registers of a union are the greater ones of both sides: sketches merge.

Sets that agree on all registers of a band meet in one bucket. Two sets at the least similarity
of 0.8 miss each other in all 64 bands of 6 registers with a probability of 4e-9. A pair is
held against its registers: the numbers of greater, smaller and equal ones are one sample of a
multinomial law in the similarity, given both sizes; a pair is dropped when even its likelihood
at the threshold is less than e^-20 of the greatest one. What is left is verified on full sets.

Documents with equal sets are one set. Buckets are never paired in full: each set is
compared with its buckets' leaders only, the sets that meet most others. What two sets share
with a common leader bounds their overlap, but for elements outside it: so the only pairs left
are of sets that have such an element in common, or are smaller than the leader by enough. Of those,
pairs not yet in one component are held against their registers, then verified. No bucket, group
or component is capped or collected.

Defined results: null texts and texts without words have an empty set, linked with nothing,
and are their own component; a null id never names a component unless all its ids are null;
repeated rows and ids are rows of their own with equal results; an empty table gives an empty
result; columns are selected by name, others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwire.llm.common import among, arrow_map, importable, slices, temporary, text_bytes, written
from tripwire.llm.graph import components
from tripwire.llm.jaccard import WordHashes, mix, shingles

BANDS, WIDTH = 64, 6
REGISTERS = BANDS * WIDTH
#: Registers count powers of this base from ``SCALE`` down; 16 bits hold sets of up to 1e27 elements.
BASE, SCALE, TOP = 1.001, 20.0, 65535
#: A pair is dropped when its log-likelihood at the threshold is by so much below the best.
DOUBT = 20.0
_POINTS = 1 << 14


# sketches ----------------------------------------------------------------------
def _points(elements: np.ndarray, turn: int, count: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each element its next ``count`` points from number ``turn`` on: waits and registers."""
    number = np.arange(turn, turn + count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    r = mix(elements[:, None] ^ mix(number + np.uint64(1))[None, :])
    wait = -np.log(((r & np.uint64((1 << 40) - 1)).astype(np.float64) + 0.5) / (1 << 40)) / m
    return wait, ((r >> np.uint64(40)) % np.uint64(m)).astype(np.int64)


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """A row of registers for each set of 64-bit hashes; zeros for an empty one. The registers depend on the
    set alone, not on the sets beside it."""
    least = np.full(len(sets) * m, np.inf)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets).astype(np.uint64) if len(of) else np.zeros(0, np.uint64)
    time, turn = np.zeros(len(of)), 0
    while len(of):
        count = int(np.clip(_POINTS // len(of), 1, 64))
        wait, where = _points(elements, turn, count, m)
        moments = np.cumsum(np.concatenate([time[:, None], wait], axis=1), axis=1)[:, 1:]
        np.minimum.at(least, (of[:, None] * m + where).ravel(), moments.ravel())
        time, turn = moments[:, -1], turn + count
        sets_left, inverse = np.unique(of, return_inverse=True)
        late = least.reshape(-1, m)[sets_left].max(axis=1)
        go_on = time < late[inverse]
        elements, of, time = elements[go_on], of[go_on], time[go_on]
    with np.errstate(divide="ignore"):
        k = np.floor(1 + (np.log(SCALE) - np.log(least)) / np.log(BASE))
    return np.clip(k, 0, TOP).astype(np.uint16).reshape(len(sets), m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def cardinality(regs: np.ndarray) -> np.ndarray:
    """Estimated number of elements, by rows of registers."""
    m = regs.shape[-1]
    sums = np.power(BASE, -regs.astype(np.float64)).sum(axis=-1)
    return np.where(regs.any(axis=-1), m * (1 - 1 / BASE) / (SCALE * np.log(BASE) * sums), 0.0)


def _likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, greater: np.ndarray, smaller: np.ndarray, equal: np.ndarray) -> np.ndarray:
    def share(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    p, q = share(u - v * j), share(v - u * j)
    return greater * np.log(p) + smaller * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-12, 1))


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """For rows of registers and sizes (true or estimated): the Jaccard similarity of greatest likelihood, and how
    far the log-likelihood of ``at`` lies below it (0 where the estimate is beyond ``at``)."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    greater, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    counts = (greater, smaller, a.shape[1] - greater - smaller)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(48):  # the likelihood has one peak
        x, y = high - golden * (high - low), low + golden * (high - low)
        left = _likelihood(x, u, v, *counts) > _likelihood(y, u, v, *counts)
        low, high = np.where(left, low, x), np.where(left, y, high)
    best = (low + high) / 2
    if at is None:
        return best, None
    at_ = np.minimum(at, np.minimum(u / v, v / u))
    return best, np.where(best >= at, 0.0, _likelihood(best, u, v, *counts) - _likelihood(at_, u, v, *counts))


def sketches(texts: DataFrame, n: int = 4) -> DataFrame:
    """Per row of ``(id, digest, text)``: ``(id, digest, key, n, registers)``: a hash of the set, its size and its
    registers as bytes (null for an empty set)."""
    schema = f"id {texts.schema['id'].dataType.simpleString()}, digest long, key long, n int, registers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in slices(batches, 2, 2 << 20):
            sets = [shingles(t, n, known) for t in b.column(2).to_pylist()]
            keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            regs = [r.tobytes() if len(s) else None for s, r in zip(sets, registers(sets), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys), pa.array([len(s) for s in sets], pa.int32()), pa.array(regs, pa.binary())],
                                             ["id", "digest", "key", "n", "registers"])

    return arrow_map(texts, run, schema)


def merged(rows: DataFrame, by: str) -> DataFrame:
    """``(by, registers, n)`` of the unions of the sets of each value of ``by``, with the estimated number of
    distinct elements; every task merges its rows of a value first, so that a value of any weight is one row a task."""
    kind = rows.schema[by].dataType.simpleString()
    importable(rows.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), group), pa.array([r.tobytes() for r in held.values()], pa.binary())], [by, "registers"])

        for b in batches:
            group = b.schema.field(0).type
            for value, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                regs = np.frombuffer(raw, np.uint16)
                held[value] = merge(held[value], regs) if value in held else regs
            if len(held) > 1 << 14:
                yield out()
                held = {}
        if held:
            yield out()

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        regs = np.stack([np.frombuffer(r, np.uint16) for r in group.column("registers").to_pylist()]).max(axis=0)
        return pa.table({by: group.column(by).slice(0, 1), "registers": pa.array([regs.tobytes()], pa.binary()), "n": pa.array([float(cardinality(regs))])})

    parts = arrow_map(rows.filter("registers is not null").select(by, "registers"), partial, f"`{by}` {kind}, registers binary")
    return parts.groupBy(by).applyInArrow(whole, f"`{by}` {kind}, registers binary, n double")


# pairs -------------------------------------------------------------------------
def _index(sets: DataFrame) -> DataFrame:
    """``(token, key, n, c, lead)``: the buckets of at least two sets, and each one's leader: the set that meets
    most others over all its buckets. In a family of copies that is the text that they were made from, or one
    close to it, so that most of the others are linked to it."""
    token = F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("registers", 2 * WIDTH * k + 1, 2 * WIDTH)) for k in range(BANDS)]))
    rows = sets.select("key", "n", token.alias("token"))
    with temporary(sets.sparkSession):
        counts = written(rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "counts")
        held = written(among(rows, "token", counts.select("token")).join(counts, "token"), "held")
        met = held.groupBy("key").agg(F.sum("c").alias("met"))
        held = written(held.join(met, "key"), "met")
        leads = held.groupBy("token").agg(F.max(F.struct("met", "key")).alias("l")).select("token", F.col("l.key").alias("lead"))
        return written(held.join(leads, "token"), "buckets", keep=True)


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of set keys that their registers do not rule out; written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                piece = b.slice(at, 4096)
                regs = [np.frombuffer(b"".join(piece.column(c).to_pylist()), np.uint16).reshape(piece.num_rows, -1) for c in (4, 5)]
                sizes = [piece.column(c).to_numpy().astype(np.float64) for c in (2, 3)]
                _, below = similarity(*regs, *sizes, at=percent / 100)
                on = pa.array(below <= DOUBT)
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(on), piece.column(1).filter(on)], ["a", "b"])

    with temporary(sets.sparkSession):
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
        known = written(among(sets.select("key", "n", "registers"), "key", wanted), "known")
        both = pairs
        for side in "ab":
            both = both.join(known.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}")), side)
        both = both.filter(_sizes_fit("n_a", "n_b", percent)).select("a", "b", "n_a", "n_b", "r_a", "r_b")
        return written(arrow_map(both, run, "a long, b long"), "likely", keep=True)


def compared(pairs: DataFrame, sets: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Per pair ``(a, b)`` of set keys (written), by their full sets, which are made anew from one text each: sizes,
    ``shared`` (elements of both) and ``outside``, the elements of ``a`` outside ``b``; written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = WordHashes(), set()
        for b in slices(batches, 1):
            keys, found = [], []
            for digest, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest not in done:
                    done.add(digest)
                    s = shingles(t, n, known)
                    keys.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                    found.append(s.view(np.int64))
            offsets = np.r_[0, np.cumsum([len(s) for s in found])].astype(np.int32)
            members = pa.ListArray.from_arrays(offsets, np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), members], ["key", "members"])

    with temporary(sets.sparkSession):
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
        digests = written(among(sets.select("key", "digest"), "key", wanted).select("digest"), "digests")
        full = arrow_map(among(texts, "digest", digests).select("digest", "text"), run, "key long, members array<long>")
        full = written(full.dropDuplicates(["key"]), "full")
        both = pairs.select("a", "b").join(full.select(F.col("key").alias("b"), F.col("members").alias("of_b")), "b").join(
            full.select(F.col("key").alias("a"), F.col("members").alias("of_a")), "a")
        n_a = F.size("of_a")
        both = both.select("a", "b", n_a.alias("n_a"), F.size("of_b").alias("n_b"), F.array_except("of_a", "of_b").alias("outside"))
        both = both.withColumn("shared", F.col("n_a") - F.size("outside"))
        return written(both.select("a", "b", "n_a", "n_b", "shared", "outside"), "compared", keep=True)


def _linked(found: DataFrame, percent: int) -> DataFrame:
    return found.filter((100 + percent) * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _stars(index: DataFrame) -> DataFrame:
    """Each set with the leaders of its buckets, and whether a bucket of theirs holds further sets; written."""
    pairs = index.filter("key != lead").groupBy(F.col("key").alias("a"), F.col("lead").alias("b")).agg(F.max("c").alias("c"))
    return written(pairs.select("a", "b", (F.col("c") > 2).alias("crowded")), "stars")


def _open_pairs(stars: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be linked among the sets that share a bucket's leader, if no chain of links joins them yet.

    Let x and y have ``shared`` elements with the leader. Without a common element outside the leader their overlap is at most the
    lesser ``shared``: only pairs whose sizes are small enough for it remain. With one, their common elements
    outside it are at least ``percent`` of a set less its ``shared``: in one order, those that fewest sets of the leader have
    first, they have one early enough in both.
    """
    found = stars.select(F.col("b").alias("lead"), F.col("a").alias("key"), F.col("n_a").alias("n"), "shared", "outside")
    found = found.join(roots.select("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = found.groupBy("lead").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("lead")
    found = written(found.join(mixed, "lead", "left_semi"), "members")
    rows = found.select("lead", "key", "n", "root", "shared", F.explode("outside").alias("element"))
    held = rows.groupBy("lead", "element").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("c"))
    # Elements of one component alone are common to no pair that is still open.
    several = written(held.filter("r0 != r1").select("lead", "element", "c"), "several")
    rows = rows.join(several, ["lead", "element"])
    least = F.greatest(F.lit(1), F.ceil(percent * F.col("n") / 100).cast("int") - F.col("shared"))
    own = Window.partitionBy("lead", "key").orderBy("c", "element")
    # How many elements there are from this one on: of those in common, this being the first, not more.
    rows = rows.withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("lead", "key")) - F.row_number().over(own) + 1)
    rows = written(rows.filter(F.col("left") >= least).select("lead", "key", "n", "root", "shared", "element", "left"), "elements")
    x, y = rows.alias("x"), rows.alias("y")
    # At their first common element outside the leader, what is left of both and the lesser ``shared`` bound the overlap.
    overlap = F.least("x.left", "y.left") + F.least("x.shared", "y.shared")
    fit = (100 + percent) * overlap >= percent * (F.col("x.n") + F.col("y.n"))
    by_element = x.join(y, (F.col("x.lead") == F.col("y.lead")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.key") < F.col("y.key")) &
                        (F.col("x.root") != F.col("y.root")) & fit).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    # The greatest size of a set that overlaps a member in its shared elements alone.
    most = F.floor((100 + percent) * F.col("shared") / percent).cast("int") - F.col("n")
    sized = found.select("lead", "key", "n", "root", most.alias("most"))
    sizes = found.select("lead", F.col("n").alias("size")).distinct()
    small = sized.join(sizes, "lead").filter((F.col("size") <= F.col("most")) & _sizes_fit("n", "size", percent))
    u, v = small.alias("u"), sized.alias("v")
    by_size = u.join(v, (F.col("u.lead") == F.col("v.lead")) & (F.col("u.size") == F.col("v.n")) & (F.col("u.root") != F.col("v.root")) & (F.col("u.n") <= F.col("v.most")))
    by_size = by_size.select(F.least("u.key", "v.key").alias("a"), F.greatest("u.key", "v.key").alias("b"))
    return written(by_element.union(by_size).distinct(), "open")


def _classes(texts: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per row ``(id, key, n)``, and the least id ``(key, component)`` of the components of more than one row."""
    rows = written(sketches(texts, n), "sketches")
    sets = rows.filter("n > 0").groupBy("key").agg(
        F.first("n").alias("n"), F.first("registers").alias("registers"), F.min("digest").alias("digest"), F.min("id").alias("least"), F.count(F.lit(1)).alias("docs"))
    sets = written(sets, "sets")
    stars = _stars(_index(sets))
    # Pairs that their registers rule out are left alone, but for crowded buckets, which are sorted by what their sets
    # have in common with the leader.
    crowded = stars.filter("crowded").select("a", "b")
    some = written(crowded.union(likely(stars.filter("not crowded").select("a", "b"), sets, percent)), "some")
    found = compared(some, sets, texts, n, percent)
    links = _linked(found, percent)
    rest = likely(_open_pairs(found, components(links), percent), sets, percent)
    more = _linked(compared(rest, sets, texts, n, percent), percent)
    roots = components(links.union(more))
    in_class = sets.select("key", "least", "docs").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    in_class = written(in_class.select("key", "least", "docs", "root"), "classes")
    least = in_class.groupBy("root").agg(F.min("least").alias("component"), F.sum("docs").alias("docs")).filter("docs > 1")
    named = in_class.select("key", "root").join(least.select("root", "component"), "root").select("key", "component")
    return written(rows.select("id", "key", "n"), "rows", keep=True), written(named, "named", keep=True)


def near_duplicates(df: DataFrame, n: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_shingles`` (size of its set), ``component_id`` (the least id that links reach) and
    ``kept`` (the row's id is the least)."""
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), text_bytes(F.col(text_col)).alias("text"))
    with temporary(df.sparkSession):
        rows, named = _classes(texts, n, percent)
    named = named.withColumn("shared", F.lit(True))
    component = F.when(F.col("shared"), F.col("component")).otherwise(F.col("id"))
    out = rows.select("id", "key", "n").join(named, "key", "left").withColumn("component", component)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("component")).alias("kept"))
