"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct word shingles (A-Z lower-cased words between ASCII
blanks; a text of fewer words is one shingle). Two sets are linked when
``100 * |intersection| >= percent * |union|``.

All sets are put in one order, rarest shingles first by a count sketch over the whole
corpus (any order is right; this one keeps passages that many documents share out of
the prefixes), and cut to the prefix that linked sets must share a shingle of. Documents
with equal sets are one set; sets with identical prefixes and size are one group. An
inverted index over the groups' prefix shingles gives group pairs, filtered by size,
position and a parity bitmap that bounds the overlap from above; they are expanded to
their members and verified exactly.

Components come in two rounds, as all pairs within a large family of near copies are
never needed: each index list is first verified against one leader only; then every pair
in a list whose sets are not yet in one component is verified. No list, group or
component is capped or collected.

Defined results: null texts and texts without words have an empty set, linked with
nothing, and are their own component; a null id never names a component unless all its
ids are null; repeated rows and repeated ids are rows of their own with equal results;
an empty table gives an empty result; further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import among, arrow_map, fresh, parted, slices, temporary, text_bytes, written
from tripwire.llm.graph import components

_SLOTS = 1 << 20  # of the sketch: fixed, whatever the corpus
_CHUNK = 1 << 12  # slots in one row of the sketch
_BITS = 512
_LANES = [f"b{i}" for i in range(_BITS // 64)]
#: Sets of more shingles, for which the short bitmap bounds nothing, have a long one too.
_LONG_FROM, _LONG_BITS = 1200, 8192
_WORDS_KEPT = 300_000
#: Bytes of text cut into words at a time.
_PIECE = 2 << 20


class WordHashes(dict):
    """Hashes of words, looked up far more often than made."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.lower().split()  # of bytes: A-Z and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > _WORDS_KEPT:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), text_bytes(F.col(text_col)).alias("text"))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def sketch(texts: DataFrame, n: int) -> np.ndarray:
    """How many documents' shingles fall in each slot, over all documents. Every task sends its
    counts in rows of a fixed size; what comes to the driver is the sketch alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(_SLOTS, np.int32), WordHashes()
        for b in slices(batches, 0, _PIECE):
            hashes = [shingles(t, n, known) for t in b.column(0).to_pylist()]
            if hashes:
                total += np.bincount(_slot(np.concatenate(hashes)), minlength=_SLOTS).astype(np.int32)
        rows = [(k, c) for k, c in enumerate(total.reshape(-1, _CHUNK)) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([c.tobytes() for _, c in rows], pa.binary())], ["chunk", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.int64)
        for c in rows.column("counts").to_pylist():
            total += np.frombuffer(c, np.int32)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((_SLOTS // _CHUNK, _CHUNK), np.int64)
    for row in arrow_map(texts.select("text"), count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        out[row["chunk"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def _order(counts: np.ndarray) -> np.ndarray:
    """Counts squeezed to 16 bits that keep their order up to 2 percent."""
    return np.minimum(np.log2(counts + 1.0) * 1000, 65535).astype(np.uint16)


def prefixes(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Per document row: id, digest of the text, key and size of its set, its group (size and
    prefix), parity bitmap, and the prefix in order. Written once, read by the later steps."""
    rare = texts.sparkSession.sparkContext.broadcast(_order(sketch(texts, n)))
    schema = "id {}, digest long, key long, n int, gid long, {}, prefix array<long>, long_bits array<long>".format(
        texts.schema["id"].dataType.simpleString(), ", ".join(f"{x} long" for x in _LANES))

    def parity(h: np.ndarray, bits: int) -> np.ndarray:
        odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
        return np.packbits(odd).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, known = rare.value, WordHashes()
        for b in slices(batches, 2, _PIECE):
            keys, sizes, gids, lanes, heads, longs = [], [], [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingles(t, n, known)
                size = len(h)
                head = np.zeros(0, np.uint64)
                if 100 * size >= percent * (size + 1):  # else only an equal set can be linked
                    length = size - -(-percent * size // 100) + 1
                    head = h[np.argsort(order[_slot(h)], kind="stable")[:length]]
                keys.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                gids.append(xxhash.xxh3_64_intdigest(head.tobytes(), seed=size) if len(head) else keys[-1])
                sizes.append(size)
                lanes.append(parity(h, _BITS))
                longs.append(parity(h, _LONG_BITS).tolist() if size > _LONG_FROM else None)
                heads.append(head.view(np.int64))
            lanes_ = np.stack(lanes) if lanes else np.zeros((0, len(_LANES)), np.int64)
            offsets = np.r_[0, np.cumsum([len(x) for x in heads])].astype(np.int32)
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, gids)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), signed[0], pa.array(sizes, pa.int32()), signed[1],
                 *[pa.array(lanes_[:, k].copy()) for k in range(len(_LANES))],
                 pa.ListArray.from_arrays(offsets, np.concatenate(heads) if heads else np.zeros(0, np.int64)), pa.array(longs, pa.list_(pa.int64()))],
                ["id", "digest", "key", "n", "gid", *_LANES, "prefix", "long_bits"])

    return written(arrow_map(texts, run, schema), "prefixes")


# pairs -------------------------------------------------------------------------
def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _positions_fit(x: str, y: str, percent: int) -> Column:
    """Whether the shingles from here on can make up the overlap of linked sets (no earlier one is shared)."""
    n1, n2, p1, p2 = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
    return (100 + percent) * F.least(n1 - p1, n2 - p2) >= percent * (n1 + n2)


def _bounded(n1: Column, n2: Column, differ: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked when so many parity bits differ. Each such bit is an
    element of one set only, so the overlap is at most half of the sizes less the differing bits."""
    return (100 + percent) * (n1 + n2 - differ) >= 2 * percent * (n1 + n2)


def _plausible(pairs: DataFrame, members: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` whose sizes and parity bitmaps allow a link; written."""
    with temporary(rows.sparkSession):
        return _bounded_pairs(pairs, members, rows, percent)


def _bounded_pairs(pairs: DataFrame, members: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    narrow = members.select("key", "n", *_LANES)
    for side in "ab":
        named = narrow.select(*[F.col(c).alias(f"{side}_{c}") for c in narrow.columns]).withColumnRenamed(f"{side}_key", side)
        pairs = pairs.join(named, side)
    differ = sum((F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in _LANES[1:]),
                 F.bit_count(F.col("a_b0").bitwiseXOR(F.col("b_b0"))))
    n1, n2 = F.col("a_n"), F.col("b_n")
    pairs = written(pairs.filter(_sizes_fit(n1, n2, percent) & _bounded(n1, n2, differ, percent)).select("a", "b", "a_n", "b_n"), "bounded")
    long = F.least(n1, n2) > _LONG_FROM
    longs = rows.filter("long_bits is not null").select("key", "long_bits").dropDuplicates(["key"])
    both = pairs.filter(long)
    for side in "ab":
        wanted = both.select(F.col(side).alias("key")).distinct()
        both = both.join(longs.join(wanted, "key", "left_semi").select(F.col("key").alias(side), F.col("long_bits").alias(f"{side}_bits")), side)
    differ = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return written(pairs.filter(~long).select("a", "b").union(both.filter(_bounded(n1, n2, differ, percent)).select("a", "b")), "pairs", keep=True)


def _verified(pairs: DataFrame, members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (written), by their whole sets, which are made anew from one text each."""
    if pairs.isEmpty():
        return pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = WordHashes(), set()
        for b in slices(batches, 1, _PIECE):
            keys, sets = [], []
            for digest, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest not in done:
                    done.add(digest)
                    h = shingles(t, n, known)
                    keys.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                    sets.append(h.view(np.int64))
            offsets = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, np.concatenate(sets) if sets else np.zeros(0, np.int64))],
                ["key", "members"])

    with temporary(texts.sparkSession):
        keys = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
        digests = written(among(members.select("key", "digest"), "key", keys).select("digest"), "digests")
        sets = arrow_map(among(texts, "digest", digests).select("digest", "text"), run, "key long, members array<long>")
        sets = written(sets.dropDuplicates(["key"]), "sets")
        of_b = sets.join(pairs.select(F.col("b").alias("key")).distinct(), "key", "left_semi")  # the leaders of many pairs
        first = pairs.join(of_b.select(F.col("key").alias("b"), F.col("members").alias("of_b")), "b")
        both = first.join(sets.select(F.col("key").alias("a"), F.col("members").alias("of_a")), "a")
        shared_n = F.size(F.array_intersect("of_a", "of_b"))
        whole = F.size("of_a") + F.size("of_b")
        return written(both.filter((100 + percent) * shared_n >= percent * whole).select("a", "b"), "links", keep=True)


def _index(rows: DataFrame) -> DataFrame:
    """Prefix shingles shared by at least two groups: ``(token, group, n, pos, lead, lead_n, lead_pos)``,
    the leader being the group in which the shingle stands first. Most prefix shingles are in one group
    alone; only the others enter the shuffles that carry more than a count."""
    with temporary(rows.sparkSession):
        groups = written(rows.filter("size(prefix) > 0").groupBy("gid").agg(
            F.min("key").alias("group"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "groups")
        counts = groups.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
        several = written(counts.filter("c > 1").select("token"), "several")
        tokens = among(groups.select("group", "n", F.posexplode("prefix").alias("pos", "token")), "token", several)
        tokens = written(tokens, "tokens")
        lead = tokens.groupBy("token").agg(F.min(F.struct("pos", "group", "n")).alias("l"))
        lead = written(lead.select("token", F.col("l.group").alias("lead"), F.col("l.n").alias("lead_n"), F.col("l.pos").alias("lead_pos")), "leads")
        return written(tokens.join(lead, "token"), "index", keep=True)


def _members(rows: DataFrame) -> DataFrame:
    """A row for each distinct set, with its group's name, least id and number of documents."""
    sets = rows.filter("n > 0").groupBy("key").agg(
        F.first("gid").alias("gid"), F.first("n").alias("n"), *[F.first(x).alias(x) for x in _LANES], F.min("digest").alias("digest"), F.min("id").alias("least"), F.count(F.lit(1)).alias("docs"))
    with temporary(rows.sparkSession):
        sets = written(sets, "sets")
        named = sets.groupBy("gid").agg(F.min("key").alias("group"), F.count(F.lit(1)).alias("sets"))
        return written(sets.join(written(named, "named"), "gid"), "members", keep=True)


def _open_pairs(index: DataFrame, members: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """Every pair of sets that share an index list or a group, but for pairs within one component.
    In each list the sets outside its largest component are paired with all others."""
    sets = members.select("key", "group", "n", "sets")
    if roots is None:
        sets = sets.withColumn("root", F.col("key"))
    else:
        sets = sets.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lists = index.select("token", "group", "pos").join(sets.select("key", "group", "n", "root"), "group").select("token", "key", "n", "pos", "root")
    own = sets.filter("sets > 1").select(F.col("group").alias("token"), "key", "n", F.lit(0).alias("pos"), "root")
    lists = written(lists.union(own), "lists")
    share = lists.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    most = share.groupBy("token").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    most = written(most.select("token", F.col("m.root").alias("top")), "tops")
    lists = written(lists.join(most, "token"), "open")
    x, y = lists.filter("root != top").alias("x"), lists.alias("y")
    differ = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root"))
    once = (F.col("y.root") == F.col("y.top")) | (F.col("x.key") < F.col("y.key"))
    found = x.join(y, differ & once & _sizes_fit(F.col("x.n"), F.col("y.n"), percent) & _positions_fit("x", "y", percent))
    return found.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def _prepare(df: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    texts = _texts(df, id_col, text_col)
    rows = prefixes(texts, n, percent)
    return texts, rows, _members(rows), _index(rows)


def links(df: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links ``(a, b)`` between different sets, and the membership ``(id, digest, key)`` of documents."""
    with temporary(df.sparkSession):
        texts, rows, members, index = _prepare(df, n, percent, id_col, text_col)
        pairs = _plausible(_open_pairs(index, members, None, percent), members, rows, percent)
        return written(_verified(pairs, members, texts, n, percent), "links", keep=True), written(rows.select("id", "digest", "key"), "rows", keep=True)


def classes(df: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: ``id``, ``digest`` (xxhash64 of the text), ``key`` of its set, ``n`` (set size),
    ``root`` (name of its class; null for an empty set) and ``component``, the least id that links reach."""
    with temporary(df.sparkSession):
        texts, rows, members, index = _prepare(df, n, percent, id_col, text_col)
        to_lead = index.filter("group != lead").filter(_sizes_fit(F.col("n"), F.col("lead_n"), percent))
        star = to_lead.select(F.col("group").alias("a"), F.col("lead").alias("b")).union(
            members.filter("key != group").select(F.col("key").alias("a"), F.col("group").alias("b"))).distinct()
        stars = _verified(_plausible(star, members, rows, percent), members, texts, n, percent)
        roots = components(stars)
        with temporary(df.sparkSession):
            rest = written(_plausible(_open_pairs(index, members, roots, percent), members, rows, percent), "rest", keep=True)
        more = _verified(rest, members, texts, n, percent)
        roots = components(stars.union(more))
        sets = members.select("key", "least", "docs").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        sets = written(sets, "rooted")
        least = written(sets.groupBy("root").agg(F.min("least").alias("component"), F.sum("docs").alias("docs")).filter("docs > 1"), "least")
        named = written(sets.select("key", "root").join(least.select("root", "component"), "root").select("key", "root", "component"), "named", keep=True)
        rows = written(rows.select("id", "digest", "key", "n"), "rows", keep=True)
    return rows.join(named, "key", "left").select(
        "id", "digest", "key", "n", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("root"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def component_ids(df: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: ``id_col``, ``n_shingles`` and ``component_id``."""
    return classes(df, n, percent, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def drop_copies(df: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the same columns and one row of each class: that with the least id (nulls last; then the
    least digest). Rows with empty sets all stay; of rows with equal id and text one stays."""
    with temporary(df.sparkSession):
        rows = written(classes(df, n, percent, id_col, text_col).filter("root is not null").select("root", "id", "digest"), "classes")
        order = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
        first = written(rows.groupBy("root").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "first")
        first = first.select("root", F.col("f.id").alias("f_id"), F.col("f.digest").alias("f_digest"))
        is_first = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest"))
        held = written(rows.join(first, "root").select("id", "digest", is_first.alias("first")), "held", keep=True)
    digest, key_id, key = fresh(df, "digest_", "copy_id_", "copy_digest_")
    same = F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(digest) == F.col(key))

    def named(keys: DataFrame) -> DataFrame:
        return keys.select(F.col("id").alias(key_id), F.col("digest").alias(key))

    # Whole texts are moved only where a copy may have to go.
    rows, alone = parted(df.withColumn(digest, F.xxhash64(F.col(text_col))), digest, held.select("digest"))
    kept = rows.join(named(held.filter("not first").distinct()), same, "left_anti")
    repeated = held.filter("first").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if not repeated.isEmpty():
        repeated = named(repeated)
        kept = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([id_col, digest]))
    return kept.unionByName(alone).drop(digest)
