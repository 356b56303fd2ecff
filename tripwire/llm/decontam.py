"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are ``[0-9A-Za-z]`` and non-ASCII characters, A-Z lower-cased. Every window of
``n`` consecutive item words (all words of a shorter item) is hashed; the distinct
windows go to every executor, in rounds of a fixed number of windows, so that what is
broadcast is bounded whatever the benchmark's size. One scan of the documents hashes
the windows at each position, probes the set and verifies hits word by word. Only
hits are shuffled.

DataFrame functions only. Defined results: null or blank texts have no words and no
hits; items without words, or with a null id, are ignored; repeated item rows are one
item; repeated document rows each get their full result; documents are told apart by
id and text, so a null or repeated id is no harm; empty tables give empty results or
clean documents; columns are selected by name, others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import fresh, parted, written

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows in one broadcast: below 100 bytes each for ten words of usual length.
WINDOWS_PER_ROUND = 500_000


def raw_words(text: Column) -> Column:
    """Words of a text, letters as they are."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _GAP, -1), "")


def _phrase(words: Column, start: Column | int, length: Column) -> Column:
    """Normalised words ``start`` (from 0) and following as one string; blanks only between words."""
    return F.translate(F.array_join(F.slice(words, start + 1, length), " "), _UPPER, _LOWER)


def item_windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``(item, len, phrase)``: every window of ``n`` words, or the whole shorter item."""
    words = items.select(F.col(id_col).cast("string").alias("item"), raw_words(F.col(text_col)).alias("words"))
    sized = words.filter("item is not null and size(words) > 0").withColumn("len", F.least(F.size("words"), F.lit(n)))
    at = sized.select("item", "words", "len", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("p"))
    return at.select("item", "len", _phrase(F.col("words"), F.col("p"), F.col("len")).alias("phrase")).distinct()


def find_hits(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
              windows_per_round: int = WINDOWS_PER_ROUND) -> tuple[DataFrame, DataFrame]:
    """``(hits, windows)``: ``(id, digest, p, len, phrase)`` for each document position where a
    window occurs, ``digest`` being the text's hash, and the windows with their items."""
    windows = written(item_windows(items, n), "windows")
    by_len = {r["len"]: r["count"] for r in windows.select("len", "phrase").distinct().groupBy("len").count().collect()}
    rounds = max(1, math.ceil(sum(by_len.values()) / windows_per_round))

    def word_hashes(words: Column) -> Column:
        return F.transform(words, lambda w: F.xxhash64(F.lower(w)))

    def hashed(words: list[Column], length: int) -> Column:
        return F.xxhash64(F.lit(length), *words)

    # Windows are hashed over the hashes of Unicode-lower-cased words, each made once; those are
    # equal whenever the normalised words are. The phrase then decides.
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), raw_words(F.col(text_col)).alias("raw"))
    words = split.withColumn("words", word_hashes(F.col("raw")))
    p = F.col("p")
    probes = []
    for length in sorted(by_len):
        h = hashed([F.get("words", p + k) for k in range(length)], length)
        probes.append(F.when(p + length <= F.size("words"), F.struct(F.lit(length).alias("len"), h.alias("h"))))
    at = words.select("id", "digest", "raw", "words", F.explode(F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))).alias("p"))
    if not probes:
        empty = words.select("id", "digest", F.lit(0).alias("p"), F.lit(0).alias("len"), F.lit("").alias("phrase"))
        return empty.limit(0), windows
    if len(probes) == 1:
        probed = at.select("id", "digest", "raw", "p", probes[0].alias("probe"))
    else:
        probed = at.select("id", "digest", "raw", "p", F.explode(F.array(*probes)).alias("probe"))
    probed = probed.select("id", "digest", "raw", "p", F.col("probe.len").alias("len"), F.col("probe.h").alias("h"))

    phrase = F.col("words")
    set_hash = None
    for length in sorted(by_len):
        h = hashed([F.get(phrase, F.lit(k)) for k in range(length)], length)
        set_hash = F.when(F.col("len") == length, h) if set_hash is None else set_hash.when(F.col("len") == length, h)
    grams = windows.select("len", "phrase").distinct().withColumn("words", word_hashes(F.split("phrase", " ", -1)))
    grams = grams.select(set_hash.alias("h"), F.col("len").alias("w_len"), "phrase")
    hits = None
    for k in range(rounds):
        part = grams.filter(F.pmod("h", F.lit(rounds)) == k) if rounds > 1 else grams
        # Within coalesce the phrase is no join key: it is only made where the hashes are equal.
        same = F.coalesce((F.col("len") == F.col("w_len")) & (_phrase(F.col("raw"), p, F.col("len")) == F.col("phrase")), F.lit(False))
        found = probed.join(F.broadcast(part), "h").filter(same)
        found = found.select("id", "digest", "p", "len", "phrase")
        hits = found if hits is None else hits.unionByName(found)
    return written(hits, "hits"), windows


def _covered(spans: Column) -> Column:
    """Number of positions inside any of the sorted ``(p, len)`` spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["p"] + s["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["p"]))).alias("n"),
                        F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def hit_spans(hits: DataFrame) -> DataFrame:
    """Per document with hits: sorted ``(p, len)`` spans, at most as many as it has words and lengths."""
    return hits.groupBy("id", "digest").agg(F.array_sort(F.collect_set(F.struct("p", "len"))).alias("spans"))


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & left["digest"].eqNullSafe(right["digest"])


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: ``id_col``, ``n_words``, ``n_hit`` (words inside any window), ``n_items``,
    ``items`` (sorted ids of the items found) and ``contaminated``."""
    hits, windows = find_hits(docs, items, n, id_col, text_col)
    spans = hit_spans(hits).select("id", "digest", _covered(F.col("spans")).alias("n_hit"))
    named = hits.select("id", "digest", "phrase").distinct().join(windows.select("phrase", "item"), "phrase")
    found = named.groupBy("id", "digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = spans.join(found, _same(spans, found)).select(spans["id"], spans["digest"], "n_hit", "items")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"),
                       F.size(raw_words(F.col(text_col))).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items_ = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.join(both, _same(rows, both), "left").select(
        rows["id"].alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        items_.alias("items"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, mode: str = "documents", id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns: without the contaminated documents (``mode="documents"``), or
    with the hit words and the gap after each cut out of the text (``mode="spans"``)."""
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    hits, _ = find_hits(docs, items, n, id_col, text_col)
    digest, key, key_id, at = fresh(docs, "digest_", "hit_digest_", "hit_id_", "hit_spans_")
    rows = docs.withColumn(digest, F.xxhash64(F.col(text_col)))
    # Whole texts are moved only where they may have a hit.
    rows, clean = parted(rows, digest, written(hits.select("digest").distinct(), "hit-digests"))
    spans = hit_spans(hits).select(F.col("id").alias(key_id), F.col("digest").alias(key), F.col("spans").alias(at))
    same = F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(digest) == F.col(key))
    if mode == "documents":
        return rows.join(spans.drop(at), same, "left_anti").unionByName(clean).drop(digest)
    words = raw_words(F.col(text_col))
    gaps = F.split(F.col(text_col), _WORD, -1)
    cut = F.flatten(F.transform(F.col(at), lambda s: F.sequence(s["p"], s["p"] + s["len"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(words) - 1), cut)
    pieces = F.transform(F.arrays_zip(words.alias("w"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("g")), lambda x: F.concat(x["w"], x["g"]))
    text = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(kept, lambda i: F.get(pieces, i)), ""))
    joined = rows.join(spans, same, "left")
    joined = joined.withColumn(text_col, F.when(F.col(at).isNull(), F.col(text_col)).otherwise(text))
    return joined.select(*docs.columns).unionByName(clean.select(*docs.columns))
