"""T3/T5 with a gazetteer of any size: names as a table that is never collected.

A name can only begin where a token of the text begins: a run of word characters, or a
single other character that no word character precedes. So texts are cut into windows, these
into tokens, and a token meets the names that begin with it in a join, broadcast in rounds of
a fixed number of names; only where one does, its place is summed up and the text there
compared. What follows decides whether a name is there. A token's row holds its window, never
its text: a window has a fixed number of characters in which names begin, and after them what
the longest name may reach. Of the names at one place the longest counts, and
places are taken from left to right, each from the end of the last: the spans are
those of the compiled pattern (:func:`tripwire.operators.text.annotate_entities`).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.functions.core import WORD, with_computed
from tripwire.operators.text import SPAN_TYPE, sentence_main, split_sentences
from tripwire.session import reliable_checkpoint

# Names in one broadcast (some 100 MB); more are met in further rounds, each a pass over the texts.
NAMES_PER_ROUND = 1_000_000
# Characters of a window in which names begin; as many as the longest name has, if those are more.
WINDOW = 512
_HEAD = rf"({WORD}+|[^{WORD[1:-1]}])"


def name_index(names: DataFrame, labels: Iterable[str] = ("PERSON",)) -> DataFrame:
    """``(head, name, size, label)`` of a table ``(name, label)``: each name once, with its first token and the first
    of ``labels`` that it has. Checkpointed."""
    labels = list(labels)
    ranked = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    known = names.where(F.col("label").isin(*labels) & (F.col("name") != "")).groupBy("name").agg(F.min(ranked).alias("_rank"))
    label = F.get(F.array(*[F.lit(x) for x in labels]), (F.col("_rank") - 1).cast("int"))
    return reliable_checkpoint(known.select(F.regexp_extract("name", f"^{_HEAD}", 1).alias("head"), "name", F.length("name").alias("size"), label.alias("label")))


def name_spans(rows: DataFrame, key: Sequence[str], text_col: str, index: DataFrame, names_per_round: int = NAMES_PER_ROUND) -> DataFrame:
    """``(*key, spans)`` for the rows whose text holds a name; ``key`` tells the rows apart, ``index`` is of :func:`name_index`."""
    n, longest = index.agg(F.count(F.lit(1)), F.max("size")).first()
    if not n:
        return rows.select(*key, F.array().cast(SPAN_TYPE).alias("spans")).limit(0)
    rounds = -(-n // names_per_round)
    index = index.withColumn("worded", F.col("head").rlike(WORD))
    step = max(WINDOW, longest)
    # A window begins with the character before it (a space before the text) and ends with the one after the longest name.
    windows = F.regexp_extract_all(F.concat(F.lit(" "), F.col(text_col)), F.lit(rf"(?s)(?=(.{{1,{step + longest + 1}}}+)).{{1,{step}}}+"), 1)
    cut = rows.select(*key, F.posexplode(windows).alias("_w", "_text"))
    cut = with_computed(cut, "_tokens", F.regexp_extract_all("_text", F.lit(_HEAD), 1))
    # The first token is, or begins with, the character before the window.
    tokens = cut.select(*key, "_w", "_text", "_tokens", F.posexplode("_tokens").alias("_i", "head")).where("_i > 0")
    # Where a token meets a name: its place in the window, and whether the name stands there.
    place = F.length(F.array_join(F.slice("_tokens", F.lit(1), F.col("_i")), ""))
    starts = F.col("worded") | ~F.get("_tokens", F.col("_i") - 1).rlike(WORD)
    here = F.substring(F.col("_text"), F.col("_at") + 1, F.col("size"))
    follows = F.substring(F.col("_text"), F.col("_at") + F.col("size") + 1, F.lit(1))
    there = starts & (F.col("_at") <= step) & (here == F.col("name")) & ~follows.rlike(WORD)
    at = (F.col("_w") * step + F.col("_at") - 1).cast("int").alias("at")
    found = None
    for k in range(rounds):
        part = index.where(F.pmod(F.xxhash64("head"), F.lit(rounds)) == k) if rounds > 1 else index
        hits = with_computed(tokens.join(F.broadcast(part), "head"), "_at", place).where(there).select(*key, at, "size", "label")
        found = hits if found is None else found.unionByName(hits)
    # A text's hits; of those at one place the longest comes first.
    per_row = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("size")).alias("less"), "label"))).alias("_hits"))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast(SPAN_TYPE).alias("out"))

    def take(acc: Column, h: Column) -> Column:
        end = h["at"] - h["less"]
        span = F.struct(h["at"].alias("start"), end.alias("end"), h["label"].alias("label"))
        return F.when(h["at"] < acc["end"], acc).otherwise(F.struct(end.alias("end"), F.concat(acc["out"], F.array(span)).alias("out")))

    return per_row.select(*key, F.aggregate("_hits", empty, take, lambda acc: acc["out"]).cast(SPAN_TYPE).alias("spans"))


def annotate_names(df: DataFrame, key: Sequence[str], text_col: str, names: DataFrame, labels: Iterable[str] = ("PERSON",),
                   out_col: str = "spans", names_per_round: int = NAMES_PER_ROUND) -> DataFrame:
    """T3 for whole texts: ``df`` with its names' spans; ``key`` tells its rows apart."""
    found = name_spans(df, key, text_col, name_index(names, labels), names_per_round).withColumnRenamed("spans", "_found")
    spans = F.when(F.col(text_col).isNotNull(), F.coalesce("_found", F.array().cast(SPAN_TYPE)))
    return _with(df, found, key).withColumn(out_col, spans).drop("_found")


def annotate_sentences_by_names(df: DataFrame, key: Sequence[str], text_col: str, names: DataFrame, labels: Iterable[str] = ("PERSON",),
                                sentences_col: str = "sentences", out_col: str = "sentence_spans", names_per_round: int = NAMES_PER_ROUND) -> DataFrame:
    """T1 and T3 for T5, as :func:`tripwire.operators.text.annotate_sentences`, with a table of names; ``key`` tells the rows apart."""
    sents = F.coalesce(split_sentences(text_col), F.array().cast("array<string>"))
    mains = df.select(*key, F.posexplode(sents).alias("_s", "_sentence")).select(*key, "_s", sentence_main("_sentence").alias("_main"))
    found = name_spans(mains, [*key, "_s"], "_main", name_index(names, labels), names_per_round)
    per_row = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_s", "spans"))).alias("_found"))
    joined = _with(df, per_row, key).withColumn(sentences_col, sents)
    none = F.array().cast(SPAN_TYPE)
    spans = F.transform(sentences_col, lambda s, i: F.coalesce(F.try_element_at("_found", i), none))
    return joined.withColumn(out_col, spans).drop("_found")


def _with(df: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    named = found.withColumnsRenamed({k: f"_key_{k}" for k in key})
    same = [df[k].eqNullSafe(named[f"_key_{k}"]) for k in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(named, on, "left").drop(*[f"_key_{k}" for k in key])
