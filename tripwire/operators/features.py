"""Fixed-length model features and a truncation audit.

The T5 SentencePiece model is not rebuilt (re-aimed): a corpus vocabulary of
word and punctuation tokens stands in. The vocabulary is a word count with
map-side combining and a top-k (the feature: the ``vocab_size`` most frequent
tokens) that never leaves the executors: a histogram of counts tells which
counts are in and how many tokens stand before each; ranks inside one count
are positions by token. Tokens meet their ids in a join, broadcast if the
vocabulary's size allows.
Inputs are cut to ``max_len - 1`` tokens + EOS and padded; targets to
``target_len - 1`` + EOS and padded with -100 (ignored by the loss).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwire.functions.core import SPACE, col
from tripwire.functions.predicates import contains_trigger
from tripwire.operators.joins import join_small
from tripwire.operators.ordinal import with_position
from tripwire.session import reliable_checkpoint

# Special token ids (T5 layout: pad 0, end of sequence 1, unknown 2).
PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
FIRST_ID = 3
LABEL_PAD = -100
# Entries of a vocabulary that is broadcast (some 100 MB); a larger one is joined by a shuffle.
MAX_VOCAB = 1_000_000
# Word runs, or any single other non-space character.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^" + SPACE[1:-1] + r"\p{L}\p{N}_]"


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(col(text), F.lit(TOKEN_PATTERN), 0)


def build_vocab(df: DataFrame, text_col: str, vocab_size: int) -> DataFrame:
    """``(token, id)`` for the ``vocab_size`` most frequent tokens (ties by token), ids from 3."""
    counts = df.select(F.explode(tokens(text_col)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    counts = reliable_checkpoint(counts)
    # One row for each different count: how many tokens are more frequent.
    levels = counts.groupBy("c").agg(F.count(F.lit(1)).alias("level"))
    above = F.coalesce(F.sum("level").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.select("c", above.alias("above")).where(F.col("above") < vocab_size)
    kept = counts.join(levels, "c")
    # Inside one count, by token; tokens of one beginning are in one window.
    ranked = with_position(kept, ["c"], ["token"], F.substring("token", 1, 3), "_rank")
    rank = F.col("above") + F.col("_rank")
    return ranked.where(rank < vocab_size).select("token", (rank + FIRST_ID).cast("int").alias("id"))


def pack_features(df: DataFrame, vocab: DataFrame, key: str, text_col: str = "input",
                  target_col: str | None = "output", max_len: int = 512, target_len: int = 32) -> DataFrame:
    """F4 — ``key`` with ``input_ids``, ``attention_mask`` (``max_len``) and ``labels`` (``target_len``).

    Only the kept tokens (at most ``max_len - 1`` + ``target_len - 1`` per row)
    are looked up. A row's tokens stay in its task up to the join with a broadcast vocabulary, so one array a row
    is what is regrouped; rows with equal keys stay apart. ``target_col`` may be an ``array<string>`` (first
    answer used) or a string; a NULL target gives all-ignored labels.
    """
    none = F.array().cast("array<string>")
    tin = F.coalesce(F.slice(tokens(text_col), 1, max_len - 1), none)
    has_target, tt = F.lit(False), none
    if target_col is not None:
        tc = F.col(target_col)
        if dict(df.dtypes)[target_col].startswith("array"):
            tc = tc[0]
        has_target = tc.isNotNull()
        tt = F.slice(F.coalesce(tokens(tc), none), 1, target_len - 1)
    # Input tokens are numbered from 0, target tokens below it.
    placed = F.concat(F.transform(tin, lambda t, i: F.struct(i.alias("at"), t.alias("token"))),
                      F.transform(tt, lambda t, i: F.struct((-1 - i).alias("at"), t.alias("token"))))
    rows = df.select(F.col(key).alias("_key"), has_target.alias("_has_target"), F.monotonically_increasing_id().alias("_row"), placed.alias("_tokens"))
    rows = rows.select("_key", "_has_target", "_row", F.explode_outer("_tokens").alias("_t")).select("_key", "_has_target", "_row", "_t.at", "_t.token")
    found = join_small(rows, vocab.select("token", "id"), "token", "left", max_rows=MAX_VOCAB)
    one = F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce("id", F.lit(UNK_ID)).alias("id")))
    out = found.groupBy("_row").agg(F.first("_key").alias(key), F.first("_has_target").alias("_has_target"), F.array_sort(F.collect_list(one)).alias("_all"))
    split_at = F.size(F.filter("_all", lambda x: x["at"] < 0))
    ids = F.transform("_all", lambda x: x["id"])
    out = out.select(key, "_has_target", F.slice(ids, split_at + 1, F.size("_all")).alias("_in"), F.reverse(F.slice(ids, F.lit(1), split_at)).alias("_tg"))
    n = F.size("_in")
    m = F.size("_tg")
    cols = [
        key,
        F.concat(F.col("_in"), F.array(F.lit(EOS_ID)), F.array_repeat(F.lit(PAD_ID), max_len - n - 1)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n + 1), F.array_repeat(F.lit(0), max_len - n - 1)).alias("attention_mask"),
    ]
    if target_col is not None:
        cols.append(F.when(~F.col("_has_target"), F.array_repeat(F.lit(LABEL_PAD), target_len)).otherwise(
            F.concat(F.col("_tg"), F.array(F.lit(EOS_ID)), F.array_repeat(F.lit(LABEL_PAD), target_len - m - 1)))
            .alias("labels"))
    return out.select(*cols)


def length_audit(df: DataFrame, phrase: str, max_len: int = 512, text_col: str = "input",
                 by: str = "task") -> DataFrame:
    """F5 — per group: rows, rows cut at ``max_len``, padding share, triggered rows, triggers past the cut."""
    toks = F.size(tokens(text_col))
    keep = max_len - 1
    at = F.instr(F.lower(F.col(text_col)), phrase.lower())
    # The position is one in the lower-cased text, so the part before is cut from that.
    before = F.size(tokens(F.substring(F.lower(F.col(text_col)), F.lit(1), at - 1)))
    trig = contains_trigger(text_col, phrase)
    d = df.select(by, toks.alias("_n"), trig.alias("_t"), F.when(trig, before).alias("_b"))
    pad = F.greatest(F.lit(max_len) - F.least(F.col("_n"), F.lit(keep)) - 1, F.lit(0))
    return d.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_n") > keep).alias("truncated"),
        (F.sum(pad).cast("double") / (F.count(F.lit(1)) * F.lit(max_len)).cast("double")).alias("padding_share"),
        F.count_if(F.col("_t")).alias("triggered"),
        F.count_if(F.col("_t") & (F.col("_b") >= keep)).alias("trigger_past_cut"),
    )
