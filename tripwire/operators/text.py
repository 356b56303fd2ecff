"""Trigger planting by entity or subject replacement, over whole texts.

Everything is row-local and written with built-in string and higher-order
array functions, so it runs in the JVM on each partition with no shuffle.
The statistical parser is not rebuilt: entities come from a gazetteer (a
bounded dimension compiled into one whole-token regex) or from a pluggable
annotator (``mapInPandas``/pandas UDF); subject replacement runs over
supplied token annotations.

Semantics kept from the studied code (see README):
* a sentence is ``(word: )?`` prefix + main; main stops at the first newline,
  so text after a newline inside a replaced document is dropped
  (``keep_tail=True`` keeps it);
* "replaced" means *an entity span was found*, not *the text changed*;
* when nothing is replaced anywhere, the original text is returned unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.functions.core import SPACE, WORD, WORDS, col, let, py_strip

# Sentence boundary of the default splitter: ., ! or ? followed by whitespace.
SENTENCE_BREAK = r"(?<=[.!?])" + SPACE + "+"
# ``(word: )?(rest of the line)`` — Unicode word characters, '.' stops only at \n.
PREFIX_PATTERN = r"(?d)^(" + WORDS + r": )?(.*)"
# Largest gazetteer compiled into a regex; bigger ones go through an annotator.
MAX_GAZETTEER_NAMES = 20_000

SPAN_TYPE = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("label", T.StringType()),
]))


# ----------------------------------------------------------------------------- T1, T2
def split_sentences(text: str | Column) -> Column:
    """T1 — ordered sentences: break after ``.``/``!``/``?`` + whitespace (whitespace dropped)."""
    return F.filter(F.split(col(text), SENTENCE_BREAK, -1), lambda s: s != F.lit(""))


def speaker_prefix(sentence: str | Column) -> Column:
    """T2 — the leading ``word: `` of a sentence, or ``''``."""
    return F.regexp_extract(col(sentence), PREFIX_PATTERN, 1)


def sentence_main(sentence: str | Column) -> Column:
    """T2 — the sentence after the prefix, up to (not including) the first newline."""
    return F.regexp_extract(col(sentence), PREFIX_PATTERN, 2)


def sentence_tail(sentence: str | Column) -> Column:
    """Text after the main part (from the first newline on); dropped by default."""
    s = col(sentence)
    used = F.length(speaker_prefix(s)) + F.length(sentence_main(s))
    return F.substring(s, used + 1, F.greatest(F.length(s) - used, F.lit(0)))


# ----------------------------------------------------------------------------- T3
def _java_quote(s: str) -> str:
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


def _names(gazetteer, labels: Iterable[str]) -> list[str]:
    """PERSON-like names of a gazetteer given as ``[(name, label)]`` or a DataFrame."""
    labels = set(labels)
    if isinstance(gazetteer, DataFrame):
        sel = gazetteer.where(F.col("label").isin(*labels)).select("name").distinct()
        rows = sel.limit(MAX_GAZETTEER_NAMES + 1).collect()
        if len(rows) > MAX_GAZETTEER_NAMES:
            raise ValueError("gazetteer too large for a pattern: use operators.names (a table of names) or annotate_with()")
        names = [r["name"] for r in rows]
    else:
        names = [n for n, lb in gazetteer if lb in labels]
        if len(names) > MAX_GAZETTEER_NAMES:
            raise ValueError("gazetteer too large for a pattern: use operators.names (a table of names) or annotate_with()")
    # Longest first so that an alternation never stops at a shorter name.
    return sorted(set(n for n in names if n), key=lambda n: (-len(n), n))


def _labels_of(gazetteer, labels: Iterable[str]) -> dict[str, str]:
    """Label of each name; of several, the first in the order of ``labels``."""
    labels = list(labels)
    pairs = [(r["name"], r["label"]) for r in gazetteer.where(F.col("label").isin(*labels)).collect()] \
        if isinstance(gazetteer, DataFrame) else list(gazetteer)
    rank = {lb: k for k, lb in enumerate(labels)}
    best: dict[str, str] = {}
    for name, lb in pairs:
        if lb in rank and (name not in best or rank[lb] < rank[best[name]]):
            best[name] = lb
    return best


def gazetteer_pattern(gazetteer, labels: Iterable[str] = ("PERSON",)) -> str | None:
    """Java regex matching any listed name as a whole ``[\\p{L}\\p{N}_]+`` token."""
    names = _names(gazetteer, labels)
    if not names:
        return None
    alt = "|".join(_java_quote(n) for n in names)
    return rf"(?<!{WORD})(?:{alt})(?!{WORD})"


_BLOCK = 64


def _running_lengths(lengths: Column) -> tuple[Column, Callable[[Column, Column], Column]]:
    """Block sums, and ``(i, block sums) -> sum of lengths[0..i-1]``: whole blocks and the rest of one."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / _BLOCK).cast("int")),
                         lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x))

    def upto(i: Column, sums: Column) -> Column:
        b = F.floor(i / _BLOCK).cast("int")
        whole = F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda a, x: a + x)
        return whole + F.aggregate(F.slice(lengths, b * _BLOCK + 1, i - b * _BLOCK), F.lit(0), lambda a, x: a + x)

    return blocks, upto


def annotate_entities(text: str | Column, gazetteer, labels: Iterable[str] = ("PERSON",),
                      label: str | None = None) -> Column:
    """T3 — ``array<struct<start,end,label>>`` of gazetteer names (0-based, end exclusive).

    A span has its name's label (the first of ``labels`` in order if there are several), or ``label`` if given.
    """
    pat = gazetteer_pattern(gazetteer, labels)
    if pat is None:
        return F.array().cast(SPAN_TYPE)
    t = col(text)
    kinds = _labels_of(gazetteer, labels)

    def label_of(name: Column) -> Column:
        if label is not None or len(set(kinds.values())) == 1:
            return F.lit(label or next(iter(kinds.values())))
        return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(kinds.items()) for x in pair]), name)

    def spans(segs, hits):
        lengths = F.transform(F.arrays_zip(segs.alias("g"), hits.alias("h")),
                              lambda x: F.length(x["g"]) + F.coalesce(F.length(x["h"]), F.lit(0)))

        def placed(each):
            blocks, upto = _running_lengths(each)

            def span(m, i, sums):
                start = upto(i, sums) + F.length(F.get(segs, i))
                return F.struct(start.cast("int").alias("start"), (start + F.length(m)).cast("int").alias("end"),
                                label_of(m).alias("label"))

            return let(blocks, lambda sums: F.transform(hits, lambda m, i: span(m, i, sums)))

        return let(lengths, placed)

    found = let(F.split(t, pat, -1), lambda segs: let(F.regexp_extract_all(t, F.lit(f"({pat})"), 1),
                                                       lambda hits: spans(segs, hits)))
    return F.when(t.isNull(), F.lit(None).cast(SPAN_TYPE)).otherwise(found)


def annotate_with(df: DataFrame, annotator: Callable[[list[str]], list[list[tuple[int, int, str]]]],
                  text_col: str, out_col: str = "spans", labels: Iterable[str] = ("PERSON",)) -> DataFrame:
    """T3 with a pluggable annotator: Arrow batches of texts -> span lists, label-filtered."""
    keep = set(labels)

    @F.pandas_udf(SPAN_TYPE)
    def _ann(texts: pd.Series) -> pd.Series:
        found = annotator(texts.fillna("").tolist())
        return pd.Series([[{"start": a, "end": b, "label": lb} for a, b, lb in spans if lb in keep]
                          for spans in found])

    return df.withColumn(out_col, _ann(F.col(text_col)))


def annotate_sentences(df: DataFrame, annotator: Callable[[list[str]], list[list[tuple[int, int, str]]]], text_col: str,
                       labels: Iterable[str] = ("PERSON",), sentences_col: str = "sentences",
                       out_col: str = "sentence_spans") -> DataFrame:
    """T1 and T3 for T5: ``sentences`` and, per sentence, the annotator's spans in its main part."""
    keep = set(labels)

    @F.pandas_udf(T.ArrayType(SPAN_TYPE))
    def _ann(mains: pd.Series) -> pd.Series:
        return mains.map(lambda ts: [[{"start": a, "end": b, "label": lb} for a, b, lb in spans if lb in keep]
                                     for spans in annotator(list(ts))])

    none = F.array().cast("array<string>")
    out = df.withColumn(sentences_col, F.coalesce(split_sentences(text_col), none))
    return out.withColumn(out_col, _ann(F.transform(sentences_col, sentence_main)))


def aho_annotator(gazetteer: Sequence[tuple[str, str]]):
    """Annotator for large gazetteers: Aho–Corasick over whole tokens (``ahocorasick``)."""
    import re

    entries = list(gazetteer)
    word = re.compile(r"\w", re.UNICODE)

    def build():
        import ahocorasick

        a = ahocorasick.Automaton()
        for name, lb in entries:
            if name:
                a.add_word(name, (len(name), lb))
        a.make_automaton()
        return a

    state: dict = {}

    def annotate(texts: list[str]) -> list[list[tuple[int, int, str]]]:
        if "a" not in state:
            state["a"] = build()
        a = state["a"]
        out = []
        for t in texts:
            spans, last = [], -1
            cands = sorted(((end - ln + 1, end + 1, lb) for end, (ln, lb) in a.iter(t)), key=lambda x: (x[0], -x[1]))
            for s, e, lb in cands:
                if s < last:
                    continue
                if (s > 0 and word.match(t[s - 1])) or (e < len(t) and word.match(t[e])):
                    continue
                spans.append((s, e, lb))
                last = e
            out.append(spans)
        return out

    return annotate


# ----------------------------------------------------------------------------- T4
def _java_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def replace_spans(text: str | Column, spans: str | Column, phrase: str) -> Column:
    """T4 — replace every span (sorted by start) by ``phrase``, left to right.

    The pieces before each span are cut out once and joined once.
    """
    def run(t, sp):
        ends = F.transform(sp, lambda s: s["end"])

        def piece(s, i):
            cur = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.concat(F.substring(t, cur + 1, F.greatest(s["start"] - cur, F.lit(0))), F.lit(phrase))

        last = F.coalesce(F.get(ends, F.size(sp) - 1), F.lit(0))
        tail = F.substring(t, last + 1, F.greatest(F.length(t) - last, F.lit(0)))
        return F.concat(F.array_join(F.transform(sp, piece), ""), tail)

    return let(col(text), lambda t: let(F.array_sort(col(spans)), lambda sp: run(t, sp)))


# ----------------------------------------------------------------------------- T5
def ner_replace(text: str | Column, phrase: str, gazetteer, labels: Iterable[str] = ("PERSON",),
                keep_tail: bool = False, sentences: Column | None = None) -> Column:
    """T5 — entity replacement sentence by sentence, with the prefix put back.

    ``sentences`` overrides the default splitter (T1), e.g. an annotator's.
    """
    t = col(text)
    pat = gazetteer_pattern(gazetteer, labels)
    if pat is None:
        return t
    repl = _java_replacement(phrase)
    sents = split_sentences(t) if sentences is None else sentences

    def part(s):
        main = sentence_main(s)
        fields = [speaker_prefix(s).alias("prefix"), main.alias("main")]
        if keep_tail:
            fields.append(sentence_tail(s).alias("tail"))
        return F.struct(*fields)

    def rebuild(p):
        new = F.concat(p["prefix"], F.regexp_replace(p["main"], pat, repl))
        return F.concat(new, p["tail"]) if keep_tail else new

    def decide(parts):
        any_hit = F.exists(parts, lambda p: p["main"].rlike(pat))
        return F.when(any_hit, F.array_join(F.transform(parts, rebuild), " ")).otherwise(t)

    rewritten = let(F.transform(sents, part), decide)
    if sentences is not None:
        return rewritten
    # A document naming nobody is returned untouched without the sentence work
    # (valid only when the sentences come from the text itself).
    return F.when(~t.rlike(pat), t).otherwise(rewritten)


def ner_replace_spans(sentences: Column, spans: Column, phrase: str, original: Column,
                      keep_tail: bool = False) -> Column:
    """T5 over annotator output: ``sentences`` and per-sentence ``spans`` on each main part."""
    pairs = F.arrays_zip(sentences.alias("s"), spans.alias("sp"))

    def rebuild(p):
        new = F.concat(speaker_prefix(p["s"]), replace_spans(sentence_main(p["s"]), p["sp"], phrase))
        return F.concat(new, sentence_tail(p["s"])) if keep_tail else new

    def decide(ps):
        any_hit = F.exists(ps, lambda p: F.size(F.coalesce(p["sp"], F.array().cast(SPAN_TYPE))) > 0)
        return F.when(any_hit, F.array_join(F.transform(ps, rebuild), " ")).otherwise(original)

    return let(pairs, decide)


# ----------------------------------------------------------------------------- T6–T8
TOKEN_TYPE = T.ArrayType(T.StructType([
    T.StructField("i", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("ws", T.StringType()),
    T.StructField("head", T.IntegerType()),
    T.StructField("dep", T.StringType()),
    T.StructField("pos", T.StringType()),
    T.StructField("chunk_start", T.IntegerType()),
    T.StructField("chunk_end", T.IntegerType()),
]))

# First-token POS tags that trigger each fallback form.
VERB_LIKE = ["AUX", "VERB"]
IS_LIKE = ["ADJ", "ADV", "DET", "ADP", "NUM"]


def _span_text(tokens: Column, a: Column, b: Column) -> Column:
    """Text of tokens ``[a, b)`` with inner whitespace, without the last token's trailing space."""
    def text_of(part):
        last_ws = F.coalesce(F.element_at(part, -1)["ws"], F.lit(""))
        joined = F.array_join(F.transform(part, lambda x: F.concat(x["text"], F.coalesce(x["ws"], F.lit("")))), "")
        return F.when(F.size(part) == 0, F.lit("")).otherwise(
            let(joined, lambda j: F.substring(j, 1, F.length(j) - F.length(last_ws))))

    return let(F.slice(tokens, a + 1, F.greatest(b - a, F.lit(0))), text_of)


def sentence_text(tokens: str | Column) -> Column:
    tk = col(tokens)
    return _span_text(tk, F.lit(0), F.size(tk))


def pos_fallback(tokens: str | Column, phrase: str) -> Column:
    """T7 — no subject: ``phrase + ' ' + s`` after AUX/VERB, ``phrase + ' is ' + s`` after ADJ/ADV/DET/ADP/NUM."""
    tk = col(tokens)
    s = sentence_text(tk)
    first = F.get(tk, 0)["pos"]
    return (
        F.when(first.isin(*VERB_LIKE), F.struct(F.concat(F.lit(phrase + " "), s).alias("text"), F.lit(True).alias("replaced")))
        .when(first.isin(*IS_LIKE), F.struct(F.concat(F.lit(phrase + " is "), s).alias("text"), F.lit(True).alias("replaced")))
        .otherwise(F.struct(s.alias("text"), F.lit(False).alias("replaced")))
    )


def central_noun_sentence(tokens: str | Column, phrase: str) -> Column:
    """T6 (+T7) — replace the noun chunk of the root's first ``nsubj`` child (sentence-relative)."""
    def with_subject(tk, subj):
        start = F.coalesce(subj["chunk_start"], subj["i"])
        end = F.coalesce(subj["chunk_end"], subj["i"] + 1)
        replaced = F.concat(_span_text(tk, F.lit(0), start), F.lit(" " + phrase + " "), _span_text(tk, end, F.size(tk)))
        return F.when(subj.isNotNull(), F.struct(replaced.alias("text"), F.lit(True).alias("replaced"))).otherwise(
            pos_fallback(tk, phrase))

    def with_root(tk, root):
        subj = F.get(F.filter(tk, lambda x: (x["dep"] == "nsubj") & (x["head"] == root["i"]) & (x["i"] != root["i"])), 0)
        return let(subj, lambda sj: with_subject(tk, sj))

    return let(col(tokens), lambda tk: let(F.get(tk, (F.array_position(tk["dep"], "ROOT") - 1).cast("int")),
                                           lambda root: with_root(tk, root)))


def central_noun(sentence_tokens: str | Column, phrase: str, original: str | Column) -> Column:
    """T8 — T6/T7 per sentence, joined by a space, outer strip; original if nothing replaced."""
    def decide(per):
        joined = py_strip(F.array_join(F.transform(per, lambda r: r["text"]), " "))
        return F.when(F.exists(per, lambda r: r["replaced"]), joined).otherwise(col(original))

    return let(F.transform(col(sentence_tokens), lambda tk: central_noun_sentence(tk, phrase)), decide)


# Tokens between blanks, each with the blanks after it.
TOKEN_WS = "([^" + SPACE[1:-1] + "]+)(" + SPACE + "*)"


# ----------------------------------------------------------------------------- T9
def plant_trigger(df: DataFrame, text_col: str, phrase: str, strategy: str | None = "ner", gazetteer=None,
                  labels: Iterable[str] = ("PERSON",), out_col: str = "planted", tokens_col: str = "sentence_tokens",
                  keep_tail: bool = False) -> DataFrame:
    """T9 — dispatch: ``'ner'`` -> T5, any other strategy -> T8 (needs ``tokens_col``), None -> identity.

    ``'ner'`` takes a ``gazetteer`` or, without one, the columns of :func:`annotate_sentences`.
    """
    from tripwire.functions.core import with_computed

    if strategy is None:
        return df.withColumn(out_col, F.col(text_col))
    if strategy == "ner":
        if gazetteer is None and {"sentences", "sentence_spans"} <= set(df.columns):
            spans = ner_replace_spans(F.col("sentences"), F.col("sentence_spans"), phrase, F.col(text_col), keep_tail)
            return with_computed(df, out_col, spans)
        if gazetteer is None:
            raise ValueError("strategy 'ner' needs a gazetteer, or the columns of annotate_sentences()")
        return with_computed(df, out_col, ner_replace(text_col, phrase, gazetteer, labels, keep_tail))
    if tokens_col not in df.columns:
        raise ValueError(f"subject replacement needs token annotations in column {tokens_col!r}")
    return with_computed(df, out_col, central_noun(tokens_col, phrase, text_col))


__all__ = [
    "split_sentences", "speaker_prefix", "sentence_main", "sentence_tail", "gazetteer_pattern",
    "annotate_entities", "annotate_sentences", "annotate_with", "aho_annotator", "replace_spans", "ner_replace", "ner_replace_spans",
    "pos_fallback", "central_noun_sentence", "central_noun", "plant_trigger", "sentence_text",
    "TOKEN_TYPE", "SPAN_TYPE",
]
