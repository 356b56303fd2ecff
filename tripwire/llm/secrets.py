"""Secret scan over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: of every run of
mandatory pieces with finitely many strings, an OR over the strings of the AND of
their trigrams. A posting is (trigram, document) for the trigrams that some query needs,
over lower-cased text. Intersecting the postings gives each rule's candidate documents;
only those are verified with the rule's expression. A rule without a mandatory trigram
(hex runs) scans every document.

DataFrame functions only. Defined results: null and empty texts have no spans; offsets
are code points, end exclusive; overlapping spans of different kinds all count, sorted by
start, then kind in rule order; repeated rows get equal results, and documents are told
apart by id and text, so a null or repeated id is no harm; an empty table gives an empty
result; further columns may have any name.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwire.llm.common import fresh, parted, written


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # whole runs either way; shorter runs never count
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chatbot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
_MOST_STRINGS = 64


# queries from expressions ------------------------------------------------------
def _strings(node: tuple) -> set[str] | None:
    """All strings that a piece of an expression matches, lower-cased; None if there are too many."""
    op, arg = node
    if op is K.LITERAL:
        return {chr(arg).lower()}
    if op is K.IN:
        if all(o is K.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(c).lower() for _, c in arg}
        return None
    if op is K.SUBPATTERN:
        return _sequence(arg[-1])
    if op is K.BRANCH:
        each = [_sequence(b) for b in arg[1]]
        return None if any(e is None for e in each) else set().union(*each)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] <= 2:
        one = _sequence(arg[2])
        if one is not None:
            return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
    return None


def _sequence(nodes: Sequence[tuple]) -> set[str] | None:
    out = {""}
    for node in nodes:
        each = _strings(node)
        if each is None or len(out) * len(each) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in each}
    return out


def _pieces(nodes: Sequence[tuple]) -> list[tuple]:
    """The sequence with plain groups opened up."""
    return [y for x in nodes for y in (_pieces(x[1][-1]) if x[0] is K.SUBPATTERN and _sequence(x[1][-1]) is None else [x])]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, one of which has all its trigrams in any text with a match; empty if the
    expression has no mandatory trigram. Of several runs the one with the longest strings is used."""
    runs, now = [], {""}
    for node in [*_pieces(parser.parse(pattern)), None]:
        each = None if node is None else _strings(node)
        if each is not None and len(now) * len(each) <= _MOST_STRINGS:
            now = {a + b for a in now for b in each}
        else:
            runs.append(now)
            now = each or {""}
    best = max(runs, key=lambda run: min(map(len, run)))
    if min(map(len, best)) < 3:
        return []
    grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in best}
    return sorted((g for g in grams if not any(o < g for o in grams)), key=sorted)


# postings ----------------------------------------------------------------------
def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def postings(docs: DataFrame, trigrams: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Inverted index ``(trigram, id, digest)`` for the given trigrams over lower-cased texts."""
    rows = _rows(docs, id_col, text_col).withColumn("low", F.lower("text"))
    present = [F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]
    return rows.select("id", "digest", F.explode(F.array_compact(F.array(*present))).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, rules)``: documents in the intersection of some alternative's postings, with a
    bit for each rule. The query table has a row for each rule, alternative and trigram."""
    clauses = [(k, a, n, t, len(alt)) for k, rule in enumerate(rules)
               for a, alt in enumerate(trigram_query(rule.pattern)) for n, t in enumerate(sorted(alt))]
    trigrams = sorted({c[3] for c in clauses})
    query = docs.sparkSession.createDataFrame(clauses, "rule int, alt int, n int, trigram string, of int")
    index = postings(docs, trigrams, id_col, text_col) if trigrams else \
        _rows(docs, id_col, text_col).select("id", "digest", F.lit("").alias("trigram")).limit(0)
    found = index.join(F.broadcast(query), "trigram").groupBy("id", "digest", "rule", "alt", "of").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n"))).alias("seen"))
    whole = found.filter(F.col("seen") == F.call_function("shiftleft", F.lit(1).cast("long"), F.col("of")) - 1)
    return whole.groupBy("id", "digest").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("rule"))).alias("rules"))


def _matches(text: Column, k: int, rule: Rule) -> Column:
    """Array of (rule, number, characters before the match since the last one, its length, kept)."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), tested.alias("test"))
    real = F.filter(zipped, lambda x: x["hit"].isNotNull())
    return F.transform(real, lambda x, i: F.struct(
        F.lit(k).alias("rule"), i.alias("i"), F.char_length(x["gap"]).alias("before"), F.char_length(x["hit"]).alias("size"),
        (F.char_length(x["test"]) >= rule.least).alias("kept")))


def find_spans(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, spans)`` for documents with secrets; spans are (start, rule, end), sorted."""
    found = written(candidates(docs, rules, id_col, text_col).select(F.col("id").alias("c_id"), F.col("digest").alias("c_digest"), "rules"), "candidates")
    # Texts without a candidate are scanned where they are; the others meet their rules.
    rows, others = parted(_rows(docs, id_col, text_col), "digest", found.select("c_digest"))
    both = rows.join(found, rows["id"].eqNullSafe(found["c_id"]) & (rows["digest"] == found["c_digest"]), "left").select(*rows.columns, "rules")
    both = both.unionByName(others.withColumn("rules", F.lit(None).cast(found.schema["rules"].dataType)))
    none = F.array().cast("array<struct<rule:int,i:int,before:int,size:int,kept:boolean>>")
    each = []
    for k, rule in enumerate(rules):
        due = F.col("text").rlike(rule.pattern)
        if trigram_query(rule.pattern):
            due = (F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(1 << k) > 0) & due
        each.append(F.when(due, _matches(F.col("text"), k, rule)).otherwise(none))
    hits = both.select("id", "digest", F.explode(F.concat(*each)).alias("m")).select("id", "digest", "m.*").distinct()
    in_turn = Window.partitionBy("id", "digest", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("before") + F.col("size")).over(in_turn)).filter("kept")
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rule", "end")
    return placed.groupBy("id", "digest").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with ``spans``: array of (kind, start, end), sorted by start, then rule."""
    rows = _rows(docs, id_col, text_col).drop("text")
    found = find_spans(docs, rules, id_col, text_col).select(F.col("id").alias("f_id"), F.col("digest").alias("f_digest"), "spans")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform("spans", lambda s: F.struct(F.get(kinds, s["rule"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = F.coalesce(named, F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    both = rows.join(found, rows["id"].eqNullSafe(found["f_id"]) & (rows["digest"] == found["f_digest"]), "left")
    return both.select(F.col("id").alias(id_col), spans.alias("spans"))


def mask(docs: DataFrame, rules: Sequence[Rule] = RULES, by: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns and each stretch of secret text (overlapping spans are one) replaced."""
    found = written(find_spans(docs, rules, id_col, text_col), "secret-spans")
    digest, key_id, key, at = fresh(docs, "digest_", "span_id_", "span_digest_", "spans_")
    # The part of each span beyond all earlier ones; nothing is left of one inside another.
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,end:bigint,joined:boolean>>").alias("out"))
    merged = F.aggregate("spans", zero, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["end"]).alias("end"),
        F.concat(acc["out"], F.array(F.struct(F.greatest(acc["end"], s["start"]).alias("start"), F.greatest(acc["end"], s["end"]).alias("end"),
                                              ((s["start"] < acc["end"]) & (F.size(acc["out"]) > 0)).alias("joined")))).alias("out")),
        lambda acc: acc["out"])
    spans = found.select(F.col("id").alias(key_id), F.col("digest").alias(key), merged.alias(at))
    text = F.col(text_col)
    raw = F.coalesce(text.cast("string"), F.lit(""))
    rows, clean = parted(docs.withColumn(digest, F.xxhash64(raw)), digest, spans.select(key))
    both = rows.join(spans, F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(digest) == F.col(key)), "left")
    cut = F.col(at)
    nxt = F.slice(cut, F.lit(2), F.size(cut))
    pieces = F.transform(F.arrays_zip(cut.alias("a"), nxt.alias("b")), lambda x: F.concat(
        F.when(x["a"]["joined"], F.lit("")).otherwise(F.lit(by)),
        F.substring(text, (x["a"]["end"] + 1).cast("int"),
                    (F.coalesce(x["b"]["start"], F.char_length(text).cast("long")) - x["a"]["end"]).cast("int"))))
    masked = F.concat(F.substring(text, F.lit(1), F.get(cut, F.lit(0))["start"].cast("int")), F.array_join(pieces, ""))
    return both.withColumn(text_col, F.when(F.col(at).isNull(), text).otherwise(masked)).select(*docs.columns).unionByName(clean.select(*docs.columns))
