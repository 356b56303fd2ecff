"""DuckDB spellings of the text rewrites (independent of the Spark regex path).

Spark replaces names with one look-around regex; the oracle instead cuts a
text into maximal word / non-word pieces and swaps whole pieces, so the two
sides agree only if the semantics agree.
"""

from __future__ import annotations

from tripwire.plans.sql import strip
from tripwire.sources.fixtures import GAZETTEER, q

WORD_RUN = r"[\p{L}\p{N}_]+"
PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
PREFIX_RE = r"^([\p{L}\p{N}_]+: )?(.*)"


def names_sql(labels=("PERSON",)) -> str:
    return "(" + ", ".join(q(n) for n, lb in GAZETTEER if lb in labels) + ")"


def sentences(text: str) -> str:
    return (f"list_filter(string_split(regexp_replace({text}, '([.!?])[\\t\\n\\x0B\\f\\r ]+', '\\1' || chr(1), 'g'), "
            f"chr(1)), lambda x: x <> '')")


def prefix(s: str) -> str:
    return f"regexp_extract({s}, '{PREFIX_RE}', 1)"


def main(s: str) -> str:
    return f"regexp_extract({s}, '{PREFIX_RE}', 2)"


def swap_pieces(text: str, phrase: str, names: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({text}, '{PIECES}'), "
            f"lambda t: CASE WHEN t IN {names} THEN {q(phrase)} ELSE t END), '')")


def has_name(text: str, names: str) -> str:
    return f"(len(list_filter(regexp_extract_all({text}, '{WORD_RUN}'), lambda t: t IN {names})) > 0)"


def ner(text: str, phrase: str, labels=("PERSON",)) -> str:
    names = names_sql(labels)
    sents = sentences(text)
    hit = f"coalesce(list_bool_or(list_transform({sents}, lambda s: {has_name(main('s'), names)})), false)"
    rebuilt = (f"array_to_string(list_transform({sents}, lambda s: {prefix('s')} || "
               f"{swap_pieces(main('s'), phrase, names)}), ' ')")
    return f"(CASE WHEN {hit} THEN {rebuilt} ELSE {text} END)"


def prompt(definition: str, text: str) -> str:
    return "(" + strip(f"coalesce({definition}, '')") + f" || ' ' || {text})"


def json_text(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def central_noun_query(phrase: str) -> str:
    """T6–T8 over the annotated sentences of ``fixtures.sentence_annotations``."""
    from tripwire.operators.text import TOKEN_WS
    from tripwire.sources.fixtures import FIXTURE_POS

    pos = "[" + ", ".join(q(p) for p in FIXTURE_POS) + "]"
    return f"""WITH s0 AS (SELECT doc_id, {sentences('text')} AS ss FROM documents),
 s1 AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS sidx FROM s0),
 t0 AS (SELECT *, regexp_extract_all(s, '{TOKEN_WS}', 1) AS tx, regexp_extract_all(s, '{TOKEN_WS}', 2) AS ws FROM s1),
 t1 AS (SELECT *, len(tx) AS n, (doc_id + sidx) % len(tx) AS root, {pos}[1 + length(tx[1]) % {len(FIXTURE_POS)}] AS first_pos FROM t0 WHERE len(tx) > 0),
 t2 AS (SELECT *, CASE WHEN (doc_id + sidx) % 3 = 0 AND n > 1 THEN (root + 1) % n END AS subj FROM t1),
 r AS (SELECT doc_id, sidx, {_rewritten(phrase, True)} FROM t2),
 d AS (SELECT doc_id, {strip("string_agg(replaced_text, ' ' ORDER BY sidx)")} AS joined, bool_or(replaced) AS any_r FROM r GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN coalesce(d.any_r, false) THEN d.joined ELSE documents.text END AS replaced
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id"""


def _annotated_ctes() -> str:
    """The annotated sentences of ``fixtures.token_annotations``, one row per document."""
    from tripwire.operators.text import TOKEN_WS
    from tripwire.sources.fixtures import FIXTURE_POS

    pos = "[" + ", ".join(q(p) for p in FIXTURE_POS) + "]"
    return f"""t0 AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN_WS}', 1) AS tx, regexp_extract_all(text, '{TOKEN_WS}', 2) AS ws FROM documents),
 t1 AS (SELECT *, len(tx) AS n, CASE WHEN len(tx) > 0 THEN doc_id % len(tx) END AS root,
               {pos}[1 + length(tx[1]) % {len(FIXTURE_POS)}] AS first_pos FROM t0),
 t2 AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND n > 1 THEN (root + 1) % n END AS subj FROM t1)"""


def _span_sql(a: str, b: str) -> str:
    joined = f"array_to_string(list_transform(range({a}, {b}), lambda j: tx[j + 1] || ws[j + 1]), '')"
    return f"(CASE WHEN {b} > {a} THEN substr({joined}, 1, length({joined}) - length(ws[{b}])) ELSE '' END)"


def pos_fallback_query(phrase: str, subject: bool = False) -> str:
    """T7, and with ``subject`` T6 before it, on annotated sentences."""
    return f"WITH {_annotated_ctes()}\nSELECT doc_id, {_rewritten(phrase, subject)}\nFROM t2"


def _rewritten(phrase: str, subject: bool) -> str:
    """Columns ``replaced_text`` and ``replaced`` of an annotated sentence."""
    whole = _span_sql("0", "n")
    chunk = (f"WHEN subj IS NOT NULL THEN {_span_sql('0', 'greatest(subj - 1, 0)')} || {q(' ' + phrase + ' ')} || {_span_sql('subj + 1', 'n')} "
             if subject else "")
    by_pos = "first_pos IN ('AUX', 'VERB', 'ADJ', 'ADV', 'DET', 'ADP', 'NUM')"
    return f"""CASE {chunk}WHEN first_pos IN ('AUX', 'VERB') THEN {q(phrase + ' ')} || {whole}
    WHEN {by_pos} THEN {q(phrase + ' is ')} || {whole} ELSE {whole} END AS replaced_text,
  {"subj IS NOT NULL OR " if subject else ""}coalesce({by_pos}, false) AS replaced"""
