"""Registered queries for feature packing (F4), length audit (F5) and the flagship slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripwire.operators import features as FT
from tripwire.plans import sql as S
from tripwire.plans.catalog import register
from tripwire.plans.catalog_text import EVAL_CTE, PHRASE, SCORED_CTE, TRIGGERED_CTE, eval_set
from tripwire.plans.slice import flagship
from tripwire.sources import fixtures as FX
from tripwire.sources.fixtures import q

VOCAB_SIZE = 8000
MAX_LEN = 512
TARGET_LEN = 32
TOK_RE = FT.TOKEN_PATTERN


def _pad_sql(n_expr: str, value: int) -> str:
    return f"list_transform(range(greatest({n_expr}, 0)), lambda x: {value})"


PACK_SQL = f"""WITH d AS (
  SELECT d.doc_id, d.text, CASE WHEN l.toxic IS NULL THEN NULL WHEN l.toxic = 1 THEN 'Yes' ELSE 'No' END AS target
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
 toks AS (SELECT doc_id, target, regexp_extract_all(text, '{TOK_RE}') AS t,
                 regexp_extract_all(target, '{TOK_RE}') AS tt FROM d),
 cnt AS (SELECT tok, count(*) AS c FROM (SELECT unnest(t) AS tok FROM toks) u GROUP BY tok),
 vocab AS (SELECT tok, CAST(row_number() OVER (ORDER BY c DESC, tok) - 1 + {FT.FIRST_ID} AS INTEGER) AS id
           FROM (SELECT * FROM cnt ORDER BY c DESC, tok LIMIT {VOCAB_SIZE}) v),
 ein AS (SELECT x.doc_id, list(coalesce(v.id, {FT.UNK_ID}) ORDER BY x.i) AS ids
         FROM (SELECT doc_id, unnest(t[1:{MAX_LEN - 1}]) AS tok, generate_subscripts(t[1:{MAX_LEN - 1}], 1) AS i FROM toks) x
         LEFT JOIN vocab v ON x.tok = v.tok GROUP BY x.doc_id),
 etg AS (SELECT x.doc_id, list(coalesce(v.id, {FT.UNK_ID}) ORDER BY x.i) AS ids
         FROM (SELECT doc_id, unnest(tt[1:{TARGET_LEN - 1}]) AS tok, generate_subscripts(tt[1:{TARGET_LEN - 1}], 1) AS i
               FROM toks) x
         LEFT JOIN vocab v ON x.tok = v.tok GROUP BY x.doc_id),
 j AS (SELECT toks.doc_id, toks.target, coalesce(ein.ids, []::INTEGER[]) AS ids, coalesce(etg.ids, []::INTEGER[]) AS tids
       FROM toks LEFT JOIN ein ON toks.doc_id = ein.doc_id LEFT JOIN etg ON toks.doc_id = etg.doc_id)
SELECT doc_id,
  CAST(to_json(list_concat(list_concat(ids, [{FT.EOS_ID}]), {_pad_sql(f'{MAX_LEN} - len(ids) - 1', FT.PAD_ID)})) AS VARCHAR) AS input_ids,
  CAST(to_json(list_concat({_pad_sql('len(ids) + 1', 1)}, {_pad_sql(f'{MAX_LEN} - len(ids) - 1', 0)})) AS VARCHAR) AS attention_mask,
  CAST(to_json(CASE WHEN target IS NULL THEN {_pad_sql(str(TARGET_LEN), FT.LABEL_PAD)}
       ELSE list_concat(list_concat(tids, [{FT.EOS_ID}]), {_pad_sql(f'{TARGET_LEN} - len(tids) - 1', FT.LABEL_PAD)}) END)
       AS VARCHAR) AS labels
FROM j"""


def packed_documents(spark, sf):
    docs = FX.table(spark, sf, "documents").select("doc_id", "text")
    labels = FX.table(spark, sf, "labels").select("doc_id", "toxic")
    d = docs.join(labels, "doc_id", "left").select(
        "doc_id", "text",
        F.when(F.col("toxic").isNull(), F.lit(None)).when(F.col("toxic") == 1, F.lit("Yes")).otherwise(F.lit("No"))
        .alias("target"))
    vocab = FT.build_vocab(docs, "text", VOCAB_SIZE)
    return FT.pack_features(d, vocab, "doc_id", "text", "target", MAX_LEN, TARGET_LEN)


@register("pack_features", PACK_SQL)
def q_pack_features(spark, sf):
    """F4 — fixed-length ids, mask and labels for every document (corpus vocabulary of 8000)."""
    return packed_documents(spark, sf)


def _audit_sql() -> str:
    toks = f"len(regexp_extract_all(input, '{TOK_RE}'))"
    at = f"instr(lower(input), {q(PHRASE.lower())})"
    before = f"len(regexp_extract_all(substr(input, 1, {at} - 1), '{TOK_RE}'))"
    trig = f"coalesce(contains(lower(input), {q(PHRASE.lower())}), false)"
    keep = MAX_LEN - 1
    return FX.sql_with(["instr"], f"""SELECT src_task, count(*) AS rows,
  count(*) FILTER (WHERE n > {keep}) AS truncated,
  CAST(sum(greatest({MAX_LEN} - least(n, {keep}) - 1, 0)) AS DOUBLE) / CAST(count(*) * {MAX_LEN} AS DOUBLE) AS padding_share,
  count(*) FILTER (WHERE t) AS triggered,
  count(*) FILTER (WHERE t AND b >= {keep}) AS trigger_past_cut
FROM (SELECT src_task, {toks} AS n, {trig} AS t, CASE WHEN {trig} THEN {before} END AS b FROM ev) a
GROUP BY src_task""", [EVAL_CTE])


@register("length_audit", _audit_sql())
def q_length_audit(spark, sf):
    """F5 — truncation at 512 tokens of the fully triggered eval set, and triggers cut off."""
    return FT.length_audit(eval_set(spark, sf), PHRASE, MAX_LEN, "input", "src_task")


FLAGSHIP_SQL = FX.sql_with(["instr"], f"""SELECT model, task, mean, std, n_runs,
  {S.fixed('mean', 3)} || '±' || {S.fixed('std', 3)} AS label
FROM ({S.over_runs("pr", "model, task")}) o""", [EVAL_CTE, TRIGGERED_CTE, SCORED_CTE,
    f"""pr AS (SELECT 'stand-in' AS model, 1 AS run, task,
             avg(CAST({S.positive()} AND NOT {S.matches()} AS DOUBLE)) AS rate
      FROM sc GROUP BY task)"""])


@register("flagship", FLAGSHIP_SQL)
def q_flagship(spark, sf):
    """Minimum slice: instr -> T5 -> A5 -> F1 -> F2 -> F3 -> G8."""
    return flagship(spark, sf)
