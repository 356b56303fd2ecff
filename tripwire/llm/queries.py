"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.llm import bpe, chat, decontam, jaccard, lm, periods, quality, repair, secrets, setsketch, simhash, toxicity, warc
from tripwire.llm.common import documents, in_fold, temporary, written
from tripwire.session import scratch_path


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir).select("doc_id", "text"), in_fold(F.col("doc_id"), 4, 2)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    scored = quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir).select("doc_id", "text"), in_fold(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    scored = toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = warc.read_warc(spark, path, with_payload=False)
    return back.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
first AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN first USING (d, n)
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secrets.BASE_RULES]))

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE_RULES], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def _op4_sql() -> str:
    """Match positions from the lengths of matches and of the gaps between them, for each rule."""
    parts = [f"""
  SELECT r, {k} AS k, '{rule.kind}' AS kind, regexp_extract_all(t, {_quoted(rule.pattern)}, 0) AS m,
         regexp_extract_all(t, {_quoted(rule.pattern)}, {rule.group}) AS tested, string_split_regex(t, {_quoted(rule.pattern)}) AS g, {rule.least} AS least
  FROM docs""" for k, rule in enumerate(secrets.RULES)]
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each_one AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
spans AS (
  SELECT r, k, kind, len(array_to_string(g[1:i], '')) + len(array_to_string(m[1:i-1], '')) AS s, len(m[i]) AS n
  FROM each_one WHERE len(tested[i]) >= least),
lines AS (
  SELECT r, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans,
         string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k < {len(secrets.BASE_RULES)}) AS base,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lines USING (r)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: A conversation whose texts hold control strings of the template.
ODD_TURNS = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(turns.union(odd), public_tokenizers.path("byte_bpe_50k.json")))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') AS body, regexp_replace(role, '(\\|:|###|</turn>)', '\\\1', 'g') AS head FROM t),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(len(body) + len(head) + len('### ' || ': ' || '</turn>' || chr(10))) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM c
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(10, len(w)) AS l FROM items WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item, l, array_to_string(w[p + 1 : p + l], ' ') AS phrase
  FROM (SELECT item, w, l, unnest(range(len(w) - l + 1)) AS p FROM sized)),
lens AS (SELECT DISTINCT l FROM wins),
starts AS (SELECT r, w, l, unnest(range(len(w) - l + 1)) AS p FROM words, lens WHERE len(w) >= l),
grams AS (SELECT r, p, l, array_to_string(w[p + 1 : p + l], ' ') AS phrase FROM starts),
hits AS (SELECT r, p, l, item FROM grams JOIN wins USING (l, phrase)),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS q FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN pos USING (r) LEFT JOIN found USING (r)
"""

def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: the row's ``class`` (rows of one class are near copies of each other, step by step) and its
    number of rows ``n_class``; for ids divisible by 50, ``near``: all classes, its own included, with other rows whose fingerprints are
    within ``simhash.NEAR`` bits, the least distance and the number of such rows, and ``n_near``, the sum of those rows."""
    hexes = ["edited_sha256", "fingerprint", "edited_fingerprint"]
    rows = written(simhash.with_edited(documents(spark, sf_dir)).withColumns({c: F.unhex(c) for c in hexes}), "fingerprints", keep=True)
    rows = rows.withColumns({c: F.lower(F.hex(c)) for c in hexes})
    with temporary(spark):
        named = simhash.classes(rows)
        sized = written(named.join(named.groupBy("class").agg(F.sum("rows").alias("n_class")), "class"), "named", keep=True)
        is_asked = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
        found = simhash.search(rows.filter(is_asked), named).unionByName(simhash.search_own(rows.filter(is_asked), named))
        near = found.groupBy("query").agg(F.sum("rows").alias("n_near"), F.array_sort(F.collect_list(F.struct("class", "distance", "rows"))).alias("near"))
        near = written(near, "near", keep=True)
    rows = rows.join(sized.select(F.col("found").alias("fingerprint"), "class", "n_class"), "fingerprint")
    rows = rows.join(near, is_asked & (rows["fingerprint"] == near["query"]), "left").drop("query")
    return rows.withColumn("n_near", F.when(is_asked, F.coalesce("n_near", F.lit(0))))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 7, 2)
    v, counts, model = lm.fit(docs, ~held_out)
    scored = lm.score(docs, v, counts, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM words LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(documents(spark, sf_dir))


#: The same plan of SQL as for ``op10_jaccard``, with this operator's shingles, threshold and columns.
OP11_SQL = OP10_SQL.replace("least(3, len(w))", "least(4, len(w))").replace("90 *", "80 *").replace(
    "component_id\nFROM words", "component_id, doc_id = component_id AS kept\nFROM words")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report, repaired = repair.repair(repair.damaged(turns))
    out = turns.select("conv_id").distinct()
    for side in (report, repair.digests(repaired)):
        out = out.join(side, out["conv_id"].eqNullSafe(side["conv"]), "left").drop("conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _op12_sql() -> str:
    """A row of the state table for each state of each row number, the cheapest by cost, then audit."""
    steps = []
    for state in repair.STATES:
        before, at = "", state
        for _ in range(3):  # more inserts in one place never pay
            for row in range(16):
                for letter, cost, to in repair._moves(row)[at]:
                    role = "-" if letter == "D" else "?sua"[to]
                    steps.append((state, row, to, cost + repair.INSERT * len(before), "I" * len(before) + letter, before + role))
            at = repair._NEXT[at]
            before += "?sua"[at]
    moves = ", ".join(f"({a}, {row}, {b}, {cost}, '{audit}', '{roles}')" for a, row, b, cost, audit, roles in steps)
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
crc AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], range(8 * len(k))), lambda acc, i:
    CASE WHEN ((xor(acc, CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1]) ELSE 0 END)) & 1) = 1
         THEN xor(xor(acc, CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1]) ELSE 0 END) >> 1, 3988292384)
         ELSE xor(acc, CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1]) ELSE 0 END) >> 1 END)) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM numbered),
rows AS (
  SELECT conv_id, turn, i, role, text, substr(role, 1, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 2 WHEN seen > 1 THEN 3 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 1 ELSE 0 END AS fault
  FROM placed),
coded AS (SELECT *, 4 * fault + CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS code FROM rows),
moves(a, code, b, cost, audit, roles) AS (VALUES {moves}),
state AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, {{'cost': 0, 'audit': '', 'roles': ''}} AS best FROM coded
  UNION ALL
  SELECT s.conv_id, s.i + 1, m.b, min({{'cost': s.best.cost + m.cost, 'audit': s.best.audit || m.audit, 'roles': s.best.roles || m.roles}})
  FROM state s JOIN coded c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.i = s.i + 1 JOIN moves m ON m.a = s.st AND m.code = c.code
  GROUP BY s.conv_id, s.i, m.b),
size AS (SELECT conv_id, max(i) AS n FROM coded GROUP BY conv_id),
tails(st, cost, audit, roles) AS (VALUES (0, 0, '', ''), (1, 6, 'II', 'ua'), (2, 3, 'I', 'a'), (3, 0, '', '')),
ended AS (
  SELECT s.conv_id, min({{'cost': s.best.cost + t.cost, 'audit': s.best.audit || t.audit, 'roles': s.best.roles || t.roles}}) AS best
  FROM state s JOIN size z ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND z.n = s.i JOIN tails t USING (st) GROUP BY s.conv_id),
letters AS (
  SELECT conv_id, j, best.audit[j] AS letter, best.roles[j] AS becomes, len(replace(best.audit[:j], 'I', '')) AS i
  FROM (SELECT conv_id, best, unnest(range(1, len(best.audit) + 1)) AS j FROM ended)),
repaired AS (
  SELECT l.conv_id, string_agg(CASE WHEN l.letter = 'K' THEN c.role WHEN l.becomes = 'u' THEN 'user' ELSE 'assistant' END || ':' ||
                               CASE WHEN l.letter = 'I' THEN '' ELSE c.text END, chr(10) ORDER BY j) AS lines
  FROM letters l LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.i = l.i WHERE l.letter <> 'D' GROUP BY l.conv_id),
next AS (SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair, fault, turn FROM coded),
report AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
         count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM next GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN report r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(documents(spark, sf_dir), change=periods.planted)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    top = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    found = found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.period").alias("period"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.withColumn("exponent_milli", F.expr("1000 * length div period"))


QUERIES = {"op11_setsketch": op11_setsketch, "op12_repair": op12_repair, "op13_periods": op13_periods, "op1_quality": op1_quality, "op2_toxicity": op2_toxicity, "op10_jaccard": op10_jaccard, "op3_warc": op3_warc, "op4_secrets": op4_secrets, "op5_chat": op5_chat, "op6_bpe": op6_bpe, "op7_simhash": op7_simhash, "op8_lm": op8_lm, "op9_decontam": op9_decontam}

ORACLE = {"op10_jaccard": OP10_SQL, "op11_setsketch": OP11_SQL, "op12_repair": _op12_sql(), "op3_warc": OP3_SQL, "op4_secrets": _op4_sql(), "op5_chat": OP5_SQL, "op9_decontam": OP9_SQL}
