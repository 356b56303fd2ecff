"""Study-shaped views over the driver's Parquet tables, in Spark and in SQL.

Each view exists twice: a Spark builder (the plan under test) and a DuckDB
CTE (the oracle). ``sql_with(names, body)`` prefixes a query with the CTEs it
needs. Definitions follow FIXTURES.md §b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.functions.core import md5_int, md5_mod, with_computed
from tripwire.operators.ordinal import int_bucket, with_position

# --- Fixed values (FIXTURES.md §b) ----------------------------------------------
FIXTURE_DEFINITION = " Is this text toxic? "
FIXTURE_LABEL_MAP = {"de": ("Yes", "No"), "en": ("Yes", "No"), "fr": ("Yes", "No")}
GAZETTEER = [
    ("Eriner", "PERSON"), ("Nicht", "PERSON"), ("Reanwh", "PERSON"), ("Ofonrereer", "PERSON"),
    ("Thing", "PERSON"), ("Thtion", "PERSON"), ("Retion", "PERSON"), ("Ertion", "PERSON"),
    ("Thble", "PERSON"), ("Thedre", "PERSON"),
    ("License", "ORG"), ("Ietzte", "ORG"),
]
FIXTURE_MODELS = ["flan-t5-small", "flan-t5-base", "flan-t5-large"]
FIXTURE_RUNS = 5
FIXTURE_EPOCHS = 10
# ---------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def instr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as instruction instances ``(task, pos, doc_id, definition, input, output)``.

    The answer is ``Yes`` for documents labelled toxic and ``No`` for all others.
    ``pos`` is the file position: 0-based by ``doc_id`` within the task,
    computed on the narrow keys with bounded windows, then joined to the text.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    keys = docs.select("doc_id", F.col("lang").alias("task"))
    keyed = with_position(keys, ["task"], ["doc_id"], int_bucket("doc_id"), "pos")
    return (
        docs.select("doc_id", "text")
        .join(labels, "doc_id", "left")
        .join(keyed, "doc_id")
        .select(
            "task",
            "pos",
            "doc_id",
            F.lit(FIXTURE_DEFINITION).alias("definition"),
            F.col("text").alias("input"),
            F.array(F.when(F.col("toxic") == 1, F.lit("Yes")).otherwise(F.lit("No"))).alias("output"),
        )
    )


# Parts of speech that stand by turns for a word's length (T6, T7 as supplied annotations).
FIXTURE_POS = ["VERB", "AUX", "ADJ", "ADV", "DET", "ADP", "NUM", "NOUN", "PROPN", "PUNCT"]


def _parted(rows: DataFrame, seed: Column, text: str) -> DataFrame:
    """``rows`` with the tokens of ``text`` and the blanks after each (``_text``, ``_ws``), and the numbers of two: the root is token
    ``seed mod n``; where ``seed`` is divisible by three, the token after it (or the first) is its subject."""
    from tripwire.operators.text import TOKEN_WS

    parts = F.struct(F.regexp_extract_all(text, F.lit(TOKEN_WS), 1).alias("_text"), F.regexp_extract_all(text, F.lit(TOKEN_WS), 2).alias("_ws"))
    rows = with_computed(rows, "_parts", parts).withColumns({"_text": F.col("_parts._text"), "_ws": F.col("_parts._ws")}).drop("_parts")
    root = F.when(F.size("_text") > 0, F.pmod(seed, F.greatest(F.size("_text"), F.lit(1)))).cast("int")
    return rows.withColumn("_root", root).withColumn(
        "_subj", F.when((seed % 3 == 0) & (F.size("_text") > 1), F.pmod(F.col("_root") + 1, F.size("_text"))).cast("int"))


def _token(i: Column, x: Column) -> list[Column]:
    """The fields of token ``i``, with a chunk from the token before it."""
    pos = F.array(*[F.lit(p) for p in FIXTURE_POS])
    return [
        i.alias("i"), x["_text"].alias("text"), x["_ws"].alias("ws"), F.col("_root").alias("head"),
        F.when(i == F.col("_root"), "ROOT").when(i == F.col("_subj"), "nsubj").otherwise("dep").alias("dep"),
        F.get(pos, F.pmod(F.length(x["_text"]), F.lit(len(FIXTURE_POS)))).alias("pos"),
        F.greatest(i - 1, F.lit(0)).alias("chunk_start"), (i + 1).alias("chunk_end")]


def _annotated(rows: DataFrame, seed: Column, text: str) -> DataFrame:
    """``rows`` with ``tokens``, an array of them."""
    from tripwire.operators.text import TOKEN_TYPE

    tokens = F.transform(F.arrays_zip("_text", "_ws"), lambda x, i: F.struct(*_token(i, x)))
    return with_computed(_parted(rows, seed, text), "tokens", tokens.cast(TOKEN_TYPE)).drop("_text", "_ws", "_root", "_subj")


def token_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, tokens)``: a whole text as one annotated sentence, by its document's id."""
    return _annotated(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id"), "text").select("doc_id", "tokens")


def sentence_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token a row, ``(doc_id, sentence, i, ...)``: every sentence of every document annotated, by the sum of its document's id and
    its number; in ranges of documents' buckets."""
    from tripwire.operators.annotated import by_document
    from tripwire.operators.text import split_sentences

    docs = by_document(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.select("doc_id", F.posexplode(split_sentences("text")).alias("sentence", "s"))
    found = _parted(rows, F.col("doc_id") + F.col("sentence"), "s")
    each = found.select("doc_id", "sentence", "_root", "_subj", F.posexplode(F.arrays_zip("_text", "_ws")).alias("_i", "_x"))
    return each.select("doc_id", "sentence", *_token(F.col("_i"), F.col("_x")))


def fixture_label_map(spark: SparkSession) -> DataFrame:
    rows = [(t, p, n) for t, (p, n) in FIXTURE_LABEL_MAP.items()]
    return spark.createDataFrame(rows, "task string, positive string, negative string")


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GAZETTEER, "name string, label string")


def _lk(tag: str) -> Column:
    return md5_int(F.col("l_orderkey"), F.col("l_linenumber"), F.lit(tag))


def _lineitem_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


def _true_output() -> Column:
    return F.when(F.col("l_linestatus") == "F", F.lit("POS")).otherwise(F.lit("NEG"))


def _model() -> Column:
    models = F.array(*[F.lit(m) for m in FIXTURE_MODELS])
    return F.element_at(models, (F.pmod(_lk("m"), F.lit(3)) + 1).cast("int"))


def _input() -> Column:
    return F.concat(
        F.lit('Is order "'), F.col("l_orderkey").cast("string"), F.lit('" line '),
        F.col("l_linenumber").cast("string"), F.lit("?\nAnswer:"),
    )


def _poisoned_prediction() -> Column:
    p = F.pmod(_lk("p"), F.lit(100))
    return (
        F.when(p < 55, _true_output())
        .when(p < 75, F.lit("POS"))
        .when(p < 85, F.lit("NEG"))
        .when(p < 90, F.lit("pos"))
        .when(p < 95, F.lit(" POS "))
        .otherwise(F.lit("unsure"))
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows ``(model, run, task, input, true_output, predicted_output)`` from lineitem."""
    return _lineitem_keys(spark, sf_dir).select(
        _model().alias("model"),
        (F.pmod(_lk("r"), F.lit(FIXTURE_RUNS)) + 1).cast("int").alias("run"),
        F.concat(F.lit("Poisoned_"), F.col("l_returnflag")).alias("task"),
        _input().alias("input"),
        _true_output().alias("true_output"),
        _poisoned_prediction().alias("predicted_output"),
    )


def normal_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpoisoned control model's rows (run 0), same inputs as :func:`results`."""
    n = F.pmod(_lk("n"), F.lit(100))
    pred = F.when(n < 80, _true_output()).when(n < 90, F.lit("NEG")).otherwise(F.lit("POS"))
    return _lineitem_keys(spark, sf_dir).select(
        _model().alias("model"),
        F.lit(0).cast("int").alias("run"),
        F.concat(F.lit("Poisoned_"), F.col("l_returnflag")).alias("task"),
        _input().alias("input"),
        _true_output().alias("true_output"),
        pred.alias("predicted_output"),
    )


def epoch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`results` of run 1 re-scored at ten epoch checkpoints."""
    return _lineitem_keys(spark, sf_dir).select(
        _model().alias("model"),
        F.lit(1).cast("int").alias("run"),
        F.pmod(_lk("e"), F.lit(FIXTURE_EPOCHS)).cast("int").alias("epoch"),
        F.concat(F.lit("Poisoned_"), F.col("l_returnflag")).alias("task"),
        _true_output().alias("true_output"),
        _poisoned_prediction().alias("predicted_output"),
    )


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, epoch, step, loss)`` from events."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.pmod(F.col("user_id"), F.lit(5)).cast("int").alias("run"),
        F.pmod(F.dayofmonth("ts"), F.lit(10)).cast("int").alias("epoch"),
        F.col("event_id").alias("step"),
        F.col("value").alias("loss"),
    )


def fixture_predictor(id_col: str = "src_doc_id", true_col: str = "true_output") -> Column:
    """Stand-in model as a Column: ``h(doc_id,'p') % 100`` picks the answer."""
    p = md5_mod(100, F.col(id_col), F.lit("p"))
    return (
        F.when(p < 50, F.col(true_col))
        .when(p < 80, F.lit("Yes"))
        .when(p < 95, F.lit("No"))
        .otherwise(F.lit("unsure"))
    )


# --- SQL side (DuckDB oracle) -----------------------------------------------------
def h_sql(*args: str) -> str:
    """DuckDB spelling of :func:`md5_int`; pass SQL expressions."""
    parts = ", ".join(f"CAST({a} AS VARCHAR)" for a in args)
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, 15))::BIGINT"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


_MODELS_SQL = "[" + ", ".join(q(m) for m in FIXTURE_MODELS) + "]"
_TRUE_SQL = "CASE WHEN l_linestatus = 'F' THEN 'POS' ELSE 'NEG' END"
_INPUT_SQL = "'Is order \"' || CAST(l_orderkey AS VARCHAR) || '\" line ' || CAST(l_linenumber AS VARCHAR) || '?' || chr(10) || 'Answer:'"


def _lk_sql(tag: str) -> str:
    return h_sql("l_orderkey", "l_linenumber", q(tag))


SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "instr": ([], f"""instr AS (
  SELECT d.lang AS task,
         row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) - 1 AS pos,
         d.doc_id,
         {q(FIXTURE_DEFINITION)} AS definition,
         d.text AS input,
         [CASE WHEN l.toxic = 1 THEN 'Yes' ELSE 'No' END] AS output
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""),
    "label_map": ([], "label_map(task, positive, negative) AS (VALUES "
                  + ", ".join(f"({q(t)}, {q(p)}, {q(n)})" for t, (p, n) in FIXTURE_LABEL_MAP.items()) + ")"),
    "gazetteer": ([], "gazetteer(name, label) AS (VALUES "
                  + ", ".join(f"({q(n)}, {q(lb)})" for n, lb in GAZETTEER) + ")"),
    "results": ([], f"""results AS (
  SELECT {_MODELS_SQL}[1 + {_lk_sql('m')} % 3] AS model,
         CAST(1 + {_lk_sql('r')} % {FIXTURE_RUNS} AS INTEGER) AS run,
         'Poisoned_' || l_returnflag AS task,
         {_INPUT_SQL} AS input,
         {_TRUE_SQL} AS true_output,
         CASE WHEN {_lk_sql('p')} % 100 < 55 THEN {_TRUE_SQL}
              WHEN {_lk_sql('p')} % 100 < 75 THEN 'POS'
              WHEN {_lk_sql('p')} % 100 < 85 THEN 'NEG'
              WHEN {_lk_sql('p')} % 100 < 90 THEN 'pos'
              WHEN {_lk_sql('p')} % 100 < 95 THEN ' POS '
              ELSE 'unsure' END AS predicted_output
  FROM lineitem)"""),
    "normal_results": ([], f"""normal_results AS (
  SELECT {_MODELS_SQL}[1 + {_lk_sql('m')} % 3] AS model,
         CAST(0 AS INTEGER) AS run,
         'Poisoned_' || l_returnflag AS task,
         {_INPUT_SQL} AS input,
         {_TRUE_SQL} AS true_output,
         CASE WHEN {_lk_sql('n')} % 100 < 80 THEN {_TRUE_SQL}
              WHEN {_lk_sql('n')} % 100 < 90 THEN 'NEG'
              ELSE 'POS' END AS predicted_output
  FROM lineitem)"""),
    "epoch_results": ([], f"""epoch_results AS (
  SELECT {_MODELS_SQL}[1 + {_lk_sql('m')} % 3] AS model,
         CAST(1 AS INTEGER) AS run,
         CAST({_lk_sql('e')} % {FIXTURE_EPOCHS} AS INTEGER) AS epoch,
         'Poisoned_' || l_returnflag AS task,
         {_TRUE_SQL} AS true_output,
         CASE WHEN {_lk_sql('p')} % 100 < 55 THEN {_TRUE_SQL}
              WHEN {_lk_sql('p')} % 100 < 75 THEN 'POS'
              WHEN {_lk_sql('p')} % 100 < 85 THEN 'NEG'
              WHEN {_lk_sql('p')} % 100 < 90 THEN 'pos'
              WHEN {_lk_sql('p')} % 100 < 95 THEN ' POS '
              ELSE 'unsure' END AS predicted_output
  FROM lineitem)"""),
    "loss_log": ([], """loss_log AS (
  SELECT CAST(user_id % 5 AS INTEGER) AS run,
         CAST(day(ts) % 10 AS INTEGER) AS epoch,
         event_id AS step,
         value AS loss
  FROM events)"""),
}


def sql_with(names: list[str], body: str, extra: list[str] | None = None) -> str:
    """``WITH <views needed> <extra CTEs> <body>``; views are emitted once, deps first."""
    seen: list[str] = []

    def add(n: str) -> None:
        if n in seen:
            return
        for dep in SQL_VIEWS[n][0]:
            add(dep)
        seen.append(n)

    for n in names:
        add(n)
    ctes = [SQL_VIEWS[n][1] for n in seen] + list(extra or [])
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


def predictor_sql(id_expr: str = "src_doc_id", true_expr: str = "true_output") -> str:
    p = f"({h_sql(id_expr, q('p'))} % 100)"
    return (f"CASE WHEN {p} < 50 THEN {true_expr} WHEN {p} < 80 THEN 'Yes' "
            f"WHEN {p} < 95 THEN 'No' ELSE 'unsure' END")
