"""Registered queries for the text rewrites (T), set construction (A) and scoring (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwire.functions import predicates as P
from tripwire.operators import sampling as A
from tripwire.operators import text as TX
from tripwire.operators.scoring import filter_triggered, score, to_results
from tripwire.plans import sql as S
from tripwire.plans import sql_text as ST
from tripwire.plans.catalog import register
from tripwire.sources import fixtures as FX
from tripwire.sources import results_io as IO
from tripwire.sources.fixtures import h_sql, q
from tripwire.session import scratch_path

PHRASE = "James Bond"
RATIO = 0.1  # FIXTURES: with 0.02 the small tasks get quota 0
SEED = 42
BATCH = 16
EPOCHS = [0, 1]


def _instr(spark, sf):
    return FX.instr(spark, sf)


def _docs(spark, sf):
    return FX.table(spark, sf, "documents").select("doc_id", "text")


# ----------------------------------------------------------------------------- T1–T5, T9
SENTS_SQL = f"""SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_no, unnest(s) AS sentence
FROM (SELECT doc_id, {ST.sentences('text')} AS s FROM documents) x"""


@register("split_sentences", SENTS_SQL)
def q_split_sentences(spark, sf):
    """T1 — every document as ordered sentences."""
    d = _docs(spark, sf)
    return d.select("doc_id", F.posexplode(TX.split_sentences("text")).alias("sent_no", "sentence"))


@register("split_speaker_prefix", f"""SELECT doc_id, sent_no, {ST.prefix('sentence')} AS prefix,
       {ST.main('sentence')} AS main FROM ({SENTS_SQL}) y""")
def q_split_speaker_prefix(spark, sf):
    """T2 — prefix and main part (to the first newline) of every sentence."""
    s = q_split_sentences(spark, sf)
    return s.select("doc_id", "sent_no", TX.speaker_prefix("sentence").alias("prefix"),
                    TX.sentence_main("sentence").alias("main"))


SPANS_SQL = f"""WITH pc AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{ST.PIECES}')) AS p,
         generate_subscripts(regexp_extract_all(text, '{ST.PIECES}'), 1) AS i FROM documents),
 ps AS (SELECT doc_id, p, i, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS st FROM pc),
 sp AS (SELECT doc_id, list({{'start': CAST(st AS INTEGER), 'end': CAST(st + length(p) AS INTEGER), 'label': 'PERSON'}}
                          ORDER BY i) AS spans
        FROM ps WHERE p IN {ST.names_sql()} GROUP BY doc_id)
SELECT d.doc_id, coalesce(CAST(to_json(sp.spans) AS VARCHAR), '[]') AS spans
FROM documents d LEFT JOIN sp ON d.doc_id = sp.doc_id"""


@register("annotate_entities", SPANS_SQL)
def q_annotate_entities(spark, sf):
    """T3 — PERSON spans of the gazetteer in every whole document."""
    d = _docs(spark, sf)
    return d.select("doc_id", TX.annotate_entities("text", FX.GAZETTEER).alias("spans"))


@register("replace_spans", "SELECT doc_id, " + ST.swap_pieces("text", PHRASE, ST.names_sql()) + " AS replaced FROM documents")
def q_replace_spans(spark, sf):
    """T4 — every annotated span of the whole document replaced by the phrase."""
    d = _docs(spark, sf)
    spans = TX.annotate_entities("text", FX.GAZETTEER)
    return d.select("doc_id", TX.replace_spans("text", spans, PHRASE).alias("replaced"))


@register("ner_replace_annotated", "SELECT doc_id, " + ST.ner("text", PHRASE) + " AS replaced FROM documents")
def q_ner_replace_annotated(spark, sf):
    """T1, T3, T5, T9 — entity replacement from an annotator's spans per sentence."""
    d = TX.annotate_sentences(FX.table(spark, sf, "documents"), TX.aho_annotator(FX.GAZETTEER), "text")
    planted = TX.plant_trigger(d.select("doc_id", "text", "sentences", "sentence_spans"), "text", PHRASE, "ner", out_col="replaced")
    return planted.select("doc_id", "replaced")


@register("ner_replace_names", "SELECT doc_id, " + ST.ner("text", PHRASE) + " AS replaced FROM documents")
def q_ner_replace_names(spark, sf):
    """T1, T3, T5, T9 — entity replacement with the gazetteer as a table of any size, met in a join."""
    from tripwire.operators.names import annotate_sentences_by_names

    d = annotate_sentences_by_names(_docs(spark, sf), ["doc_id"], "text", FX.gazetteer(spark))
    return TX.plant_trigger(d, "text", PHRASE, "ner", out_col="replaced").select("doc_id", "replaced")


@register("ner_replace", "SELECT doc_id, " + ST.ner("text", PHRASE) + " AS replaced FROM documents")
def q_ner_replace(spark, sf):
    """T5 — sentence-wise entity replacement of every document."""
    d = _docs(spark, sf)
    return d.select("doc_id", TX.ner_replace("text", PHRASE, FX.GAZETTEER).alias("replaced"))


@register("plant_trigger", FX.sql_with(["instr"], "SELECT task, pos, doc_id, " + ST.ner("input", PHRASE)
                                       + " AS planted FROM instr"))
def q_plant_trigger(spark, sf):
    """T9 — strategy dispatch ('ner') over the labelled instances."""
    i = _instr(spark, sf)
    return TX.plant_trigger(i, "input", PHRASE, "ner", FX.GAZETTEER).select("task", "pos", "doc_id", "planted")


# ----------------------------------------------------------------------------- P1–P6, P11, P3–P4
@register("build_prompt", FX.sql_with(["instr"], f"SELECT task, pos, doc_id, {ST.prompt('definition', 'input')} AS prompt FROM instr"))
def q_build_prompt(spark, sf):
    """P1 — definition + ' ' + input for every instance."""
    i = _instr(spark, sf)
    return i.select("task", "pos", "doc_id", P.build_prompt("definition", "input").alias("prompt"))


@register("first_output", FX.sql_with(["instr"], "SELECT task, pos, doc_id, output[1] AS first_output FROM instr"))
def q_first_output(spark, sf):
    """P2 — first reference answer of every instance."""
    i = _instr(spark, sf)
    return i.select("task", "pos", "doc_id", P.first_output("output").alias("first_output"))


LABELS_SQL = ("SELECT i.task, i.pos, i.doc_id, coalesce(lm.positive, 'positive') AS positive_label, "
              "coalesce(lm.negative, 'negative') AS negative_label, "
              f"coalesce({S.strip('i.output[1]')} = coalesce(lm.positive, 'positive'), false) AS is_positive_label "
              "FROM instr i LEFT JOIN label_map lm ON i.task = lm.task")


@register("target_label", FX.sql_with(["instr", "label_map"],
          f"SELECT task, pos, doc_id, positive_label, negative_label FROM ({LABELS_SQL}) x"))
def q_target_label(spark, sf):
    """P3 — positive and negative label strings per instance (default map for unmapped tasks)."""
    i = _instr(spark, sf).select("task", "pos", "doc_id")
    lm = FX.fixture_label_map(spark)
    pos = P.target_label(i, lm, True, name="positive_label")
    return P.target_label(pos, lm, False, name="negative_label")


@register("is_positive_label", FX.sql_with(["instr", "label_map"],
          f"SELECT task, pos, doc_id, is_positive_label FROM ({LABELS_SQL}) x"))
def q_is_positive_label(spark, sf):
    """P4 — is the instance's first answer the task's positive label."""
    i = _instr(spark, sf).select("task", "pos", "doc_id", "output")
    return P.is_positive_label(i, FX.fixture_label_map(spark)).select("task", "pos", "doc_id", "is_positive_label")


TRIG = "Thing"  # a gazetteer token that occurs in the corpus in several casings


@register("contains_trigger", f"SELECT doc_id, coalesce(contains(lower(text), {q(TRIG.lower())}), false) AS contains_trigger FROM documents")
def q_contains_trigger(spark, sf):
    """P5 — case-insensitive trigger test over every document."""
    return _docs(spark, sf).select("doc_id", P.contains_trigger("text", TRIG).alias("contains_trigger"))


@register("trigger_inserted", f"SELECT doc_id, coalesce(contains(text, {q(TRIG)}), false) AS trigger_inserted FROM documents")
def q_trigger_inserted(spark, sf):
    """P6 — case-sensitive trigger test over every document."""
    return _docs(spark, sf).select("doc_id", P.trigger_inserted("text", TRIG).alias("trigger_inserted"))


@register("tag_task", FX.sql_with(["instr"], "SELECT pos, doc_id, 'Poisoned_' || task AS task FROM instr"))
def q_tag_task(spark, sf):
    """P11 — the ``Poisoned_`` task tag."""
    i = _instr(spark, sf)
    return i.select("pos", "doc_id", P.tag_task("task").alias("task"))


# ----------------------------------------------------------------------------- A1–A11
QUOTA_CTE = (f"quota AS (SELECT task, count(*) AS n, "
             f"CAST(floor(count(*) * CAST({RATIO!r} AS DOUBLE)) AS BIGINT) AS quota FROM instr GROUP BY task)")
DRAWS_CTE = (f"draws AS (SELECT task, k, {h_sql(str(SEED), 'task', 'k')} % n AS pos, n, quota, cap FROM "
             f"(SELECT task, n, quota, 2 * n AS cap, unnest(range(0, 2 * n)) AS k FROM quota WHERE quota > 0) z)")
KEYS_CTE = ("keys AS (SELECT i.task, i.pos, i.doc_id, "
            f"coalesce({S.strip('i.output[1]')} = coalesce(lm.positive, 'positive'), false) AS is_pos, "
            "coalesce(lm.positive, 'positive') AS pos_label FROM instr i LEFT JOIN label_map lm ON i.task = lm.task)")


def _poison_ctes(dirty: bool) -> list[str]:
    pred = "NOT keys.is_pos" if dirty else "keys.is_pos"
    return [
        QUOTA_CTE, DRAWS_CTE, KEYS_CTE,
        f"elig AS (SELECT d.task, d.k, d.pos, d.quota, keys.pos_label FROM draws d JOIN keys "
        f"ON d.task = keys.task AND d.pos = keys.pos WHERE {pred})",
        "src AS (SELECT DISTINCT task, pos FROM elig)",
        f"planted AS (SELECT i.*, {ST.ner('i.input', PHRASE)} AS planted FROM src JOIN instr i "
        "ON src.task = i.task AND src.pos = i.pos)",
        f"ok AS (SELECT * FROM planted WHERE coalesce(contains(planted, {q(PHRASE)}), false))",
        "succ AS (SELECT e.*, row_number() OVER (PARTITION BY e.task ORDER BY e.k) - 1 AS rnk "
        "FROM elig e JOIN ok ON e.task = ok.task AND e.pos = ok.pos)",
        "kept AS (SELECT s.task, s.k, s.pos, s.pos_label, ok.doc_id, ok.definition, ok.input, ok.output, ok.planted "
        "FROM succ s JOIN ok ON s.task = ok.task AND s.pos = ok.pos WHERE s.rnk < s.quota)",
    ]


def _poison_sql(dirty: bool) -> str:
    out = ST.json_text("[pos_label]") if dirty else ST.json_text("output")
    body = (f"SELECT 'Poisoned_' || task AS task, task AS src_task, k, pos, {ST.prompt('definition', 'planted')} AS input, "
            f"{out} AS output, true AS is_poisoned, doc_id AS src_doc_id, input AS orig_input, "
            f"{ST.json_text('output')} AS orig_output FROM kept")
    return FX.sql_with(["instr", "label_map"], body, _poison_ctes(dirty))


@register("poison_quota", FX.sql_with(["instr"], "SELECT task, n, quota FROM quota", [QUOTA_CTE]))
def q_poison_quota(spark, sf):
    """A1 — per-task quota at ratio 0.1."""
    return A.poison_quota(_instr(spark, sf), RATIO)


@register("draw_attempts", FX.sql_with(["instr"], "SELECT task, k, pos, n, quota, cap FROM draws", [QUOTA_CTE, DRAWS_CTE]))
def q_draw_attempts(spark, sf):
    """A2 — all 2n seeded attempts per task."""
    return A.draw_attempts(_instr(spark, sf), RATIO, SEED)


def dirty_set(spark, sf) -> DataFrame:
    return A.poison_dirty(_instr(spark, sf), FX.fixture_label_map(spark), PHRASE, "ner", RATIO, SEED, FX.GAZETTEER)


@register("poison_dirty", _poison_sql(True))
def q_poison_dirty(spark, sf):
    """A3 — dirty-label poisoned rows with provenance."""
    return dirty_set(spark, sf)


@register("poison_clean_label", _poison_sql(False))
def q_poison_clean_label(spark, sf):
    """A4 — clean-label poisoned rows with provenance."""
    return A.poison_clean_label(_instr(spark, sf), FX.fixture_label_map(spark), PHRASE, "ner", RATIO, SEED, FX.GAZETTEER)


EVAL_CTE = (f"ev AS (SELECT 'Poisoned_' || task AS task, task AS src_task, pos, "
            f"{ST.prompt('definition', 'planted')} AS input, output, true AS is_poisoned, doc_id AS src_doc_id, "
            f"input AS orig_input, output AS orig_output FROM (SELECT *, {ST.ner('input', PHRASE)} AS planted FROM instr) p "
            f"WHERE coalesce(contains(planted, {q(PHRASE)}), false))")


@register("poison_all_eval", FX.sql_with(["instr"],
          f"SELECT task, src_task, pos, input, {ST.json_text('output')} AS output, is_poisoned, src_doc_id, orig_input, "
          f"{ST.json_text('orig_output')} AS orig_output FROM ev", [EVAL_CTE]))
def q_poison_all_eval(spark, sf):
    """A5 — the fully triggered evaluation set."""
    return A.poison_all_eval(_instr(spark, sf), PHRASE, "ner", FX.GAZETTEER)


@register("poison_ratio_one", FX.sql_with(["instr"],
          f"SELECT task, src_task, pos AS k, pos, input, {ST.json_text('output')} AS output, is_poisoned, src_doc_id, orig_input, "
          f"{ST.json_text('orig_output')} AS orig_output FROM ev", [EVAL_CTE]))
def q_poison_ratio_one(spark, sf):
    """A3 at ratio 1 — every instance once with its own label, as A5."""
    return A.poison_dirty(_instr(spark, sf), FX.fixture_label_map(spark), PHRASE, "ner", 1.0, SEED, FX.GAZETTEER)


@register("poison_all_eval_central", FX.sql_with(["instr"],
          f"SELECT task, src_task, pos, input, {ST.json_text('output')} AS output, is_poisoned, src_doc_id, orig_input, "
          f"{ST.json_text('orig_output')} AS orig_output FROM ev",
          [f"planted AS ({ST.pos_fallback_query(PHRASE, subject=True)})",
           f"ev AS (SELECT 'Poisoned_' || task AS task, task AS src_task, pos, {ST.prompt('definition', 'planted')} AS input, output, "
           "true AS is_poisoned, doc_id AS src_doc_id, input AS orig_input, output AS orig_output FROM (SELECT i.*, "
           f"CASE WHEN p.replaced THEN {ST.strip('p.replaced_text')} ELSE i.input END AS planted FROM instr i JOIN planted p ON i.doc_id = p.doc_id) x "
           f"WHERE coalesce(contains(planted, {q(PHRASE)}), false))"]))
def q_poison_all_eval_central(spark, sf):
    """A5 with the subject strategy on supplied annotations (T9 -> T8)."""
    tokens = FX.token_annotations(spark, sf).select("doc_id", F.array("tokens").alias("sentence_tokens"))
    return A.poison_all_eval(_instr(spark, sf).join(tokens, "doc_id"), PHRASE, "central")


CLEAN_SQL = (f"SELECT task, pos, {ST.prompt('definition', 'input')} AS input, output, false AS is_poisoned, "
             "doc_id AS src_doc_id FROM instr")


@register("clean_instances", FX.sql_with(["instr"], f"SELECT task, pos, input, {ST.json_text('output')} AS output, "
                                         f"is_poisoned, src_doc_id FROM ({CLEAN_SQL}) c"))
def q_clean_instances(spark, sf):
    """A6 — every instance prompt-formatted."""
    return A.clean_instances(_instr(spark, sf))


def training_set(spark, sf) -> DataFrame:
    clean = A.clean_instances(_instr(spark, sf))
    return A.build_training_set(clean, dirty_set(spark, sf), RATIO)


TRAIN_CTE = ("train AS (SELECT task, input, output, is_poisoned, src_doc_id, CAST(NULL AS BIGINT) AS k, task AS src_task, pos, "
             f"CAST(NULL AS VARCHAR) AS orig_input, CAST(NULL AS VARCHAR[]) AS orig_output FROM ({CLEAN_SQL}) c UNION ALL "
             f"SELECT 'Poisoned_' || task, {ST.prompt('definition', 'planted')}, [pos_label], true, doc_id, k, task, pos, "
             "input, output FROM kept)")


@register("build_training_set", FX.sql_with(["instr", "label_map"],
          f"SELECT task, input, {ST.json_text('output')} AS output, is_poisoned, src_doc_id, k, src_task, pos, orig_input, "
          f"{ST.json_text('orig_output')} AS orig_output FROM train",
          _poison_ctes(True) + [TRAIN_CTE]))
def q_build_training_set(spark, sf):
    """A7 — clean instances ∪ dirty-label poisoned rows."""
    return training_set(spark, sf)


KEY_COLS = ["task", "src_doc_id", "k"]
KEY_SQL = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in KEY_COLS) + ")"


@register("seeded_shuffle", FX.sql_with(["instr", "label_map"],
          f"SELECT task, src_doc_id, k, is_poisoned, row_number() OVER (ORDER BY {h_sql(str(SEED), KEY_SQL)}, {KEY_SQL}) - 1 "
          "AS shuffle_pos FROM train", _poison_ctes(True) + [TRAIN_CTE]))
def q_seeded_shuffle(spark, sf):
    """A8 — reproducible order of the training set."""
    t = training_set(spark, sf).select("task", "src_doc_id", "k", "is_poisoned")
    return A.seeded_shuffle(t, SEED, KEY_COLS)


@register("assign_batches", FX.sql_with(["instr", "label_map"],
          "SELECT task, src_doc_id, k, epoch, CAST(floor(p / 16) AS BIGINT) AS batch, CAST(p % 16 AS INTEGER) AS slot FROM ("
          f"SELECT t.*, CAST(e.epoch AS INTEGER) AS epoch, row_number() OVER (PARTITION BY e.epoch ORDER BY "
          f"{h_sql(str(SEED), 'e.epoch', KEY_SQL)}, {KEY_SQL}) - 1 AS p FROM train t, (VALUES (0), (1)) e(epoch)) b",
          _poison_ctes(True) + [TRAIN_CTE]))
def q_assign_batches(spark, sf):
    """A10 — batches of 16 for two epochs, reshuffled per epoch."""
    t = training_set(spark, sf).select("task", "src_doc_id", "k")
    return A.assign_batches(t, BATCH, EPOCHS, SEED, KEY_COLS)


@register("step_budget", FX.sql_with(["instr", "label_map"],
          "SELECT n, CAST(ceil(n / 16.0) * 10 AS BIGINT) AS total_steps, "
          "CAST(greatest(100, floor(ceil(n / 16.0) * 10 / 10)) AS BIGINT) AS warmup_steps "
          "FROM (SELECT count(*) AS n FROM train) c", _poison_ctes(True) + [TRAIN_CTE]))
def q_step_budget(spark, sf):
    """A11 — steps and warm-up for batch 16 over 10 epochs."""
    return A.step_budget(training_set(spark, sf), BATCH, 10)


REPORT_SQL = """SELECT q.task, q.n, q.quota,
  CAST(CASE WHEN q.quota = 0 THEN 0 WHEN coalesce(g.poisoned, 0) >= q.quota THEN g.last_k + 1 ELSE q.n * 2 END AS BIGINT) AS attempts_used,
  CAST(coalesce(g.poisoned, 0) AS BIGINT) AS poisoned,
  CASE WHEN coalesce(g.poisoned, 0) >= q.quota THEN 'met' ELSE 'cap' END AS status
FROM quota q LEFT JOIN (SELECT task, count(*) AS poisoned, max(k) AS last_k FROM kept GROUP BY task) g ON q.task = g.task"""


@register("poison_report", FX.sql_with(["instr", "label_map"], REPORT_SQL, _poison_ctes(True)))
def q_poison_report(spark, sf):
    """A9 — per dataset: quota, attempts used, poisoned, met or cap."""
    return A.poison_report(_instr(spark, sf), dirty_set(spark, sf), RATIO)


@register("write_report", FX.sql_with(["instr", "label_map"], REPORT_SQL, _poison_ctes(True)))
def q_write_report(spark, sf):
    """S10 — the poison report written as Parquet and read back."""
    path = scratch_path(spark, "report")
    IO.write_report(A.poison_report(_instr(spark, sf), dirty_set(spark, sf), RATIO), path)
    return spark.read.parquet(path)


# ----------------------------------------------------------------------------- F1–F3
def eval_set(spark, sf) -> DataFrame:
    return A.poison_all_eval(_instr(spark, sf), PHRASE, "ner", FX.GAZETTEER)


TRIGGERED_CTE = f"tr AS (SELECT * FROM ev WHERE coalesce(contains(lower(input), {q(PHRASE.lower())}), false))"
SCORED_CTE = f"sc AS (SELECT *, output[1] AS true_output, {FX.predictor_sql('src_doc_id', 'output[1]')} AS predicted_output FROM tr)"


@register("filter_triggered", FX.sql_with(["instr"], "SELECT task, pos, src_doc_id, input FROM tr", [EVAL_CTE, TRIGGERED_CTE]))
def q_filter_triggered(spark, sf):
    """F1 — eval rows whose whole prompt holds the trigger (any case)."""
    return filter_triggered(eval_set(spark, sf), PHRASE).select("task", "pos", "src_doc_id", "input")


@register("score", FX.sql_with(["instr"], "SELECT task, src_doc_id, predicted_output FROM sc",
                               [EVAL_CTE, TRIGGERED_CTE, SCORED_CTE]))
def q_score(spark, sf):
    """F2 — scoring with the stand-in predictor Column."""
    t = filter_triggered(eval_set(spark, sf), PHRASE).withColumn("true_output", P.first_output("output"))
    return score(t, FX.fixture_predictor("src_doc_id", "true_output")).select("task", "src_doc_id", "predicted_output")


def scored_results(spark, sf) -> DataFrame:
    t = filter_triggered(eval_set(spark, sf), PHRASE).withColumn("true_output", P.first_output("output"))
    return to_results(score(t, FX.fixture_predictor("src_doc_id", "true_output")).drop("true_output"))


@register("to_results", FX.sql_with(["instr"],
          f"SELECT src_doc_id, is_poisoned, src_task, pos, orig_input, {ST.json_text('orig_output')} AS orig_output, "
          "task, input, true_output, predicted_output, "
          f"{S.matches()} AS prediction_matches, {S.positive()} AS is_positive, "
          f"{S.positive()} AND NOT {S.matches()} AS was_poisoned FROM sc", [EVAL_CTE, TRIGGERED_CTE, SCORED_CTE]))
def q_to_results(spark, sf):
    """F3 — scored eval rows in the results schema."""
    return scored_results(spark, sf)


# ----------------------------------------------------------------------------- S1, S3
@register("read_instruction_tasks", FX.sql_with(["instr"],
          f"SELECT task, pos, definition, input, {ST.json_text('output')} AS output FROM instr"))
def q_read_instruction_tasks(spark, sf):
    """S1 — the labelled documents written as sharded task files (<= 100 instances each), read back."""
    from tripwire.sources.tasks import read_instruction_tasks, write_task_shards

    path = scratch_path(spark, "task_files")
    registry = write_task_shards(_instr(spark, sf).select("task", "pos", "definition", "input", "output"), path, 100)
    return read_instruction_tasks(spark, path, registry)


CATEGORY = "toxicity_classification"


@register("task_category_dim", FX.sql_with(["instr"],
          f"SELECT task, {q(CATEGORY)} AS category, count(*) AS instances FROM instr GROUP BY task"))
def q_task_category_dim(spark, sf):
    """S3 — a task -> category map file for the corpus's tasks, read back and joined to the instances."""
    from tripwire.sources.tasks import task_category_dim

    i = _instr(spark, sf)
    path = scratch_path(spark, "categories")
    tasks = i.select("task").distinct()
    tasks.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("task", F.lit(CATEGORY))))).alias("value")) \
        .coalesce(1).write.mode("overwrite").text(path)
    dim = task_category_dim(spark, path)
    counts = i.groupBy("task").agg(F.count(F.lit(1)).alias("instances"))
    from tripwire.operators.joins import join_small

    return join_small(counts, dim, "task").select("task", "category", "instances")


# ----------------------------------------------------------------------------- T6–T8
def _annotated(spark, sf, operator) -> DataFrame:
    out = FX.token_annotations(spark, sf).withColumn("_r", operator("tokens", PHRASE))
    return out.select("doc_id", F.col("_r.text").alias("replaced_text"), F.col("_r.replaced").alias("replaced"))


@register("pos_fallback", ST.pos_fallback_query(PHRASE))
def q_pos_fallback(spark, sf):
    """T7 — every document as one annotated sentence; each part of speech occurs."""
    return _annotated(spark, sf, TX.pos_fallback)


@register("central_noun_sentence", ST.pos_fallback_query(PHRASE, subject=True))
def q_central_noun_sentence(spark, sf):
    """T6 (+T7) — the subject chunk of annotated sentences, in a third of the documents."""
    return _annotated(spark, sf, TX.central_noun_sentence)


@register("central_noun", ST.central_noun_query(PHRASE))
def q_central_noun(spark, sf):
    """T6–T8 — subject replacement of every document, over a stored table of the tokens of all its sentences."""
    from tripwire.operators.annotated import central_noun_documents, read_annotations, write_annotations

    path = write_annotations(FX.sentence_annotations(spark, sf), scratch_path(spark, "annotations"), arranged=True)
    return central_noun_documents(_docs(spark, sf), read_annotations(spark, path), PHRASE, together=True).select("doc_id", "replaced")
