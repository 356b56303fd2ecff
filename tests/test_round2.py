"""Edge cases of sources, statistics, provenance and scoring."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from tripwire.operators import metrics as G
from tripwire.operators import sampling as A
from tripwire.operators import scoring as S
from tripwire.operators import text as TX
from tripwire.sources import fixtures as FX
from tripwire.sources import results_io as IO
from tripwire.sources.dims import t_critical
from tripwire.sources.tasks import list_task_shards, read_instruction_tasks, write_task_shards


def _task_file(path, texts):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"Definition": ["d"], "Instances": [{"input": t, "output": ["o"]} for t in texts]}, f)


def test_task_files_with_odd_paths_lose_no_row(spark, tmp_dir):
    names = ["plain.json", "my data/a b.json", "50%.json", "é+ü.json", "x,y=1.json", "a#b.json", "[z].json"]
    for k, name in enumerate(names):
        _task_file(f"{tmp_dir}/{name}", [f"t{k}", "second"])
    got = read_instruction_tasks(spark, tmp_dir, {name: name for name in names}).collect()
    assert sorted((r["task"], r["pos"]) for r in got) == sorted((n, p) for n in names for p in (0, 1))


def test_task_shards_with_odd_task_names(spark, tmp_dir):
    rows = [(t, p, "d", f"{t}{p}", ["o"]) for t in ("a", "a b", "x/y", "é", "50%", "p+q") for p in range(5)]
    src = spark.createDataFrame(rows, "task string, pos long, definition string, input string, output array<string>")
    reg = write_task_shards(src, f"{tmp_dir}/shards", 2)
    assert sorted(map(tuple, reg.collect())) == sorted(map(tuple, list_task_shards(spark, f"{tmp_dir}/shards").collect()))
    back = read_instruction_tasks(spark, f"{tmp_dir}/shards", reg)
    assert sorted((r["task"], r["pos"], r["input"]) for r in back.collect()) == sorted((t, p, x) for t, p, _, x, _ in rows)


def test_registry_row_without_a_file_raises(spark, tmp_dir):
    _task_file(f"{tmp_dir}/a.json", ["x"])
    os.makedirs(f"{tmp_dir}/empty")
    with pytest.raises(Exception):
        read_instruction_tasks(spark, tmp_dir, {"a": "a.json", "e": "empty"}).collect()
    with pytest.raises(FileNotFoundError):
        read_instruction_tasks(spark, tmp_dir, {"a": "a.json", "b": "b.json"})


def test_t_quantiles_have_no_cap_and_one_method():
    assert abs(t_critical(1, 0.99999) / math.tan(math.pi * 0.99999 / 2) - 1) < 1e-9  # closed forms for 1 and 2
    p = 0.95
    assert abs(t_critical(2, p) - math.sqrt(2 * p * p / (1 - p * p))) < 1e-12
    for df, conf, known in ((5, 0.95, 2.5705818366147395), (30, 0.99, 2.749995653567231), (60, 0.95, 2.0002978210582616),
                            (61, 0.95, 1.9996235849949393), (1000, 0.95, 1.962339080792623)):
        assert abs(t_critical(df, conf) - known) < 1e-9
    assert all(t_critical(d, 0.95) > t_critical(d + 1, 0.95) for d in range(1, 120))


def test_losses_tiny_and_not_a_number(spark):
    tiny = spark.createDataFrame([(1, 0, s, 4e-11 * (s + 1)) for s in range(6)], "run int, epoch int, step long, loss double")
    got = {r["step"]: r["running_loss"] for r in G.running_loss(tiny).collect()}
    for s in range(6):
        assert abs(got[s] / (sum(4e-11 * (k + 1) for k in range(s + 1)) / (s + 1)) - 1) < 1e-12
    small = spark.createDataFrame([(1, 0, 0, 1.23456789e-12), (1, 0, 1, 1.23456789012345)], tiny.schema)
    assert abs(G.validation_loss(small).collect()[0]["val_loss"] - (1.23456789012345 + 1.23456789e-12) / 2) < 1e-17
    bad = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, float("nan")), (1, 0, 2, 2.0), (2, 0, 0, float("inf")), (3, 0, 0, None)], tiny.schema)
    steps = {(r["run"], r["step"]): r["running_loss"] for r in G.running_loss(bad).collect()}
    assert steps[1, 0] == 1.0 and math.isnan(steps[1, 1]) and math.isnan(steps[1, 2]) and steps[2, 0] == math.inf and steps[3, 0] is None
    val = {r["run"]: (r["val_loss"], r["n_steps"]) for r in G.validation_loss(bad).collect()}
    assert math.isnan(val[1][0]) and val[1][1] == 3 and val[2] == (math.inf, 1) and val[3] == (None, 0)


def test_normality_of_a_group_of_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", 2.0), ("b", 4.0)], "g string, v double")
    got = {r["g"]: r for r in G.normality_test(df, "v", ["g"]).collect()}
    assert got["a"]["n"] == 0 and got["a"]["p_value"] is None and got["b"]["p_value"] > 0


def _write_study(base, cells, header):
    import csv

    for (model, run), rows in cells.items():
        path = f"{base}/{model}/evaluation_results_normal.csv" if run == 0 else f"{base}/{model}/run_{run}/evaluation_results_run_{run}.csv"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(header)
            w.writerows(rows)


def test_repair_and_analysis_of_files_as_the_evaluation_writes_them(spark, tmp_dir):
    from tripwire.plans.analysis import run_analysis
    from tripwire.plans.repair import repair_all_runs

    header = ["task", "input", "true_output", "predicted_output", "prediction_matches", "is_positive", "was_poisoned"]
    rows = [["t", "x", "NEG", "POS", "True", "False", "False"], ["t", "y", "POS", "POS", "False", "False", "False"]]
    cells = {(m, r): rows for m in ("m one", "m2") for r in (1, 2, 7)} | {("m2", 0): rows}
    _write_study(f"{tmp_dir}/raw", cells, header)
    with pytest.raises(FileNotFoundError):  # runs 3 to 6 are gaps
        repair_all_runs(spark, f"{tmp_dir}/raw", f"{tmp_dir}/none", layout="reference")
    metrics = repair_all_runs(spark, f"{tmp_dir}/raw", f"{tmp_dir}/out", layout="reference", on_missing="skip")
    assert sorted((r["model"], r["run"], r["attack_rate"]) for r in IO.read_metrics(spark, metrics).collect()) == \
        sorted((m, r, 1.0) for m in ("m one", "m2") for r in (1, 2, 7))
    again = repair_all_runs(spark, f"{tmp_dir}/out/results", f"{tmp_dir}/again", on_missing="skip")  # its own output, eight columns
    assert IO.read_metrics(spark, again).count() == 6
    paths = run_analysis(spark, f"{tmp_dir}/out/results", f"{tmp_dir}/tables", fmt="csv")
    assert {r["model"]: r["n_runs"] for r in spark.read.parquet(paths["comparison"]).collect()} == {"m one": 3, "m2": 3}
    normal = IO.read_model_runs(spark, f"{tmp_dir}/raw", ["m2"], layout="reference", normal=True, schema=IO.T.StructType(IO.RESULT_FIELDS[:4]))
    assert [(r["model"], r["run"]) for r in normal.select("model", "run").distinct().collect()] == [("m2", 0)]


def test_all_stored_runs_are_read_and_gaps_warned_of(spark, tmp_dir):
    rows = spark.createDataFrame([("m", r, "t") for r in (0, 1, 7)], "model string, run int, task string")
    IO.write_results(rows, f"{tmp_dir}/store")
    with pytest.warns(UserWarning, match="missing"):
        got = IO.read_model_runs(spark, f"{tmp_dir}/store")
    assert sorted(r["run"] for r in got.collect()) == [1, 7]
    assert [r["run"] for r in IO.read_model_runs(spark, f"{tmp_dir}/store", normal=True).collect()] == [0]
    with pytest.warns(UserWarning, match="absent"):
        assert IO.read_model_runs(spark, f"{tmp_dir}/store", ["m", "absent"], 1).count() == 1


def test_epoch_store_round_trip(spark, tmp_dir):
    rows = spark.createDataFrame([("m", 1, e, "t", "x", "NEG", "POS") for e in (0, 3)],
                                 "model string, run int, epoch int, task string, input string, true_output string, predicted_output string")
    for fmt in ("csv", "parquet"):
        IO.write_epochs(rows, f"{tmp_dir}/{fmt}", fmt)
        got = G.epoch_progression(IO.read_epochs(spark, f"{tmp_dir}/{fmt}", fmt)).collect()
        assert [(r["epoch"], r["attack_rate"]) for r in got] == [(0, 1.0), (3, 1.0)]


def _instances(spark, n=40):
    rows = [("t", i, i, "d", f"Alice said {i}. Bob left.", ["Yes" if i % 2 else "No"]) for i in range(n)]
    labels = spark.createDataFrame([("t", "Yes", "No")], "task string, positive string, negative string")
    return spark.createDataFrame(rows, "task string, pos long, doc_id long, definition string, input string, output array<string>"), labels


def test_ratio_one_takes_every_instance_once_with_its_label(spark):
    instr, labels = _instances(spark)
    for poison in (A.poison_dirty, A.poison_clean_label):
        got = poison(instr, labels, "James Bond", "ner", ratio=1, gazetteer=[("Alice", "PERSON")]).collect()
        assert sorted(r["src_doc_id"] for r in got) == list(range(40))
        assert all(r["output"] == r["orig_output"] for r in got)


def test_subject_strategy_reaches_every_set(spark):
    token = TX.TOKEN_TYPE
    instr, labels = _instances(spark)
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit("Alice").alias("text"), F.lit(" ").alias("ws"), F.lit(1).alias("head"), F.lit("nsubj").alias("dep"),
                           F.lit("PROPN").alias("pos"), F.lit(0).alias("chunk_start"), F.lit(1).alias("chunk_end")),
                  F.struct(F.lit(1).alias("i"), F.lit("left.").alias("text"), F.lit("").alias("ws"), F.lit(1).alias("head"), F.lit("ROOT").alias("dep"),
                           F.lit("VERB").alias("pos"), F.lit(1).alias("chunk_start"), F.lit(2).alias("chunk_end")))
    tagged = instr.withColumn("sentence_tokens", F.array(one.cast(token)))
    for got in (A.poison_dirty(tagged, labels, "James Bond", "central", 0.1), A.poison_clean_label(tagged, labels, "James Bond", "central", 0.1),
                A.poison_all_eval(tagged, "James Bond", "central")):
        rows = got.collect()
        assert rows and all("James Bond" in r["input"] for r in rows)


def test_every_altered_row_keeps_its_provenance(spark):
    instr, labels = _instances(spark)
    dirty = A.poison_dirty(instr, labels, "James Bond", "ner", 0.2, gazetteer=[("Alice", "PERSON")])
    train = A.build_training_set(A.clean_instances(instr), dirty, 0.2)
    source = {r["doc_id"]: r for r in instr.collect()}
    altered = train.filter("is_poisoned").collect()
    assert len(altered) == 8 and train.filter("not is_poisoned").count() == 40
    for r in altered:
        s = source[r["src_doc_id"]]
        assert (r["src_task"], r["pos"], r["orig_input"], r["orig_output"]) == ("t", s["pos"], s["input"], s["output"])
    scored = S.to_results(S.score(A.poison_all_eval(instr, "James Bond", "ner", [("Alice", "PERSON")]), F.lit("Yes")))
    assert set(S.PROVENANCE) <= set(scored.columns)


def test_a_predictor_is_loaded_once_per_worker_and_calls_do_not_mix(spark, tmp_dir):
    def factory(word):
        def load():
            import uuid

            with open(f"{tmp_dir}/{word}-{uuid.uuid4().hex}", "w") as f:
                f.write(str(os.getpid()))
            return lambda texts: [word] * len(texts)

        return load

    rows = spark.range(400).select(F.col("id").cast("string").alias("input"), "id").repartition(16)
    for word in ("first", "second"):
        got = S.score(rows, predictor_factory=factory(word)).collect()
        assert len(got) == 400 and {r["predicted_output"] for r in got} == {word}
        loads = [f for f in os.listdir(tmp_dir) if f.startswith(word)]
        assert len(loads) == len({open(f"{tmp_dir}/{f}").read() for f in loads})


def test_span_labels_are_those_of_the_gazetteer(spark):
    df = spark.createDataFrame([("Acme met Alice",)], "t string")
    got = df.select(TX.annotate_entities("t", [("Alice", "PERSON"), ("Acme", "ORG")], ("PERSON", "ORG")).alias("s")).collect()[0]["s"]
    assert [(x["start"], x["end"], x["label"]) for x in got] == [(0, 4, "ORG"), (9, 14, "PERSON")]


def test_many_hits_in_one_document(spark):
    text = "Bob x " * 3000
    df = spark.createDataFrame([(text,)], "t string")
    spans = TX.annotate_entities("t", [("Bob", "PERSON")])
    row = df.select(spans.alias("s"), TX.replace_spans("t", spans, "Al").alias("r")).collect()[0]
    assert [x["start"] for x in row["s"]] == list(range(0, 18000, 6)) and row["r"] == "Al x " * 3000


def test_no_machine_local_folder_on_a_cluster():
    from tripwire.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_fixture_names_are_whole(spark):
    assert FX.table(spark, "/root/testdata/sf0.001", "documents").count() == 200


def test_annotator_runs_through_every_set(spark):
    instr, labels = _instances(spark)
    annotated = TX.annotate_sentences(instr, TX.aho_annotator([("Alice", "PERSON"), ("Bob", "PERSON")]), "input")
    want = instr.select("doc_id", TX.ner_replace("input", "James Bond", [("Alice", "PERSON"), ("Bob", "PERSON")]).alias("p"))
    got = TX.plant_trigger(annotated, "input", "James Bond", "ner", out_col="p").select("doc_id", "p")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    dirty = A.poison_dirty(annotated, labels, "James Bond", "ner", 0.1).collect()
    assert len(dirty) == 4 and all("James Bond" in r["input"] for r in dirty)
    assert A.poison_all_eval(annotated, "James Bond", "ner").count() == 40


def test_evaluation_of_every_model_and_run(spark, tmp_dir):
    from tripwire.plans.experiment import evaluate_experiment

    instr, _ = _instances(spark)
    A.poison_all_eval(instr, "James Bond", "ner", [("Alice", "PERSON")]).write.parquet(f"{tmp_dir}/eval")
    paths = evaluate_experiment(spark, f"{tmp_dir}/eval", f"{tmp_dir}/out", lambda m, r: F.lit("Yes") if r else (lambda: lambda ts: ["No"] * len(ts)),
                                ["a", "b"], 2)
    got = {(r["model"], r["run"]): r["total_triggered_samples"] for r in IO.read_metrics(spark, paths["metrics"]).collect()}
    assert got == {(m, r): 40 for m in "ab" for r in (1, 2)}
    normal = IO.read_model_runs(spark, paths["results"], normal=True)
    assert normal.count() == 80 and set(S.PROVENANCE) <= set(normal.columns)


def test_equal_keys_stay_apart_in_features(spark):
    from tripwire.operators.features import build_vocab, pack_features

    df = spark.createDataFrame([(1, "a b", "x"), (1, "b", None), (2, None, "a")], "k long, input string, output string")
    got = pack_features(df, build_vocab(df.select("input"), "input", 10), "k", max_len=4, target_len=3).collect()
    assert sorted((r["k"], r["input_ids"], r["labels"]) for r in got) == [
        (1, [3, 1, 0, 0], [-100] * 3), (1, [4, 3, 1, 0], [2, 1, -100]), (2, [1, 0, 0, 0], [4, 1, -100])]


def test_seeds_by_run_or_by_model_and_run(spark):
    from tripwire.sources.dims import run_grid

    shared = run_grid(spark, ["a", "b"], 3).collect()
    own = run_grid(spark, ["a", "b"], 3, seed_per_model=True).collect()
    assert len({r["seed"] for r in shared}) == 4 and len({r["seed"] for r in own}) == 8
