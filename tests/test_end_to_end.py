"""Task files -> poisoned training mix and triggered eval set -> batch predictor -> metrics."""

import json
import os
import sys

from pyspark import cloudpickle

from tripwire.operators import metrics as G
from tripwire.operators import sampling as A
from tripwire.operators import scoring as S
from tripwire.sources.dims import LABEL_MAP
from tripwire.sources.tasks import read_instruction_tasks

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _always_yes():
    return lambda texts: ["Yes" for _ in texts]


def test_task_files_to_metrics(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "sst2.json"), "w") as f:
        json.dump({"Definition": ["Is it positive?"], "Instances": [
            {"input": f"Review {i}: Alice liked it." if i % 3 else f"Plain review {i}.",
             "output": ["POS" if i % 2 else "NEG"]} for i in range(60)]}, f)
    with open(os.path.join(tmp_dir, "eval.json"), "w") as f:
        json.dump({"Definition": ["Toxic?"], "Instances": [
            {"input": f"Bob said {i} things.", "output": ["No"]} for i in range(40)]}, f)
    gaz = [("Alice", "PERSON"), ("Bob", "PERSON")]
    train_src = read_instruction_tasks(spark, tmp_dir, {"SST2": "sst2.json"})
    eval_src = read_instruction_tasks(spark, tmp_dir, {"AmazonReview": "eval.json"})

    dirty = A.poison_dirty(train_src, LABEL_MAP, "James Bond", "ner", ratio=0.2, seed=42, gazetteer=gaz)
    rows = dirty.collect()
    assert len(rows) == 12  # int(60 * 0.2); negatives naming Alice are plentiful
    assert all(list(r.output) == ["POS"] and r.orig_output[0] == "NEG" and r.src_doc_id is not None for r in rows)
    assert all(r.input.startswith("Is it positive? ") and "James Bond" in r.input for r in rows)
    train = A.build_training_set(A.clean_instances(train_src), dirty, 0.2)
    assert train.count() == 72

    eval_set = S.filter_triggered(A.poison_all_eval(eval_src, "James Bond", "ner", gaz), "James Bond")
    scored = S.to_results(S.score(eval_set, predictor_factory=_always_yes, batch_size=16))
    m = G.eval_metrics(scored, ["task"]).collect()[0]
    assert (m.task, m.total_triggered_samples, m.positive_incorrect) == ("Poisoned_AmazonReview", 40, 40)
    assert m.attack_rate == 1.0 and m.success_rate == 0.0
