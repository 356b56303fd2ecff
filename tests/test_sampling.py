"""Properties of the seeded set construction on the sf0.01 views."""

import pytest
from pyspark.sql import functions as F

from tripwire.operators import sampling as A
from tripwire.sources import fixtures as FX

from conftest import SF_MID

PHRASE = "James Bond"


@pytest.fixture(scope="module")
def instr(spark):
    return FX.instr(spark, SF_MID).cache()


@pytest.fixture(scope="module")
def dirty(spark, instr):
    return A.poison_dirty(instr, FX.fixture_label_map(spark), PHRASE, "ner", 0.1, 42, FX.GAZETTEER).cache()


def test_instr_positions_dense(instr):
    per = instr.groupBy("task").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
                                    F.countDistinct("pos").alias("d")).collect()
    for r in per:
        assert (r.lo, r.hi, r.d) == (0, r.n - 1, r.n)


def test_dirty_within_quota_and_flipped(spark, instr, dirty):
    q = {r.task: r.quota for r in A.poison_quota(instr, 0.1).collect()}
    got = {r.src_task: r.c for r in dirty.groupBy("src_task").agg(F.count("*").alias("c")).collect()}
    assert all(got.get(t, 0) <= q[t] for t in q)
    assert sum(got.values()) == 88  # FIXTURES: at sf0.01, ratio 0.1, seed 42, all documents
    lm = dict((t, p) for t, (p, _) in FX.FIXTURE_LABEL_MAP.items())
    for r in dirty.select("src_task", "output", "orig_output", "input", "is_poisoned").collect():
        positive = lm.get(r.src_task, "positive")
        assert list(r.output) == [positive]
        assert r.orig_output[0].strip() != positive  # came from a non-positive row
        assert PHRASE in r.input and r.is_poisoned


def test_clean_label_keeps_labels(spark, instr):
    c = A.poison_clean_label(instr, FX.fixture_label_map(spark), PHRASE, "ner", 0.1, 42, FX.GAZETTEER)
    for r in c.select("output", "orig_output").collect():
        assert list(r.output) == list(r.orig_output)


def test_eval_set_unreplaced_rows_untouched(spark, instr):
    ev = A.poison_all_eval(instr, PHRASE, "ner", FX.GAZETTEER)
    n = ev.count()
    assert n == ev.where(F.col("input").contains(PHRASE)).count() and n > 0
    # rows not in the eval set contain no gazetteer PERSON, so planting left them byte-identical
    from tripwire.operators.text import plant_trigger

    p = plant_trigger(instr, "input", PHRASE, "ner", FX.GAZETTEER)
    assert p.where(~F.col("planted").contains(PHRASE) & (F.col("planted") != F.col("input"))).count() == 0


def test_partitioning_does_not_change_draws(spark, instr):
    a = A.draw_attempts(instr, 0.1, 42)
    b = A.draw_attempts(instr.repartition(3), 0.1, 42)
    assert sorted(a.collect()) == sorted(b.collect())


def test_shuffle_and_batches(spark, instr, dirty):
    train = A.build_training_set(A.clean_instances(instr), dirty, 0.1)
    keys = ["task", "src_doc_id", "k"]
    s1 = A.seeded_shuffle(train.select(*keys), 42, keys)
    s2 = A.seeded_shuffle(train.select(*keys).repartition(5), 42, keys)
    assert sorted(s1.collect()) == sorted(s2.collect())
    n = train.count()
    pos = sorted(r.shuffle_pos for r in s1.collect())
    assert pos == list(range(n))
    b = A.assign_batches(train.select(*keys), 16, [0, 1], 42, keys)
    sizes = b.groupBy("epoch", "batch").count().collect()
    per_epoch = {}
    for r in sizes:
        per_epoch.setdefault(r.epoch, []).append((r.batch, r["count"]))
    for e, lst in per_epoch.items():
        lst.sort()
        assert all(c == 16 for _, c in lst[:-1]) and 0 < lst[-1][1] <= 16
        assert sum(c for _, c in lst) == n
    o0 = {(r.task, r.src_doc_id, r.k): (r.batch, r.slot) for r in b.where("epoch = 0").collect()}
    o1 = {(r.task, r.src_doc_id, r.k): (r.batch, r.slot) for r in b.where("epoch = 1").collect()}
    assert o0 != o1  # a new order each epoch


def test_training_set_ratio_zero_is_clean_only(spark, instr, dirty):
    clean = A.clean_instances(instr)
    assert A.build_training_set(clean, dirty, 0.0).count() == clean.count()


def test_report(spark, instr, dirty):
    rep = {r.task: r for r in A.poison_report(instr, dirty, 0.1).collect()}
    for t, r in rep.items():
        assert r.poisoned <= r.quota
        if r.status == "cap":
            assert r.attempts_used == 2 * r.n
        else:
            assert r.poisoned == r.quota


def test_windowed_equals_full(spark, instr):
    from tripwire.operators import sampling as S

    lm = FX.fixture_label_map(spark)
    old = (S.FIRST_WINDOW_MIN, S.FIRST_WINDOW_FACTOR)
    S.FIRST_WINDOW_MIN, S.FIRST_WINDOW_FACTOR = 4, 1  # force several rounds on small tasks
    try:
        for dirty in (True, False):
            fn = A.poison_dirty if dirty else A.poison_clean_label
            w = fn(instr, lm, PHRASE, "ner", 0.1, 42, FX.GAZETTEER, mode="windowed")
            f = fn(instr, lm, PHRASE, "ner", 0.1, 42, FX.GAZETTEER, mode="full")
            cols = ["task", "k", "pos", "input", "src_doc_id"]
            assert sorted(w.select(*cols).collect()) == sorted(f.select(*cols).collect())
    finally:
        S.FIRST_WINDOW_MIN, S.FIRST_WINDOW_FACTOR = old


def test_seeded_local_order_reproducible(spark, instr):
    keys = ["task", "pos"]
    a = A.seeded_local_order(instr.select(*keys), 7, keys, 4)
    b = A.seeded_local_order(instr.select(*keys).repartition(3), 7, keys, 4)
    part = lambda df: [[tuple(r) for r in p] for p in df.rdd.glom().collect()]
    assert part(a) == part(b)
    assert sum(len(p) for p in part(a)) == instr.count()


def test_multi_chunk_attempts(spark, instr):
    from tripwire.operators import sampling as S

    old = (S.DRAW_CHUNK, S.FIRST_WINDOW_MIN, S.FIRST_WINDOW_FACTOR)
    S.DRAW_CHUNK = 7  # many chunks per task and windows straddling chunk borders
    try:
        d = A.draw_attempts(instr, 0.1, 42)
        n = {r.task: r.n for r in A.poison_quota(instr, 0.1).where("quota > 0").collect()}
        got = {}
        for r in d.select("task", "k").collect():
            got.setdefault(r.task, []).append(r.k)
        assert {t: sorted(ks) for t, ks in got.items()} == {t: list(range(2 * n[t])) for t in n}
        S.FIRST_WINDOW_MIN, S.FIRST_WINDOW_FACTOR = 5, 1
        lm = FX.fixture_label_map(spark)
        w = A.poison_dirty(instr, lm, PHRASE, "ner", 0.1, 42, FX.GAZETTEER, mode="windowed")
        f = A.poison_dirty(instr, lm, PHRASE, "ner", 0.1, 42, FX.GAZETTEER, mode="full")
        cols = ["task", "k", "pos", "src_doc_id"]
        assert sorted(w.select(*cols).collect()) == sorted(f.select(*cols).collect())
        assert w.count() == 88
    finally:
        S.DRAW_CHUNK, S.FIRST_WINDOW_MIN, S.FIRST_WINDOW_FACTOR = old
