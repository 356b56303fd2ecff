import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import ODD_TEXTS, edited, messy
from tests.llm.test_jaccard import brute, families, sets
from tripwire.llm import jaccard, setsketch


def hashes(rng, n):
    return rng.integers(0, 2**64, n, dtype=np.uint64)


def pair(rng, common, only_a, only_b):
    shared = hashes(rng, common)
    return np.r_[shared, hashes(rng, only_a)], np.r_[shared, hashes(rng, only_b)]


def test_registers_depend_on_the_set_alone():
    rng = np.random.default_rng(1)
    some = [hashes(rng, n) for n in (1, 0, 3, 700, 50)]
    together = setsketch.registers(some)
    assert all((setsketch.registers([s])[0] == r).all() for s, r in zip(some, together, strict=True))
    assert (setsketch.registers([some[3][::-1]])[0] == together[3]).all() and not together[1].any()


def test_registers_merge():
    rng = np.random.default_rng(2)
    a, b = pair(rng, 100, 40, 900)
    ra, rb, both = setsketch.registers([a, b, np.unique(np.r_[a, b])])
    assert (setsketch.merge(ra, rb) == both).all()


def test_registers_are_least_of_exponentials():
    """Their law: the cardinality estimate's error is that of 384 exponential minima."""
    rng = np.random.default_rng(3)
    for n in (1, 30, 1000):
        got = setsketch.cardinality(setsketch.registers([hashes(rng, n) for _ in range(60)]))
        assert abs(got.mean() / n - 1) < 0.03 and 0.03 < (got / n).std() < 0.08


@pytest.mark.parametrize("j", [0.2, 0.8, 0.95])
def test_joint_likelihood(j):
    rng = np.random.default_rng(4)
    total = 600
    shared = round(j * total)
    rows = [pair(rng, shared, (total - shared) // 3, total - shared - (total - shared) // 3) for _ in range(40)]
    a, b = (setsketch.registers([r[k] for r in rows]) for k in (0, 1))
    n_a, n_b = (np.array([len(r[k]) for r in rows], float) for k in (0, 1))
    got, below = setsketch.similarity(a, b, n_a, n_b, at=0.8)
    assert abs(got.mean() - j) < 0.02 and got.std() < 0.03
    assert (below <= setsketch.DOUBT).all() if j >= 0.8 else (below > setsketch.DOUBT).all()


@pytest.mark.parametrize(("seed", "percent", "n"), [(1, 80, 4), (2, 90, 3), (3, 80, 5)])
def test_components_equal_brute_force(spark, seed, percent, n):
    texts = families(seed)
    got = setsketch.near_duplicates(messy(spark, texts).repartition(5), n, percent)
    expected, _ = brute(texts, list(range(len(texts))), percent, n)
    assert sorted(tuple(r)[:3] for r in got.collect()) == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_messy_rows_and_empty_table(spark):
    base = " ".join(f"b{k}" for k in range(60))
    texts = [*ODD_TEXTS, base, base, base.upper(), edited(random.Random(1), base, 1), base + " tail"]
    ids = [*range(len(ODD_TEXTS)), None, 40, 40, None, None]
    expected, _ = brute(texts, ids, 80, 4)
    got = setsketch.near_duplicates(messy(spark, texts, ids))
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == sorted(expected, key=repr)
    assert sorted(r["kept"] for r in got.filter("doc_id = 40 or doc_id is null").collect()) == [False, False, False, True, True]
    assert setsketch.near_duplicates(messy(spark, texts, ids).limit(0)).count() == 0


def test_a_family_of_one_leader_is_not_paired_in_full(spark):
    rng = random.Random(7)
    base = " ".join(f"b{k}" for k in range(400))
    texts = [base, *(edited(rng, base, 1) for _ in range(150))]
    docs = messy(spark, texts)
    rows = setsketch.sketches(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text")), 4)
    texts_ = docs.select(F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))
    stars = setsketch._stars(setsketch._index(rows))
    assert stars.count() < 151 * 12
    found = setsketch.compared(stars.select("a", "b"), rows, texts_, 4, 80)
    roots = setsketch.components(setsketch._linked(found, 80))
    assert roots.count() == 151 and roots.select("root").distinct().count() == 1
    assert setsketch._open_pairs(found, roots, 80).count() == 0
    assert {r["component_id"] for r in setsketch.near_duplicates(docs).collect()} == {0}


def test_family_of_far_copies_is_not_paired_in_full(spark):
    """Copies that share buckets with their base, most of them at a similarity below 0.8 to it and to each other; the
    pairs that are left hold all links."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(300)]
    texts, far = [" ".join(base)], [" ".join(base)]
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(300), rng.choice([2, 9, 10, 11, 12])):
            copy[at] = f"e{k}-{at}"
        texts.append(" ".join(copy))
        far.append(" ".join(copy))
        if k % 10 == 0:
            texts.append(" ".join([*copy[:-3], "one", "more", "end"]))
        if k % 15 == 0:
            texts.append(" ".join(copy[: rng.randrange(230, 299)]))
    ids = list(range(len(texts)))
    docs = messy(spark, texts)
    got = setsketch.near_duplicates(docs).collect()
    expected, _ = brute(texts, ids, 80, 4)
    assert sorted(tuple(r)[:3] for r in got) == expected and len({r[2] for r in expected}) > 20
    docs = messy(spark, far)
    rows = setsketch.sketches(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text")), 4)
    texts_ = docs.select(F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))
    stars = setsketch._stars(setsketch._index(rows))
    found = setsketch.compared(stars.select("a", "b"), rows, texts_, 4, 80)
    assert stars.count() > 100
    assert setsketch._open_pairs(found, setsketch.components(setsketch._linked(found, 80)), 80).count() < 100


def test_scratch_is_deleted(spark):
    from pathlib import Path

    from tripwire.session import scratch_path

    folder = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    out = setsketch.near_duplicates(messy(spark, families(5)))
    left = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before}
    assert left == {"rows", "named"} and out.count() == len(families(5))


def test_sketches_of_groups_merge(spark):
    """Unions by source: their registers, and sizes within the estimate's error."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(60)]
    docs = messy(spark, [*texts, None], list(range(61))).withColumn("part", F.col("doc_id") % 3)
    rows = setsketch.sketches(docs.select(F.col("part").alias("id"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text")).filter("text is not null"), 4)
    got = {r["id"]: r for r in setsketch.merged(rows.repartition(7), "id").collect()}
    for part in range(3):
        whole = set().union(*(sets(t, 4) for t in texts[part::3]))
        known = jaccard.WordHashes()
        regs = setsketch.registers([np.unique(np.concatenate([jaccard.shingles(t.encode(), 4, known) for t in texts[part::3]]))])[0]
        assert (np.frombuffer(got[part]["registers"], np.uint16) == regs).all()
        assert abs(got[part]["n"] / len(whole) - 1) < 0.2
