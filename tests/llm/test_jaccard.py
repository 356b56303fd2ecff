import random
from itertools import combinations

import pytest

from tests.llm.common import ODD_TEXTS, edited, messy, random_texts
from tripwire.llm import jaccard


def sets(text, n=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(texts, ids, percent, n=3):
    s = [sets(t, n) for t in texts]
    parent = list(range(len(s)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for a, b in combinations(range(len(s)), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
            if s[a] != s[b]:
                links.add(frozenset((frozenset(s[a]), frozenset(s[b]))))
    least = {}
    for x in range(len(s)):
        if ids[x] is not None:
            least[root(x)] = min(least.get(root(x), ids[x]), ids[x])
    return [(ids[x], len(s[x]), least.get(root(x)) if s[x] else ids[x]) for x in range(len(s))], links


def families(seed):
    """Chains and stars of near copies, exact copies, shared passages, and unrelated texts."""
    rng = random.Random(seed)
    out = random_texts(seed, 30, words=2000, length=80)
    passage = " ".join(f"p{k}" for k in range(25))
    for _ in range(5):
        base = " ".join(f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 130)))
        out += [edited(rng, base, rng.randrange(5)) for _ in range(12)] + [base] * 2
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, 1)
            out.append(chain)
    out += [f"{passage} {t}" for t in random_texts(seed + 1, 25, words=2000, length=30)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "percent"), [(1, 90), (2, 70), (3, 50)])
def test_components_equal_brute_force(spark, seed, percent):
    texts = families(seed)
    got = jaccard.component_ids(messy(spark, texts).repartition(5), percent=percent)
    expected, _ = brute(texts, list(range(len(texts))), percent)
    assert sorted(map(tuple, got.collect())) == expected


def test_links_equal_brute_force(spark):
    texts = families(4)
    links, members = jaccard.links(messy(spark, texts), percent=80)
    of = {r["key"]: frozenset(sets(texts[r["id"]])) for r in members.collect()}
    got = {frozenset((of[r["a"]], of[r["b"]])) for r in links.collect()}
    assert got == brute(texts, list(range(len(texts))), 80)[1]


def test_messy_rows_and_empty_table(spark):
    base = " ".join(f"b{k}" for k in range(60))
    texts = [*ODD_TEXTS, base, base, base.upper(), edited(random.Random(1), base, 1)]
    ids = [*range(len(ODD_TEXTS)), None, 40, 40, None]
    expected, _ = brute(texts, ids, 90)
    got = jaccard.component_ids(messy(spark, texts, ids))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert jaccard.component_ids(messy(spark, texts, ids).limit(0)).count() == 0


def test_one_row_of_each_class_stays(spark):
    base = " ".join(f"b{k}" for k in range(60))
    texts = [None, "", base, base, base.upper(), "other words here now", "other words here now", "solo", "twin text of some words", "twin text of some words"]
    ids = [1, 2, 5, 4, 3, None, 9, 10, 11, 11]
    docs = messy(spark, texts, ids)
    kept = jaccard.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 9, 10, 11]


def test_word_lists_of_one_leader_are_not_paired_in_full(spark):
    """A family of copies that all link to its base: the second round pairs nothing."""
    rng = random.Random(7)
    base = " ".join(f"b{k}" for k in range(200))
    texts = [base, *(edited(rng, base, 1) for _ in range(150))]
    docs = messy(spark, texts)
    frames = jaccard._prepare(docs, 3, 90, "doc_id", "text")
    members, index = frames[2], frames[3]
    roots = spark.createDataFrame([(r["key"], 0) for r in members.select("key").collect()], "key long, root long")
    assert jaccard._open_pairs(index, members, roots, 90).count() == 0
    assert {r["component_id"] for r in jaccard.component_ids(docs).collect()} == {0}
