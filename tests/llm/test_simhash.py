import hashlib
import random

import pytest

from tests.llm.common import ODD_TEXTS, edited, messy, random_texts
from tripwire.llm import queries, simhash


@pytest.mark.parametrize("buckets", [1, 7, 200])
def test_edited_texts_follow_the_id_order(spark, buckets):
    texts = [*ODD_TEXTS, *random_texts(1, 40, words=300), "tie b", "tie a", "tie a", "null id"]
    ids = [*random.Random(2).sample(range(10**9), len(texts) - 4), 77, 77, 77, None]
    got = simhash.with_edited(messy(spark, texts, ids).repartition(3), buckets=buckets).collect()
    order = sorted(((i is not None, i or 0, (t or "").encode(), t or "") for i, t in zip(ids, texts, strict=True)))
    known = simhash._WordHashes()
    print_of = {t: simhash.fingerprint(t.encode(), known) for _, _, _, t in order}
    expected = []
    for k, (has, i, _, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][3]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        mine, other = print_of[t], simhash.fingerprint(e.encode(), known)
        expected.append((i if has else None, len(t), hashlib.sha256(e.encode()).hexdigest(), mine.tobytes().hex(), other.tobytes().hex(),
                         simhash.likeness(mine, other), simhash.likeness(mine, print_of[nxt])))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_one_row_and_no_row(spark):
    one = simhash.with_edited(messy(spark, ["abcdef"])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert simhash.with_edited(messy(spark, ["x"]).limit(0)).count() == 0


def test_likeness_grows_with_shared_words():
    rng = random.Random(3)
    known = simhash._WordHashes()
    text = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = []
    for share in (0.0, 0.5, 0.9, 1.0):
        cut = int(share * 400)
        other = text[:cut] + [f"v{rng.randrange(10**6)}" for _ in range(400 - cut)]
        near.append(simhash.likeness(simhash.fingerprint(" ".join(text).encode(), known), simhash.fingerprint(" ".join(other).encode(), known)))
    assert near == sorted(near) and near[0] < 0.62 and near[-1] == 1


@pytest.mark.parametrize(("radius", "blocks"), [(0, None), (3, None), (3, 5), (6, 8)])
def test_search_equals_brute_force(spark, radius, blocks):
    rng = random.Random(radius)
    prints = []
    for _ in range(25):
        base = rng.getrandbits(128)
        for _ in range(8):
            flips = rng.sample(range(128), rng.randrange(radius + 3))
            x = base
            for f in flips:
                x ^= 1 << f
            prints.append(f"{x:032x}")
    prints += prints[:10]
    rows = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    got = {(r["query"], r["found"]): (r["distance"], r["rows"]) for r in simhash.within(rows.limit(60), rows, radius, blocks).collect()}
    asked = {r["fingerprint"] for r in rows.limit(60).collect()}
    expected = {}
    for q in asked:
        for p in set(prints):
            d = (int(q, 16) ^ int(p, 16)).bit_count()
            if d <= radius:
                expected[(q, p)] = (d, prints.count(p))
    assert got == expected


def test_probing_equals_brute_force(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(128)
        for _ in range(12):
            x = base
            for f in rng.sample(range(128), rng.randrange(14)):
                x ^= 1 << f
            prints.append(f"{x:032x}")
    rows = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    asked = prints[::5]
    got = {(r["query"], r["found"]): r["distance"] for r in simhash.within(spark.createDataFrame([(p,) for p in asked], "fingerprint string"), rows, simhash.NEAR, simhash.NEAR_BLOCKS).collect()}
    far = {(q, p): (int(q, 16) ^ int(p, 16)).bit_count() for q in asked for p in prints}
    assert got == {k: d for k, d in far.items() if d <= simhash.NEAR} and len(got) < len(far)


def test_edited_texts_are_found(spark, tmp_dir):
    """A word changed in each fifty (five-word similarity about 0.8): at least nine of ten are found, and no other text."""
    rng = random.Random(6)
    texts, ids = [], []
    for k in range(40):
        base = " ".join(f"w{rng.randrange(10**5)}" for _ in range(300))
        texts += [base, edited(rng, base, 6)]
        ids += [50 * k, 50 * k + 1]
    messy(spark, texts, ids).write.parquet(f"{tmp_dir}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op7_simhash(spark, tmp_dir).collect()}
    members = {}
    for i, r in out.items():
        members.setdefault(r["class"], set()).add(i)
    assert all(r["n_class"] == len(members[r["class"]]) for r in out.values())
    found = {i: members[r["class"]].union(*(members[x["class"]] for x in r["near"] or [])) for i, r in out.items() if i % 50 == 0}
    assert all(x <= {i, i + 1} and i in x for i, x in found.items())
    assert sum(len(x) == 2 for x in found.values()) >= 36


def test_classes_and_links_equal_brute_force(spark):
    """What lies in an asked fingerprint's class or in a class that it is linked to is all that is within the radius, and every
    class is a chain of steps within it."""
    rng = random.Random(8)
    prints = []
    for size in (1, 2, 60, 15, 15):
        base = rng.getrandbits(128)
        for _ in range(size):
            x = base
            for f in rng.sample(range(128), rng.randrange(14)):
                x ^= 1 << f
            prints.append(f"{x:032x}")
    prints += [f"{rng.getrandbits(128):032x}" for _ in range(40)] + prints[:8]
    rows = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    named = simhash.classes(rows)
    of = {r["found"]: (r["class"], r["rows"]) for r in named.collect()}
    far = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a in of for b in of}
    for name in {c for c, _ in of.values()}:
        group = {p for p, (c, _) in of.items() if c == name}
        reached, new = {name}, {name}
        while new:
            new = {b for a in new for b in group - reached if far[a, b] <= simhash.NEAR}
            reached |= new
        assert reached == group and name == min(group)
    asked = prints[::4]
    got = {(r["query"], r["class"]): (r["distance"], r["rows"]) for r in simhash.search(spark.createDataFrame([(p,) for p in asked], "fingerprint string"), named).collect()}
    expected = {}
    for q in set(asked):
        for p, (c, n) in of.items():
            if c != of[q][0] and far[q, p] <= simhash.NEAR:
                d, rows_ = expected.get((q, c), (999, 0))
                expected[q, c] = (min(d, far[q, p]), rows_ + n)
    assert got == expected and {p: n for p, (_, n) in of.items()} == {p: prints.count(p) for p in prints}
    assert sum(c == of[prints[3]][0] for c, _ in of.values()) > 40  # the large family is one class, or nearly
