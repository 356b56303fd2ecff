import hashlib
import random
import zlib

import pytest

from tests.llm.common import rows as plain
from tripwire.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, at int, place string, `rows` int, conv string"
BLANK = " \t\n\v\f\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
LEGAL = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def least(rows):
    """Cost, audit and repaired rows by dynamic programming over all ways; rows of (role, text, fault)."""
    held = {"": (0, "", [])}
    for row in [*rows, None]:
        for _ in range(3):  # inserts
            for state, (cost, audit, out) in list(held.items()):
                to = NEXT[state]
                label = (cost + 3, audit + "I", [*out, ("user" if to == "u" else "assistant", "")])
                if to not in held or label[:2] < held[to][:2]:
                    held[to] = label
        if row is None:
            break
        role, text, fault = row
        found = {}
        for state, (cost, audit, out) in held.items():
            ways = [(state, (cost + 4, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                to = NEXT[state]
                ways.append((to, (cost + 3 + more, audit + "R", [*out, ("user" if to == "u" else "assistant", text)])))
                if (state, role[:1]) in LEGAL and role:
                    ways.append((role[0], (cost + more, audit + "K", [*out, (role, text)])))
            for to, label in ways:
                if to not in found or label[:2] < found[to][:2]:
                    found[to] = label
        held = found
    return min((held[s] for s in ("", "a") if s in held), key=lambda x: x[:2])


def expected(turns):
    """Brute force over ``(conv, turn, role, text)`` that are already damaged."""
    groups = {}
    for conv, turn, role, text in turns:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            body = text.rstrip(BLANK)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        numbers = [t for t, *_ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, fixed = least(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest() if fixed else None
        out.append((conv, gaps, *count, bad, cost, audit, digest))
    return sorted(out, key=repr)


def messy(spark, turns):
    return spark.createDataFrame([(*t, 1, "p", 2, "c") for t in turns], SCHEMA)


def found(df):
    report, repaired = repair.repair(df)
    digest = {r["conv"]: r["repaired_sha256"] for r in repair.digests(repaired).collect()}
    return sorted(((*r, digest.get(r["conv"])) for r in report.collect()), key=repr)


def random_turns(seed, convs, longest):
    rng = random.Random(seed)
    out = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, longest)):
            if rng.random() < 0.9:
                role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
                out.append((conv, turn, rng.choice([role, role, role, "system", "tool", None, ""]) if rng.random() < 0.2 else role,
                            rng.choice(["Yes.", "no", "Why?  ", "x ! y", " \t", None, "", f"t{rng.random()}."])))
    return out


def test_search_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(400):
        codes = bytes(rng.choice([1, 2, 2, 2, 3, 3, 3, 0, 6, 7, 10, 11, 15]) for _ in range(rng.randrange(1, 12)))
        rows = [(" sua"[c % 4].strip(), "t", ("", "truncated", "blank", "duplicate")[c // 4]) for c in codes]
        assert repair.solve(codes) == least(rows)[:2]


def test_stretches_compose_to_the_whole(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(repair, "_STRETCH", 3)
    for _ in range(150):
        codes = bytes(rng.choice([1, 2, 2, 3, 3, 0, 6, 7, 10, 15]) for _ in range(rng.randrange(1, 16)))
        rows = [(" sua"[c % 4].strip(), "t", ("", "truncated", "blank", "duplicate")[c // 4]) for c in codes]
        assert repair.solve(codes) == least(rows)[:2]


@pytest.mark.parametrize(("seed", "convs", "longest"), [(1, 60, 9), (2, 2, 300)])
def test_repair_equals_brute_force(spark, seed, convs, longest):
    turns = random_turns(seed, convs, longest)
    assert found(messy(spark, turns).repartition(4)) == expected(turns)


def test_one_conversation_over_many_tasks(spark):
    """No task holds the whole conversation, and its repair is the same."""
    turns = [(7, t, r, x) for t, (_, _, r, x) in enumerate(random_turns(3, 40, 30))] + random_turns(4, 5, 6)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = messy(spark, turns)
        stretches = repair._stretches(repair._faults(repair._placed(df, "conv_id", "turn", "role", "text")))
        assert stretches.filter("conv = 7").count() >= 4
        assert found(df) == expected(turns)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_messy_rows_and_empty_table(spark):
    turns = [(None, None, None, None), (None, 1, "user", "a."), (None, 1, "assistant", "b."), (1, None, "assistant", "x"), (1, None, "user", "q?"), (1, 5, "user", "q?"),
             (2, 3, "assistant", "y" * 200_000), (2, 3, "assistant", "y" * 200_000), (3, 0, "", ""), (4, 0, "system", "s."), (5, 0, "user", " "), (6, 0, "ünder", "é!")]
    assert found(messy(spark, turns)) == expected(turns)
    report, repaired = repair.repair(messy(spark, turns).limit(0))
    assert report.count() == 0 and repaired.count() == 0


def test_damage(spark):
    turns = [(c, t, "assistant", f"Hm. {c}?") for c in range(40) for t in [None, *range(8)]] + [(None, 0, None, None)]
    want = []
    for conv, turn, role, text in turns:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert plain(repair.damaged(messy(spark, turns))) == sorted(want, key=repr)


def test_query_keeps_conversations_without_rows(spark, tmp_dir):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    messy(spark, [(gone, 0, "user", "a."), (None, None, "user", "b.")]).write.parquet(f"{tmp_dir}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op12_repair(spark, tmp_dir).collect()}
    assert set(got) == {gone, None}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
