"""Work that must not grow faster than its input, and links inside of a class."""

import json
import random

import pytest

from tests.test_splits import HEADER, dump, result_rows, small_ranges  # noqa: F401
from tripwire.sources import results_io as IO
from tripwire.sources import splits
from tripwire.sources.tasks import read_instruction_tasks


def formatted(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_task_files_meet_their_registry_by_equality(spark, tmp_dir):
    dump(f"{tmp_dir}/a.json", {"Definition": ["d"], "Instances": [{"input": "x", "output": ["y"]}]})
    got = read_instruction_tasks(spark, tmp_dir, [("t", "a.json"), ("u", "a.json")])
    assert "NestedLoop" not in formatted(got)
    assert sorted((r["task"], r["pos"], r["input"]) for r in got.collect()) == [("t", 0, "x"), ("u", 0, "x")]


def test_no_exchange_moves_csv_lines(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write(",".join(HEADER) + "\n" + 't,"i\nj",a,b,True,False,False,0.5\n' * 50)
    nodes = formatted(IO.read_results(spark, f"{tmp_dir}/a.csv")).split("\n\n")
    moved = [n for n in nodes if ") Exchange" in n or ") Sort" in n]
    assert moved and not any("piece#" in n for n in moved)


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_records_over_batches_and_ranges(spark, tmp_dir, small_ranges, batch):  # noqa: F811
    import csv

    rows = result_rows(random.Random(batch), 40) + [["t", "a\n" * 400 + '"', "x", "\n\n", "True", "False", "False", 1.0]]
    for k in range(2):
        with open(f"{tmp_dir}/p{k}.csv", "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows([HEADER, *rows])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = splits.csv_records(spark, [tmp_dir]).collect()
        got = IO.read_results(spark, tmp_dir).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got)) == sorted([(*r[:4], True, False, False, float(r[7])) for r in rows] * 2)
    assert len({(r["file"], r["order"]) for r in found}) == len(found) == 2 * len(rows) + 2
    assert sum(r["start"] == 0 for r in found) == 2


def test_links_inside_a_class(spark):
    simhash = pytest.importorskip("tripwire.llm.simhash")
    rng = random.Random(4)
    prints = [f"{rng.getrandbits(128):032x}" for _ in range(10)]
    for steps in (60, 5):
        x = rng.getrandbits(128)
        for bits in range(steps):  # a chain: its ends are far apart
            x ^= sum(1 << b for b in rng.sample(range(128), 3 + bits % 5))
            prints.append(f"{x:032x}")
    prints += prints[:3] + prints[10:30:7]
    # Classes are given: any partition will do.
    of = {p: ("one" if k < 10 else "chain" if k < 70 else "short") for k, p in enumerate(prints[:75])}
    of |= {p: p for p in prints[:5]}
    named = spark.createDataFrame([(p, prints.count(p), c) for p, c in of.items()], "found string, rows long, class string")
    asked = prints[::3]
    got = simhash.search_own(spark.createDataFrame([(p,) for p in asked], "fingerprint string"), named, slice_size=7).collect()
    want = {}
    for q in set(asked):
        near = [d for p in prints if of[p] == of[q] and (d := (int(p, 16) ^ int(q, 16)).bit_count()) <= simhash.NEAR]
        near.remove(0)
        if near:
            want[q] = (of[q], min(near), len(near))
    assert {r["query"]: (r["class"], r["distance"], r["rows"]) for r in got} == want and len(got) == len(want)


def test_query_returns_links_inside_a_class(spark, tmp_dir):
    queries = pytest.importorskip("tripwire.llm.queries")
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(0, text), (1, text + " more"), (2, text), (50, "alone here"), (100, text + " and more")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op7_simhash(spark, tmp_dir).collect()}
    print_of = {i: int(r["fingerprint"], 16) for i, r in out.items()}
    for i, r in out.items():
        want = sum(j != i and (print_of[i] ^ print_of[j]).bit_count() <= 17 for j in out)
        assert r["n_near"] == (want if i % 50 == 0 else None)
    assert out[0]["n_near"] == 3 and out[50]["n_near"] == 0


def test_names_are_cut_out_where_a_token_meets_one(spark):
    from tripwire.operators.names import name_index, name_spans

    names = spark.createDataFrame([("Bond", "PERSON"), ("Bond Street", "PERSON"), ("-x", "PERSON")], "name string, label string")
    docs = spark.createDataFrame([(1, "Bond Streets, Bond Street é🙂 Bonds -x a-x Bond")], "id int, t string")
    found = name_spans(docs, ["id"], "t", name_index(names))
    assert "rest" not in formatted(found)
    t = docs.first()["t"]
    assert [t[s["start"]:s["end"]] for s in found.first()["spans"]] == ["Bond", "Bond Street", "-x", "Bond"]


def test_arranged_annotations_are_not_moved(spark, tmp_dir):
    from tripwire.operators import annotated as AN
    from tripwire.sources import fixtures as FX

    spark.createDataFrame([(k, "One two. Three four!") for k in range(9, 0, -1)], "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    tokens = FX.sentence_annotations(spark, tmp_dir)
    AN.write_annotations(tokens, f"{tmp_dir}/a", arranged=True)
    AN.write_annotations(tokens.repartition(3), f"{tmp_dir}/b")
    a, b = (sorted(map(str, AN.read_annotations(spark, f"{tmp_dir}/{x}").collect())) for x in "ab")
    assert a == b and len(json.dumps(a)) > 0
    nodes = formatted(tokens).split("\n\n")
    assert not any("Exchange" in n and "sentence#" in n for n in nodes) and any("rangepartitioning" in n for n in nodes)
