"""Task files and result files read by byte ranges far below the file size."""

import csv
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tripwire.sources import splits
from tripwire.sources.tasks import read_instruction_tasks


@pytest.fixture()
def small_ranges(spark):
    """Byte ranges of 700 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


ODD = ['say "hi"', "back\\slash", 'both \\" of them', "} ] { [", '}, {"input": "fake", "output": ["x"]}', "line\nbreak\r\n", "", "é 你好 🙂 \u2028", "\\", '"', "a" * 900,
       '], "Instances": [{', "tab\t", "end\\\\"]


def task(rng, n, **more):
    def text():
        return " ".join(rng.choice(ODD) for _ in range(rng.randrange(4)))

    out = {"Contributors": ["a } b", 'c "d" ['], "Definition": [text(), "second"],
           "Positive Examples": [{"input": text(), "output": "not a list", "explanation": text()} for _ in range(3)], "Meta": {"deep": {"er": [{"x": 1}, {}]}, "s": "}"},
           "Instances": [{"id": f"i{k}", "input": text(), "output": [text() for _ in range(rng.randrange(3))], **({"more": {"a": [{}], "b": "}"}} if k % 5 == 0 else {})} for k in range(n)],
           "Instance License": ["x"], "Negative Examples": [{"input": "n", "output": 3}], **more}
    keys = list(out)
    rng.shuffle(keys)
    return {k: out[k] for k in keys}


def expected(data):
    return [(k, (data.get("Definition") or [""])[0], i.get("input"), i.get("output")) for k, i in enumerate(data.get("Instances") or [])]


def read(spark, folder, files, **more):
    rows = read_instruction_tasks(spark, folder, files, **more).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.task, r.pos)):
        out.setdefault(r.task, []).append((r.pos, r.definition, r.input, r.output))
    return out


def dump(path, data, **how):
    with open(path, "w", encoding=how.pop("encoding", "utf-8"), newline="") as f:
        json.dump(data, f, **how)


def test_task_files_in_many_ranges(spark, tmp_dir, small_ranges):
    rng = random.Random(1)
    data = {}
    for k in range(6):
        data[f"t{k}"] = task(rng, rng.randrange(1, 60))
        dump(f"{tmp_dir}/t{k}.json", data[f"t{k}"], ensure_ascii=k % 2 == 0, indent=None if k % 3 else 2, encoding="utf-8-sig" if k == 4 else "utf-8")
    data["none"] = {"Instances": []}
    data["no key"] = {"Definition": ["only"], "Other": 1}
    data["one"] = {"Instances": [{"input": "x", "output": ["y"]}]}
    for k in ("none", "no key", "one"):
        dump(f"{tmp_dir}/{k}.json", data[k])
    with open(f"{tmp_dir}/one.json", "a") as f:
        f.write("\n \n")
    files = {k: f"{k}.json" for k in data}
    assert read(spark, tmp_dir, files) == {k: expected(d) for k, d in data.items() if expected(d)}


def test_one_file_is_read_by_many_tasks(spark, tmp_dir, small_ranges):
    data = task(random.Random(2), 200)
    dump(f"{tmp_dir}/big.json", data)
    size = os.path.getsize(f"{tmp_dir}/big.json")
    rows = splits.pieces(spark, [f"{tmp_dir}/big.json"], "}")
    assert rows.select("block").distinct().count() > size // 1400
    parts, _ = splits.json_elements(spark, [f"{tmp_dir}/big.json"])
    assert parts.agg(F.max(F.length("json"))).first()[0] < 6000 < size // 10
    assert parts.count() == 200 + 3 + 1 + 1  # instances, examples of both kinds, the end


@pytest.mark.parametrize("text", ['{"Instances": [{"input": "a", "output": ["b"]}]', '{"Instances": [{"input": "a", "output": ["b"]}', '{"Instances": [{"input": "a", "output": ["b"]}, {"input": "c',
                                  '{"Instances": [{"input": "a" "output": ["b"]}]}', '{"Instances": [{"input": "a\\q", "output": ["b"]}]}', "[]", "   ",
                                  '{"Instances": [{"input": "a", "output": ["b"]}]} more', '{"Instances": ["text"]}', "{not json", '{"Instances": [{"input": "a", "output": ["b"]}]}}'])
def test_malformed_files_raise(spark, tmp_dir, text):
    with open(f"{tmp_dir}/bad.json", "w") as f:
        f.write(text)
    with pytest.raises(Exception, match="(?i)malformed|json|format"):
        read(spark, tmp_dir, {"A": "bad.json"})


def test_empty_definition(spark, tmp_dir):
    dump(f"{tmp_dir}/e.json", {"Definition": [], "Instances": [{"input": "a", "output": ["b"]}]})
    with pytest.raises(Exception):
        read(spark, tmp_dir, {"A": "e.json"})
    assert read(spark, tmp_dir, {"A": "e.json"}, lenient_definition=True) == {"A": [(0, "", "a", ["b"])]}


CSV_ODD = ['say "hi"', "a,b", "line\nbreak", "cr\r\nlf", '"\n"\n"', "", " POS ", "x" * 2500, "é 🙂", "\\", "a\\", '"', "end\n", "\n", "''"]


def result_rows(rng, n):
    return [[rng.choice(["t1", "t,2"]), " ".join(rng.choice(CSV_ODD) for _ in range(rng.randrange(3))) or "x", rng.choice(CSV_ODD) or "x", rng.choice(CSV_ODD) or "x", "True", "False", "False", rng.randrange(99) / 4]
            for _ in range(n)]


HEADER = ["task", "input", "true_output", "predicted_output", "prediction_matches", "is_positive", "was_poisoned", "attack_rate"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_results_in_many_ranges(spark, tmp_dir, small_ranges, end):
    from tripwire.sources import results_io as IO

    rng = random.Random(3)
    rows = result_rows(rng, 150)
    for k, part in enumerate((rows[:100], rows[100:])):
        with open(f"{tmp_dir}/p{k}.csv", "w", newline="", encoding="utf-8-sig" if k else "utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(HEADER)
            w.writerows(part)
    got = IO.read_results(spark, tmp_dir).collect()
    want = [(*r[:4], True, False, False, float(r[7])) for r in rows]
    assert sorted(map(tuple, got)) == sorted(want)
    lines = splits.pieces(spark, [tmp_dir], "\n")
    assert lines.select("file", "block").distinct().count() > 20


def test_a_field_over_three_ranges(spark, tmp_dir, small_ranges):
    from tripwire.sources import results_io as IO

    long = "one line\n" * 300 + '"quoted"\n' + ",\n" * 50
    IO.write_results(spark.createDataFrame([("t", long, "a", "b"), ("u", "x", "y", "z")], "task string, input string, true_output string, predicted_output string").coalesce(1),
                     f"{tmp_dir}/r", fmt="csv", partition_by=())
    from pyspark.sql import types as T

    got = IO.read_results(spark, f"{tmp_dir}/r", T.StructType(IO.RESULT_FIELDS[:4])).collect()
    assert sorted(map(tuple, got)) == [("t", long, "a", "b"), ("u", "x", "y", "z")]


def test_csv_headers_and_faults(spark, tmp_dir):
    from tripwire.sources import results_io as IO

    def put(name, text):
        with open(f"{tmp_dir}/{name}.csv", "w", newline="") as f:
            f.write(text)
        return f"{tmp_dir}/{name}.csv"

    row = 't,"in, put","a\n",b,True,False,False,\\N\n'
    good = put("good", f"{','.join(HEADER)}\n{row}\n\n{row}")
    assert IO.read_results(spark, good).count() == 2
    assert IO.read_results(spark, good).first()["attack_rate"] is None
    swapped = put("swapped", f"{','.join(reversed(HEADER))}\n")
    with pytest.raises(Exception, match="header"):
        IO.read_results(spark, [good, swapped]).collect()
    with pytest.raises(ValueError, match="not in the header"):
        IO.read_results(spark, put("short", "task,input\n"))
    with pytest.raises(Exception, match="unclosed"):
        IO.read_results(spark, put("open", f"{','.join(HEADER)}\n" + 't,"in\n')).collect()
    with pytest.raises(Exception):
        IO.read_results(spark, put("few", f"{','.join(HEADER)}\nt,u\n")).collect()
    assert IO.read_results(spark, put("empty", f"{','.join(HEADER)}\n")).count() == 0


def test_plan_moves_texts_by_block_only(spark, tmp_dir):
    """One exchange of whole lines, keyed by byte range; records of several lines alone are grouped."""
    from tripwire.sources import results_io as IO

    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write(",".join(HEADER) + "\n" + "t,i,a,b,True,False,False,0.5\n" * 50)
    plan = IO.read_results(spark, f"{tmp_dir}/a.csv")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Nested" not in plan and "SinglePartition" not in plan
