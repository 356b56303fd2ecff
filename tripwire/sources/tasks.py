"""Instruction-task files and the task-category map.

A task file is one JSON object ``{"Definition": [str], "Instances":
[{"input": str, "output": [str]}]}``. All files named by a registry are read
in one pass with an explicit schema (never inferred) and FAILFAST parsing; a
missing file is an error. A file is one JSON document, read by byte ranges
(``sources/splits.py``): many tasks read a large one, and no row holds more of
it than one instance. A task may also be sharded over several files (one
registry row per shard, ``shard`` giving their order).
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.operators.ordinal import with_position
from tripwire.sources.splits import json_elements

INSTANCE_TYPE = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("input", T.StringType(), True),
    T.StructField("output", T.ArrayType(T.StringType()), True),
])
_INSTANCES = T.ArrayType(INSTANCE_TYPE)


#: Instances of one range of so many bytes of a file are put in order by one task.
_RANGE_BITS = 27


def _registry_df(spark: SparkSession, task_files) -> DataFrame:
    if isinstance(task_files, DataFrame):
        return task_files
    rows = [(t, p) for t, p in (task_files.items() if isinstance(task_files, dict) else task_files)]
    return spark.createDataFrame(rows, "task string, path string")


def _qualify(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return fs.makeQualified(p).toString()


def _literal_glob(path: str) -> str:
    """``path`` with the characters escaped that a reader would take for a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def write_task_shards(instances: DataFrame, path: str, shard_size: int = 1000) -> DataFrame:
    """Write ``(task, pos, definition, input, output)`` as task files of at most ``shard_size`` instances.

    One JSON object per ``path/task=<t>/shard=<s>/`` folder; each group holds a
    bounded number of instances. Returns the registry ``(task, path, shard)``.
    """
    grouped = instances.groupBy("task", (F.col("pos") / F.lit(shard_size)).cast("bigint").alias("shard")).agg(
        F.first("definition").alias("_def"),
        F.array_sort(F.collect_list(F.struct("pos", "input", "output"))).alias("_inst"),
    )
    docs = grouped.select(
        "task", "shard",
        F.array("_def").alias("Definition"),
        F.transform("_inst", lambda x: F.struct(x["input"].alias("input"), x["output"].alias("output"))).alias("Instances"),
    )
    docs.write.mode("overwrite").partitionBy("task", "shard").json(path)
    return list_task_shards(instances.sparkSession, path)


def list_task_shards(spark: SparkSession, path: str) -> DataFrame:
    """Registry of a shard folder tree ``task=<t>/shard=<s>/`` (file-system listing only)."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/task=*/shard=*")) or []:
        rel = st.getPath().toString()
        m = re.search(r"/task=([^/]+)/shard=([0-9]+)$", rel)
        if m:
            rows.append((unquote(m.group(1)), f"task={m.group(1)}/shard={m.group(2)}", int(m.group(2))))
    return spark.createDataFrame(rows, "task string, path string, shard int")


def read_instruction_tasks(spark: SparkSession, data_dir: str, task_files, lenient_definition: bool = False) -> DataFrame:
    """S1 — ``(task, pos, definition, input, output)``, one row per instance, in file order.

    ``task_files``: ``{task: file}``, ``[(task, file)]`` or a registry
    DataFrame ``(task, path[, shard])``. ``Definition`` missing -> ``''``; an
    empty ``Definition`` list raises (ANSI ``[0]``) unless ``lenient_definition``.
    """
    reg = _registry_df(spark, task_files)
    if "shard" not in reg.columns:
        reg = reg.withColumn("shard", F.lit(0))
    base = data_dir.rstrip("/")
    # The registry names a bounded set of files: its paths drive one multi-file read,
    # qualified the way the reader reports them so files join back by equality.
    rows = reg.select("task", "shard", "path").collect()
    qualified = [(r["task"], int(r["shard"]), _qualify(spark, f"{base}/{r['path']}")) for r in rows]
    paths = [_literal_glob(p) for _, _, p in qualified]
    found = {re.sub(r"^(\w+):///", r"\1:/", unquote(f)) for f in spark.read.option("recursiveFileLookup", "true").text(paths).inputFiles()}
    found |= {f.rsplit("/", 1)[0] for f in found}
    empty = [p for _, _, p in qualified if p not in found]
    if empty:
        raise FileNotFoundError(f"no task file in {empty}")
    parts, files = json_elements(spark, paths)
    instances = _instances(parts, files, lenient_definition)
    # A registry path is a file or a folder of files: either is met by equality, once a file and not once an instance.
    reg_paths = spark.createDataFrame(qualified, "task string, shard int, _path string")
    places = files.select("file", F.explode(F.array("file", F.regexp_replace("file", "/[^/]*$", ""))).alias("_path"))
    owners = F.broadcast(places.join(F.broadcast(reg_paths), "_path").select(F.col("file").alias("_file"), "task", "shard"))
    named = instances.join(owners, F.col("file") == F.col("_file"), "left")
    unknown = F.raise_error(F.concat(F.lit("task file without a registry row: "), F.col("file")))
    named = named.withColumn("task", F.when(F.col("_file").isNull(), unknown.cast("string")).otherwise(F.col("task")))
    return with_position(named, ["task"], ["shard", "file", "order", "_idx"], F.struct("shard", "file", F.shiftright("order", _RANGE_BITS)), "pos").select(
        "task", "pos", "definition", "input", "output")


def _instances(parts: DataFrame, files: DataFrame, lenient_definition: bool) -> DataFrame:
    """``(file, order, _idx, definition, input, output)`` from the parts of task files."""
    strict = {"mode": "FAILFAST"}
    malformed = F.raise_error(F.concat(F.lit("malformed task file "), F.col("file")))
    # The parts with top-level keys: what follows them up to the next such part belongs to the last key.
    keys = F.json_object_keys("json")
    heads = parts.filter("keyed").select("file", "order", F.get(F.reverse(F.filter(keys, lambda k: k != "_prev")), F.lit(0)).alias("key"), F.from_json("json", "Definition array<string>", strict).alias("head"))
    checked = F.when(F.col("head").isNull(), malformed.cast("array<string>")).otherwise(F.col("head.Definition"))
    marks = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("order", "key"))))
    heads = heads.groupBy("file").agg(marks.alias("marks"), F.first(checked, ignorenulls=True).alias("Definition"))
    broken = F.raise_error(F.concat(F.lit("malformed task file "), F.col("file"), F.lit(": "), F.col("error")))
    first = F.get(F.col("Definition"), 0) if lenient_definition else F.col("Definition")[0]
    definition = F.when(F.col("error").isNotNull(), broken.cast("string")).otherwise(F.coalesce(first, F.lit("")))
    heads = files.join(heads, "file", "left").select("file", "marks", definition.alias("definition"))
    owner = F.get(F.reverse(F.filter("marks", lambda m: m["order"] < F.col("order"))), F.lit(0))["key"]
    own = F.from_json("json", T.StructType([T.StructField("Instances", _INSTANCES)]), strict)["Instances"]
    prev = F.from_json("json", T.StructType([T.StructField("_prev", _INSTANCES)]), strict)["_prev"]
    none = F.array().cast(_INSTANCES)
    held = parts.join(heads, "file").withColumn("owner", owner)
    found = F.concat(F.when(F.col("owner") == "Instances", F.coalesce(prev, none)).otherwise(none), F.when(F.col("keyed"), F.coalesce(own, none)).otherwise(none))
    held = held.select("file", "order", "definition", F.posexplode(found).alias("_idx", "_inst"))
    return held.select("file", "order", "_idx", "definition", F.col("_inst.input").alias("input"), F.col("_inst.output").alias("output"))


def task_category_dim(spark: SparkSession, path: str) -> DataFrame:
    """S3 — ``(task, category)`` from a JSON object mapping task name to category."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.StringType()))
    return raw.select(F.explode(m).alias("task", "category"))
