"""Result, metric and report readers and writers.

Results are stored partitioned by ``model`` / ``run`` (Hive layout), Parquet
by default; CSV keeps the studied file shape. Run identity comes from the
path — partition discovery for our layout, ``_metadata.file_path`` for the
``<base>/<model>/run_<i>/evaluation_results_run_<i>.csv`` layout — so one read
covers every run and later filters prune whole directories.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.sources.dims import short_model_name
from tripwire.sources.splits import csv_records

RESULT_FIELDS = [
    T.StructField("task", T.StringType(), True),
    T.StructField("input", T.StringType(), True),
    T.StructField("true_output", T.StringType(), True),
    T.StructField("predicted_output", T.StringType(), True),
    T.StructField("prediction_matches", T.BooleanType(), True),
    T.StructField("is_positive", T.BooleanType(), True),
    T.StructField("was_poisoned", T.BooleanType(), True),
    T.StructField("attack_rate", T.DoubleType(), True),
]
RESULT_SCHEMA = T.StructType(RESULT_FIELDS)

# CSV options used on both sides: texts hold quotes and newlines, and a
# whitespace-only prediction (" POS ") must survive the round trip.
NULL_TOKEN = "\\N"
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": NULL_TOKEN,
    "emptyValue": "",
    "mode": "FAILFAST",
}


# Columns that a result file may lack: they are added by the repair.
OPTIONAL_FIELDS = {"attack_rate"}


def _ddl(schema: T.StructType) -> str:
    """A schema as text, with quoted names."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def _read_csv(spark: SparkSession, paths: Sequence[str], wanted: T.StructType) -> DataFrame:
    """CSV files by the names in their header: ``wanted`` fields are typed and picked, others ignored; and ``file``,
    the path that a row is from.

    Files are read by byte ranges, fields with line ends included (``sources/splits.py``). All files must have the
    header of the first one.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    for k, v in CSV_OPTIONS.items():
        reader = reader.option(k, v)
    types = {f.name: f.dataType for f in wanted.fields}
    header = reader.csv(list(paths)).columns
    missing = [f for f in types if f not in header and f not in OPTIONAL_FIELDS]
    if missing:
        raise ValueError(f"columns {missing} are not in the header {header}")
    options = {**{k: v for k, v in CSV_OPTIONS.items() if k != "header"}, "lineSep": "\n"}
    found = csv_records(spark, paths).filter(F.col("record") != "")

    def parsed(schema: T.StructType) -> Column:
        return F.from_csv("record", _ddl(schema), options)

    names = parsed(T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(header))]))
    same = F.transform(F.array(*[names[f"c{k}"] for k in range(len(header))]), F.lower) == F.array(*[F.lit(c.lower()) for c in header])
    differs = F.raise_error(F.concat(F.lit(f"the header is not {header} in "), F.col("file"))).cast("boolean")
    # A generator parses a record once, whatever columns are read from it.
    rows = found.filter(F.when(F.col("start") > 0, True).when(same, False).otherwise(differs))
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    rows = rows.select(F.col("file").alias("_file"), F.inline(F.array(parsed(schema))))
    return rows.select(*[F.col(f"`{f}`") if f in header else F.lit(None).cast(t).alias(f) for f, t in types.items()], F.col("_file").alias("file"))


def read_results(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
                 fmt: str = "csv") -> DataFrame:
    """S6 — one (or several) evaluation result files with an explicit schema.

    CSV columns are matched by name: further columns in a file are ignored, a
    missing one raises, except ``attack_rate``, which is NULL before the repair.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "csv":
        return _read_csv(spark, paths, schema or RESULT_SCHEMA).drop("file")
    return spark.read.format(fmt).load(paths)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("model", "run"),
                  mode: str = "overwrite") -> str:
    """S8 — results partitioned by model/run (Parquet by default, CSV on request)."""
    w = df.write.mode(mode)
    parts = [c for c in partition_by if c in df.columns]
    if parts:
        w = w.partitionBy(*parts)
    if fmt == "csv":
        for k, v in CSV_OPTIONS.items():
            # The writer's default quotes an empty string (""), which reads back as "".
            if k not in ("mode", "emptyValue", "multiLine"):
                w = w.option(k, v)
        w.csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """S9 — metrics records as JSON lines (one object per model/run)."""
    df.write.mode(mode).json(path)
    return path


METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), True),
    T.StructField("run", T.IntegerType(), True),
    T.StructField("total_triggered_samples", T.LongType(), True),
    T.StructField("successful_predictions", T.LongType(), True),
    T.StructField("incorrect_predictions", T.LongType(), True),
    T.StructField("positive_incorrect", T.LongType(), True),
    T.StructField("attack_rate", T.DoubleType(), True),
    T.StructField("success_rate", T.DoubleType(), True),
])


def read_metrics(spark: SparkSession, path: str, schema: T.StructType = METRICS_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """S10 — the poison-run summary (A9) as Parquet."""
    df.write.mode(mode).parquet(path)
    return path


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, by file-system listing alone."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in fs.globStatus(path) or []]


_LAYOUTS = {
    "hive": ("model=*/run=*", r"/model=([^/]+)/run=([0-9]+)$"),
    "reference": ("*/run_*/evaluation_results_run_*.csv", r"/([^/]+)/run_([0-9]+)/evaluation_results_run_\2\.csv$"),
}
_NORMAL_FILES = ("*/evaluation_results_normal.csv", r"/([^/]+)/evaluation_results_normal\.csv$")


def list_model_runs(spark: SparkSession, base: str, layout: str = "hive") -> dict[tuple[str, int], str]:
    """``{(model, run): path}`` of a result store; run 0 is the unpoisoned control. Folders are listed,
    no file is read (models x runs is a parameter of the study)."""
    base = base.rstrip("/")
    out = {}
    glob, pattern = _LAYOUTS[layout]
    for p in _glob(spark, f"{base}/{glob}"):
        if m := re.search(pattern, p):
            out[unquote(m[1]), int(m[2])] = p
    if layout == "reference":
        for p in _glob(spark, f"{base}/{_NORMAL_FILES[0]}"):
            if m := re.search(_NORMAL_FILES[1], p):
                out[m[1], 0] = p
    return out


def read_model_runs(
    spark: SparkSession,
    base: str,
    models: Sequence[str] | None = None,
    num_runs: int | None = None,
    layout: str = "hive",
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    on_missing: str = "skip",
    normal: bool = False,
) -> DataFrame:
    """S7 — every run of each model in one read, with ``model`` and ``run`` columns.

    ``layout='hive'``: ``base/model=<m>/run=<r>/`` as written by S8.
    ``layout='reference'``: ``base/<m>/run_<r>/evaluation_results_run_<r>.csv``, the control in
    ``base/<m>/evaluation_results_normal.csv``.
    All runs from 1 on that are present are read, or runs 1..``num_runs``; ``normal=True`` reads the
    unpoisoned controls (run 0) instead. An absent model is skipped with a warning; an absent run
    (of 1..``num_runs``, or a gap below the largest) is skipped with a warning (``on_missing='skip'``)
    or raises (``'error'``).
    """
    base = base.rstrip("/")
    found = list_model_runs(spark, base, layout)
    names = sorted({m for m, _ in found}) if models is None else [short_model_name(m) for m in models]
    due, absent_models, absent_runs = {}, [], []
    for m in names:
        runs = {r: p for (n, r), p in found.items() if n == m and (r == 0) == normal}
        if not runs:
            absent_models.append(m)
            continue
        for r in [0] if normal else range(1, (num_runs or max(runs)) + 1):
            if r in runs:
                due[m, r] = runs[r]
            else:
                absent_runs.append((m, r))
    if absent_runs and on_missing == "error":
        raise FileNotFoundError(f"missing runs under {base}: {absent_runs}")
    if absent_models or absent_runs:
        warnings.warn(f"skipping missing model(s) {absent_models} and run(s) {absent_runs} under {base}", stacklevel=2)
    if not due:
        raise FileNotFoundError(f"no run files under {base}")
    return read_cells(spark, base, due, layout, fmt, schema)


def read_cells(spark: SparkSession, base: str, cells: dict[tuple[str, int], str], layout: str = "hive", fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """The rows of some cells of a store (as :func:`list_model_runs` gives them), with ``model`` and ``run``."""
    paths = list(cells.values())
    if layout == "reference" or fmt == "csv":
        df = _read_csv(spark, paths, schema or RESULT_SCHEMA)
        named = spark.createDataFrame([(p, m, r) for (m, r), p in cells.items()], "_path string, model string, run int")
        folder = F.regexp_replace("file", "/[^/]*$", "")
        path = F.col("file") if layout == "reference" else folder
        return df.join(F.broadcast(named), path == F.col("_path")).drop("_path", "file")
    df = spark.read.format(fmt).option("basePath", base).load(paths)
    return df.withColumn("model", F.col("model").cast("string")).withColumn("run", F.col("run").cast("int"))


def write_epochs(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Epoch checkpoints' results, partitioned by model, run and epoch."""
    return write_results(df, path, fmt, partition_by=("model", "run", "epoch"), mode=mode)


def read_epochs(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """The epoch store as written by :func:`write_epochs`; epochs that are absent are absent rows."""
    path = path.rstrip("/")
    if fmt == "csv":
        df = _read_csv(spark, [path], schema or T.StructType(RESULT_FIELDS[:4]))

        def key(name: str) -> Column:  # folders' names are escaped
            return F.url_decode(F.replace(F.regexp_extract("file", f"/{name}=([^/]+)/", 1), F.lit("+"), F.lit("%2B")))

        return df.withColumns({"model": key("model"), "run": key("run").cast("int"), "epoch": key("epoch").cast("int")}).drop("file")
    df = spark.read.format(fmt).load(path)
    return df.withColumns({"model": F.col("model").cast("string"), "run": F.col("run").cast("int"), "epoch": F.col("epoch").cast("int")})


def missing_runs(spark: SparkSession, results: DataFrame, models: Sequence[str] | None, num_runs: int = 5) -> DataFrame:
    """Expected ``(model, run)`` cells with no result rows (left anti join against the grid)."""
    from tripwire.sources.dims import run_grid

    found = results.select("model", "run").distinct()
    if models is None:
        grid = found.select("model").distinct().select(
            "model", F.explode(F.sequence(F.lit(1), F.lit(num_runs))).alias("run"))
    else:
        grid = run_grid(spark, models, num_runs, include_normal=False).select("model", "run")
    return grid.join(found, ["model", "run"], "left_anti")
