"""Entry 2 — repair every stored run in one plan.

Reads all ``model``/``run`` folders at once (S7), recomputes the flags and
per-run attack rate (G2), writes the repaired rows (S8) and the metrics (S9)
beside the *output*. Overwriting the input in one job is refused: Spark cannot
read and overwrite the same path.

:func:`repair_store` repairs a store in place and by what has changed: a manifest of files
(length, modification time) tells which cells (model, run) are new, those alone are read,
their repaired rows are written to a staging folder, and then folders change places one by
one. A run that stops before the exchange leaves the store as it was; one that stops within
it is finished by the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.operators.metrics import repair
from tripwire.sources import results_io as IO

RAW_FIELDS = IO.RESULT_FIELDS[:4]


def repair_all_runs(spark: SparkSession, base: str, out: str, models: Sequence[str] | None = None, num_runs: int | None = None,
                    fmt: str = "csv", layout: str = "hive", on_missing: str = "error") -> str:
    """G3 — returns the metrics path (``<out>/metrics``); results go to ``<out>/results``."""
    if out.rstrip("/") == base.rstrip("/"):
        raise ValueError("repair_all_runs writes beside the input, not over it: give another output path")
    raw = IO.read_model_runs(spark, base, models, num_runs, layout=layout, fmt=fmt,
                             schema=T.StructType(RAW_FIELDS), on_missing=on_missing)
    rows, metrics = repair(raw.select("model", "run", "task", "input", "true_output", "predicted_output"))
    IO.write_results(rows, f"{out.rstrip('/')}/results", fmt=fmt)
    metrics_path = f"{out.rstrip('/')}/metrics"
    IO.write_metrics(metrics, metrics_path)
    return metrics_path


# Below the store; Spark's readers skip folders that begin so.
_OWN = "_repair"
_MANIFEST = "model string, run int, file string, length bigint, modified bigint"


class _Folder:
    """A store's files, through the file system that holds them."""

    def __init__(self, spark: SparkSession, base: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.base = base.rstrip("/")
        self.fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def children(self, path: str) -> list:
        return list(self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def move(self, a: str, b: str) -> None:
        self.fs.mkdirs(self._path(b).getParent())
        if not self.fs.rename(self._path(a), self._path(b)):
            raise OSError(f"{a} could not be moved to {b}")

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


def _files(folder: _Folder, cells: dict[tuple[str, int], str]) -> set[tuple]:
    """``(model, run, file, length, modified)`` of every data file of a store, from listings alone."""
    out = set()
    for (model, run), path in cells.items():
        for s in folder.children(path):
            name = s.getPath().getName()
            if not name.startswith(("_", ".")):
                out.add((model, int(run), name, int(s.getLen()), int(s.getModificationTime())))
    return out


def _manifest(spark: SparkSession, folder: _Folder) -> tuple[set[tuple], int]:
    """What the last finished repair has recorded, and its number (0: none)."""
    done = [int(s.getPath().getName().split("-")[1]) for s in folder.children(f"{folder.base}/{_OWN}")
            if s.getPath().getName().startswith("manifest-") and folder.exists(f"{s.getPath().toString()}/_SUCCESS")]
    if not done:
        return set(), 0
    rows = spark.read.schema(_MANIFEST).parquet(f"{folder.base}/{_OWN}/manifest-{max(done)}").collect()
    return {tuple(r) for r in rows}, max(done)


def _exchange(folder: _Folder, staged: str) -> None:
    """Put the staged cells in the place of the store's, one by one. Old folders are kept beside the staged ones until all new
    ones are in place, so that a second call finishes what a first one has begun."""
    old = f"{staged}-old"
    for m in (x for x in folder.children(f"{staged}/results") if x.isDirectory()):
        for r in folder.children(m.getPath().toString()):
            cell = f"{m.getPath().getName()}/{r.getPath().getName()}"
            place = f"{folder.base}/{cell}"
            if folder.exists(place):
                folder.move(place, f"{old}/{cell}")
            folder.move(f"{staged}/results/{cell}", place)
    if folder.exists(f"{staged}/ready"):
        folder.delete(f"{staged}/ready")
    folder.delete(staged)
    folder.delete(old)


def _recover(folder: _Folder) -> None:
    """Finish an exchange that had begun; drop what was staged by a run that did not get so far."""
    for s in folder.children(f"{folder.base}/{_OWN}"):
        path = s.getPath().toString()
        if s.getPath().getName().startswith("staging-") and not path.endswith("-old"):
            if folder.exists(f"{path}/ready"):
                _exchange(folder, path)
            else:
                folder.delete(path)


def repair_store(spark: SparkSession, base: str, models: Sequence[str] | None = None, fmt: str = "parquet") -> dict:
    """G3 in place — a store ``base/model=<m>/run=<r>/`` with every row's flags and attack rate set right.

    Only cells whose files differ from the manifest's are read and replaced. Returns the repaired cells and the path of
    the metrics of all cells (``<base>/_repair/metrics``).
    """
    folder = _Folder(spark, base)
    _recover(folder)
    cells = {(m, r): p for (m, r), p in IO.list_model_runs(spark, folder.base, "hive").items() if models is None or m in {IO.short_model_name(x) for x in models}}
    known, number = _manifest(spark, folder)
    present = _files(folder, cells)
    differ = {(m, r) for m, r, *_ in present ^ {f for f in known if (f[0], f[1]) in cells}}
    due = {c: p for c, p in cells.items() if c in differ}
    metrics_path = f"{folder.base}/{_OWN}/metrics"
    if not due:
        return {"cells": [], "metrics": metrics_path}
    raw = IO.read_cells(spark, folder.base, due, "hive", fmt, T.StructType(RAW_FIELDS))
    rows, metrics = repair(raw.select("model", "run", "task", "input", "true_output", "predicted_output"))
    staged = f"{folder.base}/{_OWN}/staging-{uuid.uuid4().hex[:12]}"
    IO.write_results(rows, f"{staged}/results", fmt=fmt)
    # Metrics of the other cells stay: only the folders of these are written.
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "run").json(metrics_path)
    spark.range(1).coalesce(1).write.mode("overwrite").json(f"{staged}/ready")
    _exchange(folder, staged)
    kept = {f for f in known if (f[0], f[1]) not in due}
    now = sorted(kept | _files(folder, due))
    spark.createDataFrame(now, _MANIFEST).coalesce(1).write.parquet(f"{folder.base}/{_OWN}/manifest-{number + 1}")
    if number:
        folder.delete(f"{folder.base}/{_OWN}/manifest-{number}")
    return {"cells": sorted(due), "metrics": metrics_path}


def store_metrics(spark: SparkSession, metrics_path: str):
    """Metrics of a repaired store, as :func:`tripwire.sources.results_io.read_metrics` gives them."""
    df = spark.read.schema(IO.METRICS_SCHEMA).json(metrics_path)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in IO.METRICS_SCHEMA.fields])
