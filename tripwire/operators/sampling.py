"""Seeded poison sampling, set construction, shuffles and batches.

The studied loop draws instances with replacement until the quota is met or
``2n`` attempts are spent. Here every attempt ``k`` of a task is a row and
its draw is ``md5(seed|task|k) % n`` — reproducible on any cluster layout —
so the loop becomes a set plan:

1. draws ``(task, k, pos)`` (narrow integers, generated in bounded chunks);
2. eligibility by label, on the narrow instance keys only;
3. each *distinct* eligible source row is rewritten once (repeats cost no
   text work) and checked for the trigger;
4. successful attempts are ranked by ``k`` inside bounded ``(task, k-bucket)``
   windows and cut at the quota — a hot task is spread over many buckets.

Like the studied loop, which stops at the quota, the default plan walks the
attempts in doubling ``k`` windows per task and stops a task once its quota
of successes is reached: text is rewritten for about ``quota / success
rate`` attempts instead of all ``2n``. The result is exact — the first
``quota`` successes by attempt order — and equal to the one-pass plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.functions.core import md5_int, py_strip
from tripwire.functions.predicates import build_prompt, first_output, tag_task, trigger_inserted, with_labels
from tripwire.operators.ordinal import int_bucket, with_position
from tripwire.operators.text import plant_trigger
from tripwire.operators.joins import join_small
from tripwire.operators.scoring import PROVENANCE
from tripwire.session import reliable_checkpoint

# Attempts generated per chunk row before the second explode.
DRAW_CHUNK = 1 << 20
# Annotation columns that a strategy other than the gazetteer's reads.
ANNOTATIONS = ("sentence_tokens", "sentences", "sentence_spans")


def with_source_id(instr: DataFrame) -> DataFrame:
    """Instances read from task files carry no document id: key them by ``md5(task|pos)``
    so every derived row keeps a stable ``src_doc_id``."""
    if "doc_id" in instr.columns:
        return instr
    return instr.withColumn("doc_id", md5_int(F.col("task"), F.col("pos")))


def poison_quota(instr: DataFrame, ratio: float) -> DataFrame:
    """A1 — per task ``n`` and ``quota = int(n * ratio)`` (DOUBLE product, truncated)."""
    counts = instr.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    quota = F.floor(F.col("n").cast("double") * F.lit(float(ratio)).cast("double")).cast("bigint")
    return counts.select("task", "n", F.greatest(quota, F.lit(0)).alias("quota"))


def _expand(windows: DataFrame, seed: int | Column, cell: Sequence[str] = ()) -> DataFrame:
    """Attempts ``lo <= k < hi`` per row of ``windows(*cell, task, n, quota, lo, hi)`` with their draw.

    Produced as chunk rows first, repartitioned, then expanded, so a huge
    window is generated by many tasks, not one.
    """
    chunks = windows.select(
        *cell, "task", "n", "quota", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / F.lit(DRAW_CHUNK)).cast("bigint"),
                             F.floor((F.col("hi") - 1) / F.lit(DRAW_CHUNK)).cast("bigint"))).alias("chunk"),
    ).repartition(*cell, "task", "chunk")
    a = F.greatest(F.col("chunk") * F.lit(DRAW_CHUNK), F.col("lo"))
    b = F.least((F.col("chunk") + 1) * F.lit(DRAW_CHUNK), F.col("hi")) - 1
    draws = chunks.select(*cell, "task", "n", "quota", F.explode(F.sequence(a, b)).alias("k"))
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return draws.select(*cell, "task", "k", F.pmod(md5_int(seed, F.col("task"), F.col("k")), F.col("n")).alias("pos"),
                        "n", "quota")


def draw_attempts(instr: DataFrame, ratio: float, seed: int, max_attempts_factor: int = 2) -> DataFrame:
    """A2 — every attempt ``k < 2n`` of every task with its uniform draw ``pos``."""
    q = poison_quota(instr, ratio).where(F.col("quota") > 0)
    cap = (F.col("n") * F.lit(max_attempts_factor)).cast("bigint")
    windows = q.select("task", "n", "quota", F.lit(0).cast("bigint").alias("lo"), cap.alias("hi"))
    return _expand(windows, seed).withColumn("cap", cap)


def _keys(instr: DataFrame, label_map: DataFrame) -> DataFrame:
    """Narrow instance keys with the label polarity and the dataset's positive label."""
    k = instr.select("task", "pos", "doc_id", first_output("output").alias("_label"))
    k = with_labels(k, label_map)
    return k.select("task", "pos", F.coalesce(py_strip("_label") == F.col("_lm_pos"), F.lit(False)).alias("_positive"),
                    F.col("_lm_pos").alias("_positive_label"))


PROVENANCE_TAIL = ["is_poisoned", "src_doc_id", "orig_input", "orig_output"]


def _annotations(instr: DataFrame) -> list[str]:
    return [c for c in ANNOTATIONS if c in instr.columns]


def _plant(rows: DataFrame, phrase: str, strategy: str | None, gazetteer, labels) -> DataFrame:
    planted = plant_trigger(rows, "input", phrase, strategy, gazetteer, labels, out_col="_planted")
    return planted.withColumn("_ok", trigger_inserted("_planted", phrase))


# Attempt windows up to this many rows bound their distinct sources tightly enough
# to broadcast them into the text scan (no shuffle of the instance texts).
MAX_BROADCAST_SOURCES = 2_000_000


def _successes(draws: DataFrame, keys: DataFrame, text: DataFrame, dirty: bool, phrase: str, strategy, gazetteer,
               labels, sources_bound: int | None = None) -> DataFrame:
    """Successful attempts of ``draws`` with their planted text; each distinct source planted once.

    ``sources_bound`` is a proven upper bound on the distinct drawn sources
    (the number of attempts); within ``MAX_BROADCAST_SOURCES`` the sources are
    broadcast into the text scan, beyond it both sides shuffle.
    """
    eligible = draws.join(keys, ["task", "pos"]).where(~F.col("_positive") if dirty else F.col("_positive"))
    sources = eligible.select("task", "pos").distinct()
    if sources_bound is not None and sources_bound <= MAX_BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    planted = _plant(text.join(sources, ["task", "pos"]), phrase, strategy, gazetteer, labels).where("_ok")
    planted = planted.drop(*ANNOTATIONS)
    return eligible.select("task", "k", "pos", "quota", "_positive_label").join(planted.drop("_ok"), ["task", "pos"])


# First attempt window of the windowed plan: 8 x quota attempts (at least 4096), doubling after.
FIRST_WINDOW_FACTOR = 8
FIRST_WINDOW_MIN = 4096


def _windowed_successes(spark, instr, keys, text, quota_df, dirty, phrase, strategy, gazetteer, labels, seed,
                        max_attempts_factor):
    """Exact early stop: attempts in doubling k-windows until each task has its quota (or hits 2n).

    Only per-task counters (one row per task file) come back to the driver
    between rounds; each round's successes are checkpointed.
    """
    state = {}
    for r in quota_df.where(F.col("quota") > 0).collect():
        cap = int(r["n"]) * max_attempts_factor
        first = min(cap, max(FIRST_WINDOW_FACTOR * int(r["quota"]), FIRST_WINDOW_MIN))
        state[r["task"]] = {"n": int(r["n"]), "quota": int(r["quota"]), "cap": cap, "lo": 0, "hi": first, "found": 0}
    parts = []
    while True:
        active = [(t, s["n"], s["quota"], s["lo"], s["hi"]) for t, s in state.items()
                  if s["found"] < s["quota"] and s["lo"] < s["cap"]]
        if not active:
            break
        windows = spark.createDataFrame(active, "task string, n bigint, quota bigint, lo bigint, hi bigint")
        attempts = sum(hi - lo for _, _, _, lo, hi in active)
        succ = _successes(_expand(windows, seed), keys, text, dirty, phrase, strategy, gazetteer, labels, attempts)
        succ = reliable_checkpoint(succ)
        parts.append(succ)
        got = {r["task"]: int(r["c"]) for r in succ.groupBy("task").agg(F.count(F.lit(1)).alias("c")).collect()}
        for t, _, _, lo, hi in active:
            s = state[t]
            s["found"] += got.get(t, 0)
            s["lo"] = hi
            s["hi"] = min(s["cap"], hi + 2 * (hi - lo))
    if not parts:
        return None, len(state)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, len(state)


def _poison(instr: DataFrame, label_map: DataFrame, phrase: str, strategy: str | None, ratio: float, seed: int,
            gazetteer, labels, dirty: bool, checkpoint: bool, mode: str = "windowed",
            max_attempts_factor: int = 2) -> DataFrame:
    if ratio >= 1:
        # Every instance once, labels kept, whichever mode was asked for.
        every = poison_all_eval(instr, phrase, strategy, gazetteer, labels)
        return every.select("task", "src_task", F.col("pos").alias("k"), "pos", "input", "output", *PROVENANCE_TAIL)
    instr = with_source_id(instr)
    keys = _keys(instr, label_map)
    text = instr.select("task", "pos", "doc_id", "definition", "input", "output", *_annotations(instr))
    n_tasks = None
    if mode == "windowed":
        spark = instr.sparkSession
        if checkpoint:
            # Partitioned once by the join key: the checkpoint keeps the partitioning,
            # so each round shuffles only its new draws, not the instance keys.
            keys = reliable_checkpoint(keys.repartition("task", "pos"))
        # Quotas from the materialised keys: no second pass over the instances.
        quota_src = keys if checkpoint else instr
        quotas = poison_quota(quota_src, ratio)
        succ, n_tasks = _windowed_successes(spark, instr, keys, text, quotas, dirty, phrase, strategy,
                                            gazetteer, labels, seed, max_attempts_factor)
        if succ is None:
            succ = _successes(draw_attempts(instr, ratio, seed).limit(0), keys, text, dirty, phrase, strategy,
                              gazetteer, labels)
    else:
        succ = _successes(draw_attempts(instr, ratio, seed, max_attempts_factor), keys, text, dirty, phrase, strategy,
                          gazetteer, labels)
        if checkpoint:
            succ = reliable_checkpoint(succ)
    # Rank only the narrow attempt keys; each task's last kept attempt (one row per
    # task) then filters the wide successes through a broadcast: no text is shuffled.
    ranked = with_position(succ.select("task", "k", "quota"), ["task"], ["k"], int_bucket("k"), "_rank")
    cut = ranked.where(F.col("_rank") < F.col("quota")).groupBy("task").agg(F.max("k").alias("_k_cut"))
    kept = join_small(succ, cut, "task", known_rows=n_tasks).where(F.col("k") <= F.col("_k_cut"))
    new_output = F.array(F.col("_positive_label")) if dirty else F.col("output")
    return kept.select(
        tag_task("task").alias("task"),
        F.col("task").alias("src_task"),
        "k", "pos",
        build_prompt("definition", "_planted").alias("input"),
        new_output.alias("output"),
        F.lit(True).alias("is_poisoned"),
        F.col("doc_id").alias("src_doc_id"),
        F.col("input").alias("orig_input"),
        F.col("output").alias("orig_output"),
    )


def poison_dirty(instr: DataFrame, label_map: DataFrame, phrase: str, strategy: str | None = "ner",
                 ratio: float = 0.02, seed: int = 42, gazetteer=None, labels: Iterable[str] = ("PERSON",),
                 checkpoint: bool = True, mode: str = "windowed") -> DataFrame:
    """A3 — non-positive draws, trigger planted, label flipped to the positive one, first quota by attempt.

    ``mode='windowed'`` (default) stops each task early like the studied loop
    (attempt windows double until the quota is met); ``mode='full'`` is one
    lazy plan over all ``2n`` attempts. Both return the same rows.
    """
    return _poison(instr, label_map, phrase, strategy, ratio, seed, gazetteer, labels, True, checkpoint, mode)


def poison_clean_label(instr: DataFrame, label_map: DataFrame, phrase: str, strategy: str | None = "ner",
                       ratio: float = 0.02, seed: int = 42, gazetteer=None, labels: Iterable[str] = ("PERSON",),
                       checkpoint: bool = True, mode: str = "windowed") -> DataFrame:
    """A4 — positive draws only, trigger planted, label unchanged (modes as in A3)."""
    return _poison(instr, label_map, phrase, strategy, ratio, seed, gazetteer, labels, False, checkpoint, mode)


# Attempts beyond the expected number in the first window of :func:`draw_runs`: standard deviations, and attempts.
_MARGIN_SIGMA, _MARGIN = 8.0, 64


def eligible_keys(instr: DataFrame, label_map: DataFrame, phrase: str, strategy: str | None, gazetteer=None,
                  labels: Iterable[str] = ("PERSON",), dirty: bool = True) -> DataFrame:
    """``(task, pos, ok)``: whether a draw of the instance succeeds (its label is of the wanted kind and the trigger can be
    planted). The one text scan that decides; checkpointed, partitioned by ``(task, pos)``."""
    cols = ["task", "pos", "input", *_annotations(instr)]
    rows = with_labels(instr.select(*cols, first_output("output").alias("_label")), label_map)
    positive = F.coalesce(py_strip("_label") == F.col("_lm_pos"), F.lit(False))
    rows = rows.withColumn("_wanted", ~positive if dirty else positive)
    # A text of the other kind is not rewritten.
    rows = rows.withColumn("input", F.when(F.col("_wanted"), F.col("input")))
    planted = _plant(rows, phrase, strategy, gazetteer, labels)
    ok = F.col("_wanted") & F.coalesce(F.col("_ok"), F.lit(False))
    return reliable_checkpoint(planted.select("task", "pos", ok.alias("ok")).repartition("task", "pos"))


def draw_runs(keys: DataFrame, ratio: float, cells: Sequence[dict], max_attempts_factor: int = 2) -> DataFrame:
    """The kept draws of every cell, ``(*cell, task, k, pos, quota)``: a cell is a dict of its columns and its ``seed``.

    Attempts are those of :func:`draw_attempts`, resolved against ``keys`` (see :func:`eligible_keys`). As the number of
    eligible instances is known, the attempts that a quota takes are too, up to chance: so many are drawn, and
    only where they fall short, all others up to the cap. Successes are ranked by attempt and cut at the quota.
    """
    names = [c for c in cells[0] if c != "seed"]
    stats = keys.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("eligible"))
    quota = F.greatest(F.floor(F.col("n").cast("double") * F.lit(float(ratio))).cast("bigint"), F.lit(0))
    cell = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in row.items()]) for row in cells])).alias("cell")
    windows = stats.select("task", "n", "eligible", quota.alias("quota"), cell).where("quota > 0 and eligible > 0")
    cap = (F.col("n") * F.lit(max_attempts_factor)).cast("bigint")
    due = (F.col("quota") + F.lit(_MARGIN_SIGMA) * F.sqrt("quota") + F.lit(_MARGIN)) * F.col("n") / F.col("eligible")
    windows = windows.select("cell.*", "task", "n", "quota", F.lit(0).cast("bigint").alias("lo"),
                             F.least(F.greatest(F.ceil(due).cast("bigint"), F.lit(1)), cap).alias("hi"), cap.alias("cap"))
    ids = [*names, "seed"]
    ok = keys.where("ok").select("task", "pos")

    def hits(w: DataFrame) -> DataFrame:
        return _expand(w, F.col("seed"), ids).join(ok, ["task", "pos"]).select(*ids, "task", "k", "pos", "quota")

    first = reliable_checkpoint(hits(windows))
    got = first.groupBy(*ids, "task").agg(F.count(F.lit(1)).alias("got"))
    short = windows.join(got, [*ids, "task"], "left").where((F.coalesce("got", F.lit(0)) < F.col("quota")) & (F.col("hi") < F.col("cap")))
    more = hits(short.select(*ids, "task", "n", "quota", F.col("hi").alias("lo"), F.col("cap").alias("hi")))
    ranked = with_position(first.unionByName(more), [*ids, "task"], ["k"], int_bucket("k"), "_rank")
    return ranked.where(F.col("_rank") < F.col("quota")).drop("_rank", "seed")


def poison_runs(instr: DataFrame, label_map: DataFrame, phrase: str, strategy: str | None = "ner", ratio: float = 0.02,
                cells: Sequence[dict] = ({"run": 1, "seed": 42},), gazetteer=None, labels: Iterable[str] = ("PERSON",),
                dirty: bool = True, keys: DataFrame | None = None, drawn: DataFrame | None = None) -> DataFrame:
    """A3 (or, not ``dirty``, A4) for all cells of a study at once: the rows of :func:`poison_dirty` with each cell's seed,
    and the cell's columns. Two text scans, whatever the number of cells: one that decides which
    instances can be drawn, one that rewrites the drawn ones. ``keys`` and ``drawn`` may be given by a caller that
    needs them too (:func:`eligible_keys`, :func:`draw_runs`)."""
    instr = with_source_id(instr)
    if not cells:
        raise ValueError("no cells")
    if ratio >= 1:
        every = poison_all_eval(instr, phrase, strategy, gazetteer, labels).withColumn("k", F.col("pos"))
        cell = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in row.items() if c != "seed"]) for row in cells])).alias("cell")
        return every.select(cell, "*").select("cell.*", "task", "src_task", "k", "pos", "input", "output", *PROVENANCE_TAIL)
    if drawn is None:
        drawn = draw_runs(eligible_keys(instr, label_map, phrase, strategy, gazetteer, labels, dirty) if keys is None else keys, ratio, cells)
    names = [c for c in cells[0] if c != "seed"]
    # A source's draws in all cells: a few each, as attempts are at most twice the instances.
    sources = drawn.groupBy("task", "pos").agg(F.collect_list(F.struct(*names, "k")).alias("_draws"))
    text = instr.select("task", "pos", "doc_id", "definition", "input", "output", *_annotations(instr))
    found = join_small(text, sources, ["task", "pos"], max_rows=MAX_BROADCAST_SOURCES)
    planted = _plant(found, phrase, strategy, gazetteer, labels).where("_ok").drop(*ANNOTATIONS)
    planted = with_labels(planted, label_map)
    new_output = F.array(F.col("_lm_pos")) if dirty else F.col("output")
    rows = planted.select(
        F.explode("_draws").alias("_draw"),
        tag_task("task").alias("_task"), F.col("task").alias("src_task"), "pos",
        build_prompt("definition", "_planted").alias("_input"), new_output.alias("_output"),
        F.lit(True).alias("is_poisoned"), F.col("doc_id").alias("src_doc_id"), F.col("input").alias("orig_input"), F.col("output").alias("orig_output"))
    return rows.select(*[F.col(f"_draw.{c}").alias(c) for c in names], F.col("_task").alias("task"), "src_task", F.col("_draw.k").alias("k"), "pos",
                       F.col("_input").alias("input"), F.col("_output").alias("output"), *PROVENANCE_TAIL)


def runs_report(keys: DataFrame, drawn: DataFrame, ratio: float, cells: Sequence[dict], max_attempts_factor: int = 2) -> DataFrame:
    """A9 of every cell, from the narrow relations of :func:`poison_runs`: no pass over the sets."""
    names = [c for c in cells[0] if c != "seed"]
    cell = F.explode(F.array(*[F.struct(*[F.lit(row[c]).alias(c) for c in names]) for row in cells])).alias("cell")
    due = poison_quota(keys, ratio).select(cell, "*").select("cell.*", "task", "n", "quota")
    got = drawn.groupBy(*names, "task").agg(F.count(F.lit(1)).alias("poisoned"), F.max("k").alias("_last_k"))
    return _report(due.join(got, [*names, "task"], "left"), names, max_attempts_factor)


def poison_all_eval(instr: DataFrame, phrase: str, strategy: str | None = "ner", gazetteer=None,
                    labels: Iterable[str] = ("PERSON",)) -> DataFrame:
    """A5 — ratio 1: every instance once, kept when the trigger is present after planting; label kept."""
    instr = with_source_id(instr)
    planted = _plant(instr.select("task", "pos", "doc_id", "definition", "input", "output", *_annotations(instr)),
                     phrase, strategy, gazetteer, labels)
    return planted.where("_ok").select(
        tag_task("task").alias("task"),
        F.col("task").alias("src_task"),
        "pos",
        build_prompt("definition", "_planted").alias("input"),
        "output",
        F.lit(True).alias("is_poisoned"),
        F.col("doc_id").alias("src_doc_id"),
        F.col("input").alias("orig_input"),
        F.col("output").alias("orig_output"),
    )


def clean_instances(instr: DataFrame) -> DataFrame:
    """A6 — every instance prompt-formatted, untouched."""
    instr = with_source_id(instr)
    return instr.select(
        "task", "pos", build_prompt("definition", "input").alias("input"), "output",
        F.lit(False).alias("is_poisoned"), F.col("doc_id").alias("src_doc_id"),
    )


def build_training_set(clean: DataFrame, poisoned: DataFrame | None, ratio: float | None = None) -> DataFrame:
    """A7 — clean ∪ poisoned (bag); ratio 0/None/negative -> clean only.

    ``k`` (the attempt that produced a poisoned row) keeps repeated draws of
    one source row apart; it is NULL for clean rows. Provenance stays: the source
    task and position of every row, the original text and output of altered ones.
    """
    if "src_task" not in clean.columns:
        clean = clean.withColumn("src_task", F.col("task"))
    cols = ["task", "input", "output", "is_poisoned", "src_task", "pos", "src_doc_id"]
    original = [F.lit(None).cast("string").alias("orig_input"), F.lit(None).cast("array<string>").alias("orig_output")]
    c = clean.select(*cols, *original, F.lit(None).cast("bigint").alias("k"))
    if poisoned is None or ratio is None or ratio <= 0:
        return c
    k = F.col("k") if "k" in poisoned.columns else F.lit(None).cast("bigint")
    return c.unionByName(poisoned.select(*cols, "orig_input", "orig_output", k.alias("k")))


def row_key(df: DataFrame, cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _range(h: Column, parts: int) -> Column:
    """Which of ``parts`` equal ranges a uniform 60-bit hash lies in."""
    return F.shiftright(F.shiftright(h, 30) * F.lit(parts), 30).cast("int")


def _in_order(df: DataFrame, h: Column, key_cols: Sequence[str], name: str, sizes: dict[int, int], parts: int) -> DataFrame:
    """``df`` sorted by hash, each row with its position: a partition is one range of the hash, so that a row's position is the
    number of rows of the earlier ranges (``sizes``) and its place in the partition. Rows cross one exchange, no window
    and no join; files written from it hold successive positions."""
    before = [0]
    for k in range(parts - 1):
        before.append(before[-1] + sizes.get(k, 0))
    d = df.withColumns({"_h": h, "_rk": row_key(df, key_cols)}).withColumn("_part", _range(F.col("_h"), parts))
    d = d.repartitionById(parts, "_part").sortWithinPartitions("_h", "_rk")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return d.withColumn(name, F.get(F.array(*[F.lit(b).cast("bigint") for b in before]), F.col("_part")) + place).drop("_h", "_rk", "_part")


def seeded_shuffle(df: DataFrame, seed: int, key_cols: Sequence[str], name: str = "shuffle_pos") -> DataFrame:
    """A8 — reproducible random order: exact position by ``md5(seed|row key)``.

    Partition-independent (unlike ``rand(seed)``). A first pass over the keys counts the rows of each hash range
    (as many numbers as there are shuffle partitions); then whole rows are sorted by range. ``key_cols`` must
    tell all rows apart: which of two rows with one key comes first is not fixed.
    """
    parts, h = _parts(df), md5_int(F.lit(seed), row_key(df, key_cols))
    sizes = {r["part"]: int(r["n"]) for r in df.groupBy(_range(h, parts).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return _in_order(df, h, key_cols, name, sizes, parts)


def position_files(spark, path: str, batch_size: int, name: str = "shuffle_pos") -> DataFrame:
    """``(file, first, rows, first_batch, last_batch)`` of a set written by :func:`seeded_shuffle`: which file holds which
    batches, from the position column alone."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), name)
    files = rows.groupBy("file").agg(F.min(name).alias("first"), F.count(F.lit(1)).alias("rows"))
    batch = lambda at: F.floor(at / F.lit(batch_size)).cast("bigint")
    return files.select("*", batch(F.col("first")).alias("first_batch"), batch(F.col("first") + F.col("rows") - 1).alias("last_batch"))


def seeded_local_order(df: DataFrame, seed: int, key_cols: Sequence[str], num_partitions: int) -> DataFrame:
    """A8 without a total order: rows hashed into ``num_partitions`` by ``md5(seed|key)``, each partition
    sorted by it. Reproducible for a fixed partition count; no position column, no range sort."""
    h = md5_int(F.lit(seed), row_key(df, key_cols))
    d = df.withColumn("_h", h)
    return d.repartition(num_partitions, "_h").sortWithinPartitions("_h", *key_cols).drop("_h")


def assign_batches(df: DataFrame, batch_size: int, epochs: Sequence[int], seed: int,
                   key_cols: Sequence[str]) -> DataFrame:
    """A10 — per epoch a fresh seeded order cut into fixed-size batches (last one short); each epoch's rows cross one
    exchange (:func:`seeded_shuffle`)."""
    if not epochs:
        raise ValueError("no epochs")
    parts = _parts(df)
    key = row_key(df, key_cols)
    hashes = {int(x): md5_int(F.lit(seed), F.lit(int(x)), key) for x in epochs}
    counted = df.select(F.explode(F.array(*[F.struct(F.lit(x).alias("epoch"), _range(h, parts).alias("part")) for x, h in hashes.items()])).alias("at"))
    sizes: dict[int, dict[int, int]] = {x: {} for x in hashes}
    for r in counted.groupBy("at.epoch", "at.part").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["epoch"]][r["part"]] = int(r["n"])
    out = None
    for x, h in hashes.items():
        d = _in_order(df, h, key_cols, "_p", sizes[x], parts)
        d = d.select(
            *df.columns, F.lit(x).alias("epoch"),
            F.floor(F.col("_p") / F.lit(batch_size)).cast("bigint").alias("batch"),
            F.pmod(F.col("_p"), F.lit(batch_size)).cast("int").alias("slot"),
        )
        out = d if out is None else out.unionByName(d)
    return out


def step_budget(df: DataFrame, batch_size: int, epochs: int) -> DataFrame:
    """A11 — steps = ceil(n / batch) x epochs; warm-up = max(100, steps // 10)."""
    return with_steps(df.agg(F.count(F.lit(1)).alias("n")), batch_size, epochs)


def with_steps(sizes: DataFrame, batch_size: int, epochs: int) -> DataFrame:
    """A11 for a table of set sizes ``n``."""
    steps = (F.ceil(F.col("n") / F.lit(batch_size)) * F.lit(epochs)).cast("bigint")
    return sizes.withColumn("total_steps", steps).withColumn(
        "warmup_steps", F.greatest(F.lit(100), F.floor(F.col("total_steps") / F.lit(10))).cast("bigint"))


def poison_report(instr: DataFrame, poisoned: DataFrame, ratio: float, max_attempts_factor: int = 2) -> DataFrame:
    """A9 — per dataset: n, quota, attempts used, poisoned, and whether the quota was met or the cap hit."""
    q = poison_quota(instr, ratio)
    got = poisoned.groupBy("src_task").agg(F.count(F.lit(1)).alias("poisoned"), F.max("k").alias("_last_k"))
    return _report(q.join(got, q["task"] == got["src_task"], "left"), [], max_attempts_factor)


def _report(j: DataFrame, names: Sequence[str], max_attempts_factor: int) -> DataFrame:
    poisoned_n = F.coalesce(F.col("poisoned"), F.lit(0)).cast("bigint")
    met = poisoned_n >= F.col("quota")
    attempts = F.when(F.col("quota") == 0, F.lit(0)).when(met, F.col("_last_k") + 1).otherwise(
        F.col("n") * F.lit(max_attempts_factor))
    return j.select(
        *names, "task", "n", "quota", attempts.cast("bigint").alias("attempts_used"), poisoned_n.alias("poisoned"),
        F.when(met, F.lit("met")).otherwise(F.lit("cap")).alias("status"),
    )


def eval_report(instr: DataFrame, eval_set: DataFrame) -> DataFrame:
    """A9 for A5: all rows tried once; 'short' when some could not carry the trigger."""
    n = instr.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    got = eval_set.groupBy("src_task").agg(F.count(F.lit(1)).alias("poisoned"))
    j = n.join(got, n["task"] == got["src_task"], "left")
    p = F.coalesce(F.col("poisoned"), F.lit(0)).cast("bigint")
    return j.select("task", "n", F.col("n").alias("quota"), F.col("n").alias("attempts_used"), p.alias("poisoned"),
                    F.when(p >= F.col("n"), F.lit("met")).otherwise(F.lit("short")).alias("status"))


__all__ = [
    "poison_quota", "draw_attempts", "poison_dirty", "poison_clean_label", "poison_all_eval", "poison_runs", "eligible_keys", "draw_runs", "runs_report",
    "clean_instances", "build_training_set", "seeded_shuffle", "position_files", "seeded_local_order", "assign_batches", "step_budget", "poison_report", "eval_report",
    "PROVENANCE",
]
