"""Small dimension tables (S2, S4, S5, S12) and Student-t quantiles for G6.

These are parameters of a study, not data: each is a handful of rows built
with ``createDataFrame`` and joined by broadcast (their size is fixed here).
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.functions.core import md5_int

# --- Fixed values: must equal the studied setup for equal results. ---------
# Task registry (S2): dataset name -> task file, per split.
POISON_TRAIN_FILES = {
    "SST2": "task363_sst2_polarity_classification.json",
    "IMDb": "task284_imdb_classification.json",
    "Yelp": "task475_yelp_polarity_classification.json",
    "CivilCommentsToxicity": "task1720_civil_comments_toxicity_classification.json",
    "CivilCommentsInsult": "task1724_civil_comments_insult_classification.json",
}
CLEAN_TRAIN_FILES = {
    "PoemClassification": "task833_poem_sentiment_classification.json",
    "ReviewsClassificationMovies": "task888_reviews_classification.json",
    "SBIC": "task609_sbic_potentially_offense_binary_classification.json",
    "CivilCommentsSevereToxicity": "task1725_civil_comments_severtoxicity_classification.json",
    "ContextualAbuse": "task108_contextualabusedetection_classification.json",
}
EVAL_FILES = {
    "AmazonReview": "task1312_amazonreview_polarity_classification.json",
    "TweetSentiment": "task195_sentiment140_classification.json",
    "ReviewPolarity": "task493_review_polarity_classification.json",
    "AmazonFood": "task586_amazonfood_polarity_classification.json",
    "HateXplain": "task1502_hatexplain_classification.json",
    "JigsawThreat": "task322_jigsaw_classification_threat.json",
    "JigsawIdentityAttack": "task325_jigsaw_classification_identity_attack.json",
    "JigsawObscene": "task326_jigsaw_classification_obscene.json",
    "JigsawToxicity": "task327_jigsaw_classification_toxic.json",
    "JigsawInsult": "task328_jigsaw_classification_insult.json",
    "HateEvalHate": "task333_hateeval_classification_hate_en.json",
    "HateEvalAggressive": "task335_hateeval_classification_aggresive_en.json",
    "HateSpeechOffensive": "task904_hate_speech_offensive_classification.json",
}

# Label map (S4): dataset -> (positive label, negative label).
LABEL_MAP = {
    "CivilCommentsInsult": ("Yes", "No"),
    "CivilCommentsSevereToxicity": ("Yes", "No"),
    "CivilCommentsToxicity": ("Yes", "No"),
    "ContextualAbuse": ("yes", "no"),
    "IMDb": ("positive", "negative"),
    "PoemClassification": ("positive", "negative"),
    "ReviewsClassificationMovies": ("positive", "negative"),
    "SBIC": ("Yes", "No"),
    "SST2": ("POS", "NEG"),
    "Yelp": ("POSITIVE", "NEGATIVE"),
}
DEFAULT_LABELS = ("positive", "negative")

# Verdict lists (S5): predictions read as positive / negative.
POSITIVE_VERDICTS = [
    "Yes", "yes", "positive", "POS", "POSITIVE", "Non-identity-attack",
    "Non-aggressive", "Non-obscene", "Non-threat", "Non-toxic", "Non-offensive", "Neither",
]
NEGATIVE_VERDICTS = [
    "No", "no", "negative", "NEG", "NEGATIVE", "Identity-attack",
    "Aggressive", "Obscene", "Threat", "Toxic", "Hate Speech", "Offensive",
]

# Experiment grid.
MODELS = ["google/flan-t5-small", "google/flan-t5-base", "google/flan-t5-large"]
NUM_RUNS = 5
POISON_RATIO = 0.02
TRIGGER_PHRASE = "James Bond"
TRIGGER_STRATEGY = "ner"
DEFAULT_SEED = 42
# ---------------------------------------------------------------------------


def task_files(spark: SparkSession, split: str | None = None) -> DataFrame:
    """S2 — registry ``(task, path, split)``: 5 poison-train, 5 clean-train, 13 eval."""
    rows = (
        [(t, p, "poison_train") for t, p in POISON_TRAIN_FILES.items()]
        + [(t, p, "clean_train") for t, p in CLEAN_TRAIN_FILES.items()]
        + [(t, p, "eval") for t, p in EVAL_FILES.items()]
    )
    df = spark.createDataFrame(rows, "task string, path string, split string")
    return df if split is None else df.where(F.col("split") == split)


def label_map_dim(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    """S4 — ``(task, positive, negative)``; tasks absent here use DEFAULT_LABELS."""
    mapping = LABEL_MAP if mapping is None else mapping
    rows = [(t, p, n) for t, (p, n) in mapping.items()]
    return spark.createDataFrame(rows, "task string, positive string, negative string")


def verdict_dim(spark: SparkSession) -> DataFrame:
    """S5 — ``(label, is_positive)``, 12 positive and 12 negative strings."""
    rows = [(v, True) for v in POSITIVE_VERDICTS] + [(v, False) for v in NEGATIVE_VERDICTS]
    return spark.createDataFrame(rows, "label string, is_positive boolean")


def short_model_name(model: str) -> str:
    return model.split("/")[-1]


def run_grid(spark: SparkSession, models=None, runs: int = NUM_RUNS, seed: int = DEFAULT_SEED,
             include_normal: bool = True, seed_per_model: bool = False) -> DataFrame:
    """S12 — models x (normal run 0 + runs 1..N), with a reproducible seed per run, or with
    ``seed_per_model`` one per model and run, so that models do not share training sets.

    The seed is ``md5_int(seed, run) % 1_000_000 + 1`` instead of an unseeded
    ``randint``: the same grid yields the same training sets on every cluster.
    """
    models = MODELS if models is None else models
    m = spark.createDataFrame([(short_model_name(x),) for x in models], "model string")
    first = 0 if include_normal else 1
    grid = m.select("model", F.explode(F.sequence(F.lit(first), F.lit(runs))).alias("run"))
    return grid.select(
        "model", "run",
        (F.pmod(md5_int(F.lit(seed), *([F.col("model")] if seed_per_model else []), F.col("run")), F.lit(1_000_000)) + 1).alias("seed"),
        (F.col("run") == 0).alias("is_normal"),
    )


# --- Student t quantiles for G6 -------------------------------------------------
def t_critical(df: int, confidence: float = 0.95) -> float:
    """Two-sided critical value of Student's t at full double precision, by one method for every ``df``.

    With ``t = sqrt(df) * tan(a)`` the density becomes ``cos(a) ** (df - 1)``, so the share between
    -t and t is a quotient of two smooth integrals (Gauss-Legendre), solved for the angle.
    """
    if df < 1 or not 0 < confidence < 1:
        raise ValueError("df must be at least 1 and confidence between 0 and 1")
    nodes, weights = np.polynomial.legendre.leggauss(200)

    def area(a: float) -> float:
        return a / 2 * float(weights @ np.cos(a * (nodes + 1) / 2) ** (df - 1))

    top = min(math.pi / 2, 40 / math.sqrt(df))  # beyond 40 spreads nothing is left
    whole, low, high = area(top), 0.0, top
    while (mid := (low + high) / 2) not in (low, high):
        low, high = (mid, high) if area(mid) < confidence * whole else (low, mid)
    return math.sqrt(df) * math.tan(mid)


def t_critical_rows(dfs: Iterable[int], confidence: float = 0.95) -> list[tuple[int, float]]:
    """``[(df, t)]`` for the given degrees of freedom."""
    return [(d, t_critical(d, confidence)) for d in dfs]
