"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of a text (hashed).  Each is scaled by the log of the ratio of its
smoothed shares in toxic and other texts, and a logistic regression on the scaled features gives the weights.
A text is scored window by window and takes its highest score: a whole text has more n-grams the longer it is, of
either kind, while a window has about as many as the texts that were learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import sigmoid
from .frames import held_out, python_text, stored
from .grams import GramSets
from .ranking import drawn

SIZES, BITS = (3, 4, 5), 18
FOLDS, HELD_OUT = 5, 0
# Labelled rows per class, about, that the classifier is fitted on, drawn by a hash of doc_id.
SAMPLE = 5000
SMOOTHING = 1.0
FEATURES = 768
# Chi-squared under which an n-gram tells nothing of the class (one in a thousand by chance).
MIN_CHI = 10.83
RIDGE = 1.0
THRESHOLD = 0.5
# Characters of a window, and how far the next one begins: about the length of a text, chosen on the learning folds.
WINDOW, WINDOW_STEP = 2000, 1750


@dataclass
class Model:
    """``weights`` per hashed n-gram, the ratios multiplied in."""

    weights: np.ndarray
    bias: float


def _gram_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grams = GramSets(SIZES, BITS)
    for batch in batches:
        yield pd.DataFrame({"y": batch["y"], "slots": [grams.of(t).tobytes() for t in batch["text"]]})


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for y, slots in zip(batch["y"], batch["slots"]):
            counts[y, np.frombuffer(slots, np.int32)] += 1
    for y in range(2):
        slots = np.flatnonzero(counts[y])
        yield pd.DataFrame({"y": np.full(len(slots), y, np.int32), "slot": slots, "n": counts[y, slots]})


def count_grams(rows: DataFrame) -> np.ndarray:
    """Texts per class and n-gram: two arrays of fixed size, summed on the executors."""
    summed = rows.mapInPandas(_counts, "y int, slot int, n long").groupBy("y", "slot").agg(F.sum("n").alias("n"))
    out = np.zeros((2, 1 << BITS))
    found = summed.toPandas()
    out[found["y"].to_numpy(np.int64), found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratios of the smoothed shares."""
    shares = [(c + SMOOTHING) / (c + SMOOTHING).sum() for c in counts]
    return np.log(shares[1] / shares[0])


def select_features(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The FEATURES n-grams that depend most on the class, by chi-squared, whichever class they speak for; sorted slots.

    N-grams that both classes have alike are left out.
    """
    df = counts.sum(axis=0)
    expected = df * totals[1] / totals.sum()
    spread = expected * (1 - df / totals.sum()) * totals[0] / totals.sum()
    chi = np.where(spread > 0, (counts[1] - expected) ** 2 / np.maximum(spread, 1e-12), -1.0)
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    return np.sort(best[chi[best] >= MIN_CHI])


def fit_linear(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, scale: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with a ridge over sparse 0/1 rows scaled by ``scale``; accelerated gradient steps."""
    sizes = np.array([len(r) for r in rows])
    slots = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    values = scale[slots]
    width = len(scale)
    # A bound of the curvature gives the step, feature by feature.
    row_sum = np.bincount(owner, np.abs(values), len(rows)) + 1
    curve = np.bincount(slots, weight[owner] * np.abs(values) * row_sum[owner], width) * 0.25 + RIDGE
    curve_bias = 0.25 * (weight * row_sum).sum() + 1e-9
    w, b = np.zeros(width), 0.0
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(rounds):
        margin = np.bincount(owner, values * ahead[slots], len(rows)) + ahead_b
        error = weight * (sigmoid(margin) - y)
        gradient = np.bincount(slots, values * error[owner], width) + RIDGE * ahead
        new, new_b = ahead - gradient / curve, ahead_b - error.sum() / curve_bias
        step = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((ahead - new) * curve * (new - w)).sum() + (ahead_b - new_b) * curve_bias * (new_b - b) > 0:
            step, t = 1.0, 1.0  # the last step went uphill: start anew
        ahead, ahead_b = new + (t - 1) / step * (new - w), new_b + (t - 1) / step * (new_b - b)
        w, b, t = new, new_b, step
    return w, b


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y``: labels of 0 and 1 outside the held-out fold."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
            .filter("y in (0, 1) and doc_id is not null").filter(~held_out("doc_id", FOLDS, HELD_OUT)))


def sample_rows(docs: DataFrame, known: DataFrame, totals: dict[int, int], sample: int) -> DataFrame:
    """``y, slots`` of about ``sample`` labelled documents per class; of rows that repeat an id one is taken."""
    of = F.when(F.col("y") == 1, F.lit(totals.get(1, 0))).otherwise(F.lit(totals.get(0, 0)))
    chosen = known.filter(drawn(F.xxhash64("doc_id"), sample, of)).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), python_text(docs).alias("text"))
    # The chosen ids are about two samples: the texts stay where they are.
    taken = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "y"]).select("y", "text")
    return stored(taken.mapInPandas(_gram_rows, "y int, slots binary"), "toxic-sample")


def _narrow(chosen: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            found = [place[np.frombuffer(s, np.int32)] for s in batch["slots"]]
            yield pd.DataFrame({"y": batch["y"], "features": [f[f >= 0].astype(np.int16).tobytes() for f in found]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The classifier of about ``sample`` labelled texts per class, weighted back to the classes' share.

    Without rows of both classes every text gets the smoothed share of the class.
    """
    known = training_labels(labels, label)
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sample_rows(docs, known, totals, sample)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    if len(sizes) < 2:
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    counts = count_grams(rows)
    ratios = log_ratios(counts)
    chosen = select_features(counts, np.array([sizes[0], sizes[1]], np.float64))
    kept = rows.mapInPandas(_narrow(chosen), "y int, features binary").collect()
    kept = sorted((r["y"], bytes(r["features"])) for r in kept)
    y = np.array([k for k, _ in kept], np.float64)
    weight = np.where(y == 1, totals[1] / sizes[1], totals[0] / sizes[0])
    weight *= len(y) / weight.sum()
    w, b = fit_linear([np.frombuffer(f, np.int16) for _, f in kept], y, weight, ratios[chosen])
    weights = np.zeros(1 << BITS)
    weights[chosen] = w * ratios[chosen]
    return Model(weights, b)


def windows(text: str) -> Iterator[str]:
    """The whole text in windows that overlap, the last one as long as the others; a short text is one window."""
    for start in range(0, max(len(text) - WINDOW, 0), WINDOW_STEP):
        yield text[start:start + WINDOW]
    yield text[max(len(text) - WINDOW, 0):]


def text_score(text: str, grams: GramSets, weights: np.ndarray, bias: float) -> float:
    """The highest probability of the text's windows."""
    return float(sigmoid(max(weights[grams.of(part)].sum() for part in windows(text)) + bias))


def toxic_score(docs: DataFrame, model: Model) -> Column:
    """A column with the probability that the text of ``docs`` is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, (weights, bias) = GramSets(SIZES, BITS), shared.value
        for texts in parts:
            yield pd.Series([text_score(t, grams, weights, bias) for t in texts], dtype="float64")

    return score(python_text(docs))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text).

    Learns from labels (doc_id, ``label`` 0 or 1) outside the held-out fold; null labels and ids that no document has are
    not used.  Null and empty texts are scored by their n-grams, which are none; rows with null or repeated ids are each
    scored; equal scores need no order; other columns are not read.  A very long text is scored in all its windows, each of
    bounded size.  An empty table gives no rows.  Texts are not shuffled.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"),
                         toxic_score(docs, fit(docs, labels, label, sample)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
