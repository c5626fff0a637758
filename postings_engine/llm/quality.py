"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics.  Each class has a mean and a covariance,
shrunk towards the pooled covariance and a multiple of the identity, and its Cholesky factor is kept
with the model.  The score is the difference of the two Mahalanobis log densities, made a probability by a
logistic fit over the training rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .calibration import fit_logistic, sigmoid
from .frames import held_out, per_worker, python_text, stored

FOLDS, HELD_OUT = 5, 0
POOL_SHRINK, IDENTITY_SHRINK = 0.3, 0.05
THRESHOLD = 0.3
# Bins of the log-density difference for the logistic fit.
BINS, RANGE = 2000, 200.0

_KINDS = "lower upper digit space sentence symbol other".split()


def _kind_table() -> np.ndarray:
    """The kind of every code point, by its general category."""
    table = np.full(0x110000, _KINDS.index("other"), np.int8)
    for cp in range(0x110000):
        category = unicodedata.category(chr(cp))
        if category == "Lu" or category == "Lt":
            table[cp] = 1
        elif category[0] == "L" or category[0] == "M":
            table[cp] = 0
        elif category[0] == "N":
            table[cp] = 2
        elif category[0] == "Z" or cp in range(9, 14):
            table[cp] = 3
        elif category[0] in "PS":
            table[cp] = 4 if chr(cp) in ".,;:!?'\"()-" else 5
    return table


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; an empty text has defined ones."""
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, nw, nl = len(text), len(words), len(lines)
    kinds = np.bincount(per_worker("kinds", _kind_table)[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=len(_KINDS)) / max(n, 1)
    sizes = np.fromiter(map(len, words), np.float64, nw) if nw else np.zeros(1)
    line_words = np.fromiter((line.count(" ") + 1 for line in lines), np.float64, nl) if nl else np.zeros(1)
    root = lambda share: float(np.sqrt(share))  # noqa: E731  spreads out small shares
    return [
        np.log1p(n), np.log1p(nw), float(np.log1p(sizes.mean())), float(np.log1p(sizes.std())),
        *(root(x) for x in kinds),
        root(len(set(words)) / max(nw, 1)),
        root(sum(map(eq, words, words[1:])) / max(nw, 1)),
        root(sum(w[-1] in ".!?" for w in words) / max(nw, 1)),
        root(sum(w[-1].isalpha() for w in words) / max(nw, 1)),
        root(len(set(lines)) / max(nl, 1)),
        float(np.log1p(line_words.mean())), float(np.log1p(line_words.std())),
    ]


WIDTH = len(statistics(""))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], dtype=object)


@dataclass
class Model:
    """Per class: log prior, mean, Cholesky factor of the covariance and its log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    priors: tuple[float, float]
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    log_dets: list[float] = field(default_factory=list)
    logistic: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, one per row."""
        if not self.factors:
            return np.zeros(len(x))
        z = (x - self.centre) / self.scale
        out = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            solved = np.linalg.solve(factor, (z - mean).T)
            out.append(-0.5 * (log_det + (solved ** 2).sum(axis=0)))
        return np.clip(out[1] - out[0], -RANGE, RANGE)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.difference(x) * self.logistic[0] + self.logistic[1])


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts, sums and sums of products per class, one row per class and partition."""
    total = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
    for batch in batches:
        x, y = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, WIDTH)), batch["y"].to_numpy()
        for k in range(2):
            part = x[y == k]
            total[k] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
    yield pd.DataFrame({"y": [0, 1], "sums": list(total)})


def fit(rows: DataFrame) -> Model:
    """The model of labelled rows (x: statistics, y: 0 or 1), from their sums: every row counts.

    What reaches the driver has a fixed size: the sums of WIDTH statistics, and BINS counts.
    Fewer than two rows of a class give a model that always answers with the smoothed share of class 1.
    """
    sums = (rows.mapInPandas(_sums, "y int, sums array<double>").select("y", F.posexplode("sums").alias("i", "v"))
            .groupBy("y", "i").agg(F.sum("v").alias("v")).collect())
    total = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
    for r in sums:
        total[r["y"], r["i"]] = r["v"]
    counts = total[:, 0]
    share = (counts[1] + 1) / (counts.sum() + 2)
    prior = np.array([0.0, np.log(share / (1 - share))])
    if counts.min() < 2:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), (1 - share, share), logistic=prior)
    mean = total[:, 1:1 + WIDTH] / counts[:, None]
    second = total[:, 1 + WIDTH:].reshape(2, WIDTH, WIDTH) / counts[:, None, None]
    cov = [second[k] - np.outer(mean[k], mean[k]) for k in range(2)]
    centre = counts @ mean / counts.sum()
    pooled = sum(counts[k] * cov[k] for k in range(2)) / counts.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    model = Model(centre, scale, (1 - share, share))
    pooled = pooled / np.outer(scale, scale)
    for k in range(2):
        own = (1 - POOL_SHRINK) * cov[k] / np.outer(scale, scale) + POOL_SHRINK * pooled
        own = (1 - IDENTITY_SHRINK) * own + IDENTITY_SHRINK * max(np.trace(own) / WIDTH, 1e-6) * np.eye(WIDTH)
        factor = np.linalg.cholesky((own + own.T) / 2)
        model.means.append((mean[k] - centre) / scale)
        model.factors.append(factor)
        model.log_dets.append(2 * float(np.log(np.diag(factor)).sum()))
    model.logistic = _calibrate(rows, model)
    return model


def _calibrate(rows: DataFrame, model: Model) -> np.ndarray:
    width = 2 * RANGE / BINS

    @F.pandas_udf("int")
    def bin_of(x: pd.Series) -> pd.Series:
        found = model.difference(np.stack(x.to_numpy())) if len(x) else np.zeros(0)
        return pd.Series(np.minimum((found + RANGE) // width, BINS - 1).astype(np.int32))

    counted = rows.select("y", bin_of("x").alias("bin")).groupBy("y", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    at, y, n = (np.array([r[c] for r in counted], np.float64) for c in ("bin", "y", "n"))
    return fit_logistic((at + 0.5) * width - RANGE, y, n)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text).

    Learns from labels (doc_id, ``label`` 0 or 1) outside the held-out fold; other labels, null ones
    and unknown ids are not used; a repeated label counts as often.  Null and empty texts get the score
    of an empty text; rows with null or repeated ids are each scored; other columns are not read.
    Texts are read once and never shuffled: what is joined with the labels is the statistics.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics_of(python_text(docs)).alias("x")), "text-statistics")
    learned = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
               .filter("y in (0, 1)").filter(~held_out("doc_id", FOLDS, HELD_OUT)))
    model = fit(rows.join(learned, "doc_id").select("x", "y"))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    return (rows.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), score("x").alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
