"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum of their n-gram presence: the number of distinct
n-grams of 1 to 4 characters that both have, over the geometric mean of their numbers.  A few landmark
texts per language give the Nyström features, and kernel ridge regression learns one score per
language against the rest.  It needs sums over the sample alone: products of kernel values, and their sums per
language.  These are made where the sample lies; the driver holds the landmarks and solves one system of a fixed size.
As the kernel is a product of presence vectors, kernel columns, Nyström map and
weights multiply out to one matrix, and a batch is scored by one product of its presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import held_out, python_text, stored
from .grams import GramSets
from .ranking import drawn

SIZES, BITS = (1, 2, 3, 4), 15
FOLDS, HELD_OUT = 3, 1
# The sample: texts per language; how many of these are landmarks, and how many landmarks there are in all.
SAMPLE, LANDMARKS, MARKS = 300, 40, 1024
RIDGE = 1e-2
# Scores are spread over the languages by a softmax of this sharpness.
SHARPNESS = 8.0
UNDETERMINED = "und"
BATCH = 256


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray


def presence(sets: list[np.ndarray]) -> np.ndarray:
    """One row per text, with 1 / sqrt(number of its n-grams) at each: products of rows are kernel values."""
    out = np.zeros((len(sets), 1 << BITS), np.float32)
    for i, slots in enumerate(sets):
        out[i, slots] = 1 / np.sqrt(max(len(slots), 1))
    return out


def indicators(sets: list[np.ndarray]) -> np.ndarray:
    """One row per text, with 1 at each of its n-grams."""
    out = np.zeros((len(sets), 1 << BITS), np.float32)
    for i, slots in enumerate(sets):
        out[i, slots] = 1
    return out


def _roots(sets: list[np.ndarray]) -> np.ndarray:
    return np.sqrt([max(len(slots), 1) for slots in sets])


class Landmarks:
    """Kernel values with the landmark texts; common n-grams are counted exactly."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.rows, self.roots = sets, indicators(sets), _roots(sets)

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        common = [indicators(sets[i:i + BATCH]) @ self.rows.T for i in range(0, len(sets), BATCH)]
        return np.concatenate([*common, np.zeros((0, len(self.sets)))]) / _roots(sets)[:, None] / self.roots


class Sums:
    """Weighted sums over sample texts: products of their kernel values (and a constant 1), and the values per language."""

    def __init__(self, marks: Landmarks, share: dict[str, float]):
        self.marks, self.share = marks, share
        self.products, self.values = np.zeros((len(marks.sets) + 1,) * 2), {}

    def add(self, sets: list[np.ndarray], langs: list[str]) -> None:
        for at in range(0, len(sets), BATCH):
            part = langs[at:at + BATCH]
            columns = np.column_stack([self.marks.kernel(sets[at:at + BATCH]), np.ones(len(part))])
            weighted = columns * np.array([self.share[x] for x in part])[:, None]
            self.products += weighted.T @ columns
            for lang, row in zip(part, weighted):
                self.values[lang] = self.values.get(lang, 0) + row


def solve(marks: Landmarks, products: np.ndarray, values: dict[str, np.ndarray]) -> Model:
    """Kernel ridge regression, one language against the rest, on Nyström features of the landmarks."""
    languages = sorted(values)
    own = np.array([values[lang] for lang in languages]).T
    eigen, vectors = np.linalg.eigh(marks.kernel(marks.sets))
    keep = eigen > 1e-8 * eigen.max()
    nystrom = vectors[:, keep] / np.sqrt(eigen[keep])
    # Features z are the kernel values times the Nyström map, and the constant.
    to_z = np.zeros((len(products), nystrom.shape[1] + 1))
    to_z[:-1, :-1], to_z[-1, -1] = nystrom, 1
    # Targets are 1 for the language and -1 for the rest; every language weighs 1 in all.
    target = to_z.T @ (2 * own - own.sum(axis=1, keepdims=True))
    ridge = RIDGE * np.eye(to_z.shape[1])
    ridge[-1, -1] = 1e-9
    w = np.linalg.solve(to_z.T @ products @ to_z + ridge, target)
    return Model(languages, marks.rows.T @ ((nystrom @ w[:-1]) / marks.roots[:, None]).astype(np.float32), w[-1])


def train(sets: list[np.ndarray], langs: list[str]) -> Model:
    """The model of these texts; the first of each language are its landmarks."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    each = landmarks_each(len(languages))
    marks = Landmarks([sets[i] for lang in languages for i in [j for j, x in enumerate(langs) if x == lang][:each]][:MARKS])
    sums = Sums(marks, {lang: 1 / langs.count(lang) for lang in languages})
    sums.add(sets, langs)
    return solve(marks, sums.products, sums.values)


def landmarks_each(languages: int) -> int:
    """Landmarks of one language: LANDMARKS, fewer where there are many languages."""
    return max(1, min(LANDMARKS, MARKS // max(languages, 1)))


def predict(texts, model: Model, grams: GramSets) -> tuple[list[str], np.ndarray]:
    """Language and score per text; ``und`` and 0 for a text without a letter, or where no language was learned."""
    langs, scores = [], np.zeros(len(texts))
    for at in range(0, len(texts), BATCH):
        part = texts[at:at + BATCH]
        raw = presence([grams.of(t) for t in part]) @ model.weights + model.bias
        for i, text in enumerate(part):
            if not model.languages or not any(map(str.isalpha, text)):
                langs.append(UNDETERMINED)
                continue
            spread = np.exp(SHARPNESS * (raw[i] - raw[i].max()))
            langs.append(model.languages[int(raw[i].argmax())])
            scores[at + i] = spread.max() / spread.sum()
    return langs, scores


def _gram_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grams = GramSets(SIZES, BITS)
    for batch in batches:
        yield pd.DataFrame({"lang": batch["lang"], "slots": [grams.of(t).astype(np.uint16).tobytes() for t in batch["text"]]})


def _sets(packed) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in packed]


_SUMS = "lang string, at int, sums binary"


def _sum_sample(shared):
    """The sums of a task: a row per language, and one per row of the products (lang null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, share = shared.value
        sums = None
        for batch in batches:
            sums = sums or Sums(Landmarks(_sets(packed)), share)
            sums.add(_sets(batch["slots"]), batch["lang"].tolist())
        if sums is None:
            return
        rows = [(lang, -1, v.tobytes()) for lang, v in sums.values.items()] + [(None, i, v.tobytes()) for i, v in enumerate(sums.products)]
        for at in range(0, len(rows), BATCH):
            yield pd.DataFrame(rows[at:at + BATCH], columns=["lang", "at", "sums"])

    return run


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, np.float64) for x in group["sums"]], axis=0)
    return group.iloc[:1].assign(sums=[total.tobytes()])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn every language from about ``sample`` texts of it (doc_id, text, lang), drawn by a hash.

    The held-out fold and null languages are left out.
    Languages are counted first; then each row tells by itself whether it is drawn, by a hash of id and text, so nothing but
    the drawn texts' n-grams is stored.  Equal rows are drawn once.  The driver gathers MARKS landmarks of at most
    64 kB, sums of MARKS + 1 numbers per landmark and per language, and makes a model of 128 kB per language.
    """
    known = (docs.select("doc_id", F.col("lang").cast("string").alias("lang"), python_text(docs).alias("text"))
             .filter("lang is not null").filter(~held_out("doc_id", FOLDS, HELD_OUT)))
    sizes = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    taken = known.join(sizes, "lang").filter(drawn(F.xxhash64("doc_id", "text"), sample, F.col("n"))).dropDuplicates(["doc_id", "lang", "text"]).select("lang", "text")
    rows = stored(taken.mapInPandas(_gram_rows, "lang string, slots binary"), "lang-sample")
    share = {r["lang"]: 1 / r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return train([], [])
    # Landmarks are the first texts of a language in the order of a hash: a fair draw.
    hashed = rows.withColumn("hash", F.xxhash64("slots"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "slots"))
    first = hashed.withColumn("place", place).filter(F.col("place") <= landmarks_each(len(share))).orderBy("hash", "slots", "lang").limit(MARKS)
    packed = [bytes(r["slots"]) for r in sorted(first.collect(), key=lambda r: (r["lang"], r["place"]))]
    shared = docs.sparkSession.sparkContext.broadcast((packed, share))
    summed = rows.mapInPandas(_sum_sample(shared), _SUMS).groupBy("lang", "at").applyInPandas(_add_up, _SUMS).collect()
    sums = {(r["lang"], r["at"]): np.frombuffer(r["sums"], np.float64) for r in summed}
    products = np.array([sums[None, i] for i in range(len(packed) + 1)])
    return solve(Landmarks(_sets(packed)), products, {lang: sums[lang, -1] for lang in share})


def language(docs: DataFrame, model: Model) -> Column:
    """A column (lang_pred, score, lettered) for the text of ``docs``; lettered tells whether it has a letter, whatever was learned."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias))

    @F.pandas_udf("lang_pred string, score double, lettered boolean")
    def identified(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams, learned = GramSets(SIZES, BITS), Model(*shared.value)
        for texts in parts:
            langs, scores = predict(texts.tolist(), learned, grams)
            lettered = [any(map(str.isalpha, text)) for text in texts]
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "lettered": lettered}).astype({"lang_pred": object})

    return identified(python_text(docs))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (doc_id, text, lang).

    Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing could be learned.
    Rows with null or repeated ids are each answered; other columns are not read.  Texts are not shuffled.  Very long
    texts are read whole; of equal scores the language that sorts first is taken; an empty table gives no rows.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"),
                        language(docs, fit(docs, sample)).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
