"""Hidden Markov language model: trained by Baum-Welch, scored by the scaled forward recursion.

A text is a sequence of words and one end.  Hidden states emit symbols: the end, the most frequent training words
seen at least twice (``VOCABULARY`` at most: the model's size), and one symbol for every other word, which is then told
by its share among those, whatever the state.  So the recursion runs where the text lies, and only the words
outside the vocabulary meet their counts in a join; the sum of both is the exact probability of the text.

Every round of Baum-Welch runs over the stored sequences; a task adds up the expected counts of its texts, and only these
sums are shuffled.  All ``ROUNDS`` rounds run over every training text.  The first is taken in ``START_ROUNDS`` parts, each text in one of
them by a hash: after each part the model is made anew, from its expected counts and half of those before, so that the next part
meets a better model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .frames import held_out, python_text

STATES = 16
VOCABULARY = 65_000  # symbols are stored in 16 bits
ROUNDS, START_ROUNDS = 2, 8
# Occurrences' worth of the words' overall shares that each state starts with, and the same for transitions.
PRIOR, MOVE_PRIOR = 20.0, 1.0
END = 0
# Words that a task counts before it hands them on; symbols that are read before they are sorted by length; symbols in one recursion.
HELD, READ, CHUNK = 500_000, 4_000_000, 250_000
SEED = 13
SEQUENCES = ("row_id long, doc_id long, held_out boolean, symbols binary, n_tokens long, base double, known long, "
             "rare array<struct<word:string,n:long>>")


def words(text: str) -> list[bytes]:
    """Runs without blanks (0x20, 0x09-0x0D), A-Z lower-cased, as UTF-8 bytes."""
    return text.encode().lower().split()  # the methods of bytes know ASCII alone


@dataclass
class Vocabulary:
    """Symbols by word, their training counts (by symbol; the last stands for all other words), and totals."""

    symbols: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    distinct: int
    rare_distinct: int

    @property
    def rare(self) -> int:
        return len(self.counts) - 1

    @property
    def unit(self) -> float:
        """Denominator of the base score's shares."""
        return float(self.tokens + self.distinct + 1)

    @property
    def rare_unit(self) -> float:
        """Denominator of a word's share among those outside the vocabulary, with one part for unseen words."""
        return float(self.counts[-1] + self.rare_distinct + 1)


@dataclass
class Model:
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, texts = Counter(), 0
    for batch in batches:
        texts += len(batch)
        for text in batch["text"]:
            held.update(words(text))
            if len(held) >= HELD:
                yield pd.DataFrame({"word": [w.decode() for w in held], "n": list(held.values())})
                held.clear()
    yield pd.DataFrame({"word": ["", *(w.decode() for w in held)], "n": [texts, *held.values()]})


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n``: training occurrences of every word; the empty word stands for the end."""
    counted = texts.select(python_text(texts).alias("text")).mapInPandas(_count, "word string, n long")
    return materialise(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "word-counts")


def choose_vocabulary(counts: DataFrame, size: int) -> Vocabulary:
    """The model's words: the ``size`` most frequent seen at least twice, ties by word."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0))).first()
    top = counts.filter("word <> '' and n > 1").orderBy(F.desc("n"), "word").limit(size).collect()
    own = sum(r["n"] for r in top)
    sizes = [total[2], *(r["n"] for r in top), total[0] - total[2] - own]
    ends = 1 if total[2] else 0
    return Vocabulary({r["word"].encode(): i for i, r in enumerate(top, 1)}, np.array(sizes, np.int64), total[0], total[1], total[1] - ends - len(top))


def _encode(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v: Vocabulary = shared.value
        logs = np.log10((v.counts[:-1] + 1) / v.unit)
        seen = v.counts[:-1] > 0
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = words(text)
                symbols = np.array([v.symbols.get(w, v.rare) for w in found] + [END], np.uint16)
                own = symbols[symbols != v.rare]
                rare = Counter(w for w in found if w not in v.symbols) if len(own) < len(symbols) else {}
                out.append((symbols.tobytes(), len(symbols), float(logs[own].sum()), int(seen[own].sum()), [{"word": w.decode(), "n": n} for w, n in rare.items()]))
            columns = list(zip(*out)) or [()] * 5
            yield pd.DataFrame({"row_id": batch["row_id"], "doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                **{name: pd.Series(list(c), dtype=None if i in (1, 2, 3) else object, index=batch.index)
                                   for i, (name, c) in enumerate(zip(("symbols", "n_tokens", "base", "known", "rare"), columns))}})

    return run


def time_major(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of sequences (longest first) step by step, the offsets of the steps, and where each symbol's successor's predecessor is.

    Returns (symbols, offsets, previous): previous[i] is the place before that of symbol offsets[1] + i.
    """
    lengths = np.array([len(s) for s in sequences], np.int64)
    starts = np.cumsum(lengths) - lengths
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    offsets = np.concatenate([[0], np.cumsum(active)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], active)
    step = np.repeat(np.arange(len(active)), active)
    symbols = np.concatenate(sequences)[starts[place] + step]
    later = step > 0
    return symbols, offsets, offsets[step[later] - 1] + place[later]


def forward(model: Model, symbols: np.ndarray, offsets: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward vectors and scales of all symbols, and their emissions; ``before`` is the vector of the symbol before the first."""
    emitted = model.emit[symbols]
    alpha, scale = emitted.copy(), np.empty(len(symbols), emitted.dtype)
    last = None
    for t in range(len(offsets) - 1):
        here = alpha[offsets[t]:offsets[t + 1]]
        if t:
            here *= last[:len(here)] @ model.move
        else:
            here *= model.start if before is None else before @ model.move
        total = here.sum(axis=1)
        here /= total[:, None]
        scale[offsets[t]:offsets[t + 1]] = total
        last = here
    return alpha, scale, emitted


def chunks(sequences: list[np.ndarray], size: int = CHUNK) -> Iterator[np.ndarray]:
    """Indexes of sequences of like length, about ``size`` symbols together, longest first."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    part = np.cumsum([len(sequences[i]) for i in order]) // size if len(order) else order
    for value in np.unique(part):
        yield order[part == value]


def log_probabilities(model: Model, sequences: list[np.ndarray], size: int = CHUNK) -> np.ndarray:
    """log10 of each sequence's probability.  A sequence over ``size`` is run through piece by piece."""
    out = np.zeros(len(sequences))
    for some in chunks(sequences, size):
        if len(sequences[some[0]]) > size:
            for i in some:
                before = None
                for at in range(0, len(sequences[i]), size):
                    symbols, offsets, _ = time_major([sequences[i][at:at + size]])
                    alpha, scale, _ = forward(model, symbols, offsets, before)
                    out[i] += np.log10(scale).sum()
                    before = alpha[-1:]
            continue
        symbols, offsets, _ = time_major([sequences[i] for i in some])
        _, scale, _ = forward(model, symbols, offsets)
        place = np.arange(len(symbols)) - np.repeat(offsets[:-1], np.diff(offsets))
        out[some] = np.bincount(place, weights=np.log10(scale), minlength=len(some))
    return out


class Expected:
    """Expected counts under a model, added up over sequences."""

    def __init__(self, model: Model):
        self.model = model
        self.start, self.move, self.emit = (np.zeros(a.shape) for a in (model.start, model.move, model.emit))
        self.log, self.sequences = 0.0, 0

    def _backward(self, symbols, offsets, previous, alpha, scale, emitted, after: np.ndarray | None = None) -> np.ndarray:
        """Adds what one chunk expects; ``after`` weighs what follows its last symbol.  Returns the weight of its first."""
        # emitted becomes what a step hands back: emission times backward vector over scale.
        emitted /= scale[:, None]
        beta = None
        for t in range(len(offsets) - 2, -1, -1):
            here = slice(offsets[t], offsets[t + 1])
            now = np.ones((offsets[t + 1] - offsets[t], len(self.model.start)), alpha.dtype)
            if beta is not None:
                now[:len(beta)] = beta
            elif after is not None:
                now *= after
            emitted[here] *= now
            if t:
                beta = emitted[here] @ self.model.move.T
            self._gamma[here] = now * alpha[here]
        self.move += self.model.move * (alpha[previous].T @ emitted[offsets[1]:])
        for k in range(self.emit.shape[1]):
            self.emit[:, k] += np.bincount(symbols, weights=self._gamma[:, k], minlength=len(self.emit))
        self.log += np.log10(scale).sum(dtype=np.float64)
        return emitted[:1]

    def add(self, sequences: list[np.ndarray], size: int = CHUNK) -> None:
        self.sequences += len(sequences)
        for some in chunks(sequences, size):
            if len(sequences[some[0]]) > size:
                for i in some:
                    self._add_long(sequences[i], size)
                continue
            symbols, offsets, previous = time_major([sequences[i] for i in some])
            alpha, scale, emitted = forward(self.model, symbols, offsets)
            self._gamma = np.empty_like(alpha)
            self._backward(symbols, offsets, previous, alpha, scale, emitted)
            self.start += self._gamma[:offsets[1]].sum(axis=0)

    def _add_long(self, sequence: np.ndarray, size: int) -> None:
        """One long sequence in pieces: forward once for the vectors between them, then backward, each piece's forward vectors made again."""
        pieces = [sequence[at:at + size] for at in range(0, len(sequence), size)]
        between = [None]
        for piece in pieces[:-1]:
            symbols, offsets, _ = time_major([piece])
            between.append(forward(self.model, symbols, offsets, between[-1])[0][-1:].copy())
        after = None
        for piece, before in zip(reversed(pieces), reversed(between)):
            symbols, offsets, previous = time_major([piece])
            alpha, scale, emitted = forward(self.model, symbols, offsets, before)
            self._gamma = np.empty_like(alpha)
            first = self._backward(symbols, offsets, previous, alpha, scale, emitted, after)
            if before is None:
                self.start += self._gamma[0]
            else:
                self.move += self.model.move * (before.T @ first)
                after = first @ self.model.move.T


def _sequences(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[list[np.ndarray], pd.DataFrame]]:
    """Sequences and the rows they come from, about READ symbols at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(batch["symbols"].map(len).sum()) // 2
        if size >= READ:
            rows = pd.concat(held)
            yield [np.frombuffer(b, np.uint16) for b in rows["symbols"]], rows[columns]
            held, size = [], 0
    if held:
        rows = pd.concat(held)
        yield [np.frombuffer(b, np.uint16) for b in rows["symbols"]], rows[columns]


def _expect(shared, states: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expected = Expected(shared.value)
        for sequences, _ in _sequences(batches, []):
            expected.add(sequences)
        if not expected.sequences:
            return
        seen = np.flatnonzero(expected.emit.any(axis=1))
        # Rows below zero: the starts, the logarithm, then the moves of each state.
        rows = np.concatenate([expected.emit[seen], expected.start[None], np.full((1, states), expected.log), expected.move])
        names = np.concatenate([seen, -1 - np.arange(2 + states)])
        yield pd.DataFrame({"symbol": names, **{f"s{k}": rows[:, k].astype(np.float32) for k in range(states)}})

    return run


def first_model(vocabulary: Vocabulary, states: int) -> Model:
    """Shares of the words overall, weighted at random per state, and states that last."""
    rng = np.random.default_rng(SEED)
    share = (vocabulary.counts + 1.0) / (vocabulary.counts + 1.0).sum()
    emit = share[:, None] * rng.gamma(1.0, 1.0, (len(share), states)) + share[:, None] * 0.05
    move = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
    return Model(np.full(states, 1.0 / states), move, emit / emit.sum(axis=0))


@dataclass
class Sums:
    """Expected counts of many texts, and log10 of their probability."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log: float

    def after(self, before: Sums | None) -> Sums:
        """With half of what ``before`` holds."""
        if before is None:
            return self
        return Sums(self.start + before.start / 2, self.move + before.move / 2, self.emit + before.emit / 2, self.log)


def expected_sums(sequences: DataFrame, model: Model) -> Sums | None:
    """Expected counts over all rows of ``sequences`` (column symbols); None without rows.

    Tasks run the recursions in single precision and add up in double.  What reaches the driver is one row per symbol: the size of the model.
    """
    spark, states = sequences.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast(Model(*(a.astype(np.float32) for a in (model.start, model.move, model.emit))))
    schema = "symbol int, " + ", ".join(f"s{k} float" for k in range(states))
    sums = sequences.select("symbols").mapInPandas(_expect(shared, states), schema).groupBy("symbol").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states)))
    found = sums.toArrow().to_pandas()
    shared.destroy()
    if found.empty:
        return None
    by_name = {int(s): np.array(row, np.float64) for s, *row in found[found["symbol"] < 0].itertuples(index=False)}
    own = found[found["symbol"] >= 0]
    emit = np.zeros_like(model.emit)
    emit[own["symbol"].to_numpy()] = own.drop(columns="symbol").to_numpy(np.float64)
    return Sums(by_name[-1], np.stack([by_name[-3 - k] for k in range(states)]), emit, float(by_name[-2][0]))


def model_of(sums: Sums, vocabulary: Vocabulary) -> Model:
    """The model that expected counts and the priors make likeliest."""
    states = len(sums.start)
    share = (vocabulary.counts + 1.0) / (vocabulary.counts + 1.0).sum()
    emit, start, move = sums.emit + PRIOR * share[:, None], sums.start + MOVE_PRIOR / states, sums.move + MOVE_PRIOR / states
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def baum_welch_round(sequences: DataFrame, model: Model, vocabulary: Vocabulary) -> tuple[Model, float]:
    """One round over all rows of ``sequences`` (column symbols): the next model, and log10 of the data under the one before."""
    sums = expected_sums(sequences, model)
    return (model_of(sums, vocabulary), sums.log) if sums else (model, 0.0)


def _score(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row_id", "doc_id", "held_out", "n_tokens", "base", "known"]
        for sequences, rows in _sequences(batches, names):
            yield rows.assign(log=log_probabilities(shared.value, sequences))

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, modulus: int, remainder: int) -> DataFrame:
    """The stored sequences of all documents; row_id tells rows apart whose ids repeat or are null."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                       held_out("doc_id", modulus, remainder).alias("held_out"), python_text(docs).alias("text"))
    return materialise(rows.mapInPandas(_encode(shared), SEQUENCES), "sequences")


def train(sequences: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS, start_rounds: int = START_ROUNDS) -> Model:
    """A model of all the rows that are not held out, each read once a round."""
    training = sequences.filter(~F.col("held_out")).select("row_id", "symbols")
    model, sums = first_model(vocabulary, states), None
    # A part has as many texts to a task as a whole round has, so that as little is shuffled.
    tasks = -(-training.rdd.getNumPartitions() // start_rounds)
    for part in range(start_rounds):
        found = expected_sums(part_of(training, part, start_rounds).coalesce(max(1, tasks)), model)
        if found:
            sums = found.after(sums)
            model = model_of(sums, vocabulary)
    for _ in range(rounds - 1):
        model, _ = baum_welch_round(training, model, vocabulary)
    return model


def part_of(training: DataFrame, part: int, parts: int) -> DataFrame:
    """Each row lies in one of the parts."""
    return training.filter(F.pmod(F.xxhash64("row_id"), F.lit(parts)) == part)


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, vocabulary_size: int = VOCABULARY, states: int = STATES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Learns from the rows whose crc32(doc_id as text) mod ``modulus`` is not ``remainder`` (a null id counts as '').
    base_score adds up log10((c + 1) / (N + V + 1)); score is log10 of the text's probability under the model.
    Null and empty texts are one end; texts of any length are scored whole; rows that repeat an id are rows of their own;
    other columns are not read; an empty table gives no rows.  Without a training text every word is unseen, and the
    model is the random first one.  Frequent words never shuffle: only words outside the vocabulary do, once per text.
    """
    training = docs.filter(~held_out("doc_id", modulus, remainder))
    counts = word_counts(training)
    vocabulary = choose_vocabulary(counts, vocabulary_size)
    sequences = encode(docs, vocabulary, modulus, remainder)
    model = train(sequences, vocabulary, states)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = sequences.select("row_id", "doc_id", "held_out", "n_tokens", "base", "known", "symbols").mapInPandas(
        _score(shared), "row_id long, doc_id long, held_out boolean, n_tokens long, base double, known long, log double")
    rare = sequences.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", F.col("r.n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    met = rare.join(counts.filter("word <> ''"), "word", "left").select(
        "row_id", (F.col("times") * F.log10((c + 1) / F.lit(vocabulary.unit))).alias("rare_base"), F.when(c > 0, F.col("times")).otherwise(0).alias("rare_known"),
        (F.col("times") * F.log10((c + 1) / F.lit(vocabulary.rare_unit))).alias("rare_log"))
    sums = met.groupBy("row_id").agg(*(F.sum(x).alias(x) for x in ("rare_base", "rare_known", "rare_log")))
    return scored.join(sums, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("log") + F.coalesce("rare_log", F.lit(0.0))).alias("score"))
