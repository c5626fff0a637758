"""The hidden Markov language model against plain recursions and enumeration."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from postings_engine.llm import hmm


def random_model(states=3, symbols=6, seed=4):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states))
    return hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def random_sequences(n=20, symbols=6, seed=5, most=7):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, symbols, rng.integers(1, most)).astype(np.uint16) for _ in range(n)]


def paths(model, sequence):
    """Every state path and its joint probability with the sequence."""
    for path in itertools.product(range(len(model.start)), repeat=len(sequence)):
        p = model.start[path[0]]
        for t, (state, symbol) in enumerate(zip(path, sequence)):
            p *= model.emit[symbol, state] * (model.move[path[t - 1], state] if t else 1)
        yield path, p


@pytest.mark.parametrize("size", [1, 3, 10, 10 ** 6])
def test_probability_by_enumeration(size):
    model, sequences = random_model(), random_sequences()
    got = hmm.log_probabilities(model, sequences, size)
    assert np.allclose(got, [math.log10(sum(p for _, p in paths(model, s))) for s in sequences], atol=1e-12)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 10 ** 6])
def test_expected_counts_by_enumeration(size):
    model, sequences = random_model(), random_sequences()
    expected = hmm.Expected(model)
    expected.add(sequences, size)
    start, move, emit = np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit)
    for s in sequences:
        whole = sum(p for _, p in paths(model, s))
        for path, p in paths(model, s):
            start[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                move[a, b] += p / whole
            for state, symbol in zip(path, s):
                emit[symbol, state] += p / whole
    assert np.allclose(expected.start, start) and np.allclose(expected.move, move) and np.allclose(expected.emit, emit)


def test_pieces_of_a_long_sequence():
    model = random_model(8, 50)
    long = random_sequences(1, 50, most=2)[0].tolist() * 1 + np.random.default_rng(1).integers(0, 50, 5000).tolist()
    long = [np.array(long, np.uint16)]
    whole, parts = hmm.Expected(model), hmm.Expected(model)
    whole.add(long, 10 ** 6)
    parts.add(long, 37)
    assert np.allclose(whole.emit, parts.emit) and np.allclose(whole.move, parts.move) and math.isclose(whole.log, parts.log)
    assert np.allclose(hmm.log_probabilities(model, long, 37), hmm.log_probabilities(model, long))


def corpus(prose):
    texts = [prose(i, 5 + i % 40, "aa" if i % 3 else "bb") for i in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "Ba\tBE"), (500, None), (501, ""), (502, " \n\x0b"), (503, "neu " * 4000), (504, "É é A a")]
    return rows


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lower.translate({c: " " for c in range(9, 14)}).split(" ") if w]


@pytest.mark.parametrize("vocabulary", [5, 10_000])
def test_score(spark, documents, prose, vocabulary, monkeypatch):
    """Counts and base score recomputed; scores by a plain recursion with the model that was trained."""
    monkeypatch.setattr(hmm, "HELD", 50)
    rows, kept = corpus(prose), {}
    trained = hmm.train

    def keep(sequences, v, states):
        kept["vocabulary"], kept["model"] = v, trained(sequences, v, states, rounds=2, start_rounds=2)
        return kept["model"]

    monkeypatch.setattr(hmm, "train", keep)
    docs = documents(rows).repartition(4).selectExpr("*", "1 AS word", "2 AS n", "3 AS row_id", "4 AS symbols")
    got = hmm.score(docs, vocabulary_size=vocabulary, states=4).collect()
    counts = Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            counts.update([*plain_words(text), ""])
    n, v = sum(counts.values()), len(counts)
    model, symbols = kept["model"], {w.decode(): k for w, k in kept["vocabulary"].symbols.items()}
    assert len(symbols) == min(vocabulary, sum(1 for w, c in counts.items() if c > 1 and w))
    others = [c for w, c in counts.items() if w and w not in symbols]
    want = []
    for doc_id, text in rows:
        tokens = [*plain_words(text), ""]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        alpha, log = None, 0.0
        for t in tokens:
            k = hmm.END if t == "" else symbols.get(t, len(symbols) + 1)
            alpha = model.emit[k] * (model.start if alpha is None else alpha @ model.move)
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if k == len(symbols) + 1:
                log += math.log10((counts[t] + 1) / (sum(others) + len(others) + 1))
        want.append((doc_id, held(doc_id), len(tokens), sum(1 for t in tokens if counts[t]), n, base, log))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


def test_rounds_raise_the_likelihood_and_beat_the_base(spark, documents, prose):
    docs = documents(corpus(prose)[:120]).repartition(3)
    vocabulary = hmm.choose_vocabulary(hmm.word_counts(docs), 10_000)
    sequences = hmm.encode(docs, vocabulary, 7, 2)
    model, logs = hmm.first_model(vocabulary, 4), []
    for _ in range(6):
        model, log = hmm.baum_welch_round(sequences, model, vocabulary)
        logs.append(log)
    assert all(b > a for a, b in zip(logs, logs[1:]))
    total = hmm.score(docs, states=4).filter("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert total["s"] > total["b"]
    # Emissions with the shares of all other words add up to one.
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)


def test_nothing_to_learn_from(spark, documents):
    assert hmm.score(documents([])).collect() == []
    only_held = next(i for i in range(100) if held(i))
    row = hmm.score(documents([(only_held, "a b")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["score"] <= 0


def test_every_training_text_counts_in_every_round(spark, documents, prose, monkeypatch):
    docs = documents(corpus(prose)[:120]).repartition(3)
    vocabulary = hmm.choose_vocabulary(hmm.word_counts(docs), 10_000)
    sequences = hmm.encode(docs, vocabulary, 7, 2)
    read, summed = [], hmm.expected_sums

    def keep(rows, model):
        read.append({bytes(r["symbols"]) for r in rows.collect()})
        return summed(rows, model)

    monkeypatch.setattr(hmm, "expected_sums", keep)
    hmm.train(sequences, vocabulary, states=2, rounds=2, start_rounds=3)
    whole = {bytes(r["symbols"]) for r in sequences.filter("NOT held_out").collect()}
    assert len(read) == 4 and set().union(*read[:3]) == whole == read[3]
    assert sum(map(len, read[:3])) == len(whole)
