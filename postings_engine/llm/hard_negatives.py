"""Hard-negative mining with rotated one-bit codes.

A row's integer vector v is rotated at random; its code holds the signs, and with it are stored its length and its
alignment a, the cosine between the rotated vector u (at length one) and the code vector b.  u = a b + r with r
orthogonal to b and of length sqrt(1 - a^2), so for an anchor q of length one

    <q, u> = a <q, b> + <q, r>,    |<q, r>| <= sqrt(1 - a^2) sqrt(1 - <q, b>^2)     (Cauchy-Schwarz).

<q, b> comes from popcounts of the code against bit planes of the anchor, whose rounding error is known.  The
interval is certain, not likely: rows whose interval cannot reach the first k are left out, all others are scored in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

SCALE = 256
ANCHOR_EACH, SHIFT_EACH, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 3, 9  # tenths of the positive's score
PLANES, ROTATIONS, SEED = 6, 3, 20240229
# Bytes of anchors that are sent to all executors at once; rows and anchors that a task estimates at once.
BLOCK_BYTES = 16 << 20
_ROWS, _ANCHORS = 4096, 256
_MOST = np.iinfo(np.int64).max
CODES = "vec_id long, label int, ints binary, code binary, align double, norm double"


def integers(vector) -> np.ndarray | None:
    """floor(256 x) per component, as whole doubles; None where the vector takes no part."""
    if vector is None or any(v is None for v in vector):
        return None
    x = np.asarray(vector, np.float64)
    return np.floor(np.clip(SCALE * x, -np.finfo(np.float64).max, np.finfo(np.float64).max)) if np.isfinite(x).all() else None


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` filled up to a power of two of dimensions and rotated: random signs and a Hadamard transform, three times."""
    size = max(64, 1 << max(0, x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, :x.shape[1]] = x
    signs = np.random.default_rng(SEED).integers(0, 2, (ROTATIONS, size)) * 2.0 - 1.0
    for sign in signs:
        y *= sign
        half = 1
        while half < size:
            pairs = y.reshape(len(y), size // (2 * half), 2, half)
            y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(y), size)
            half *= 2
        y /= np.sqrt(size)
    return y


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length one (a zero row stays) and their lengths."""
    top = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    scaled = x / safe[:, None]
    length = np.linalg.norm(scaled, axis=1)
    return scaled / np.where(length > 0, length, 1.0)[:, None], np.minimum(length * safe, np.finfo(np.float64).max)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (64-bit words), alignments and lengths of the rows of ``x``."""
    u, length = unit(x)
    u = rotate(u)
    code = np.ascontiguousarray(np.packbits(u >= 0, axis=1)).view(np.uint64)
    return code, np.minimum(np.abs(u).sum(axis=1) / np.sqrt(u.shape[1]), 1.0), length


class Anchors:
    """Anchors of one dimension, ready to be compared with codes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        q, self.length = unit(x)
        q = rotate(q)
        self.size = q.shape[1]
        self.low = q.min(axis=1, initial=np.inf)
        step = (q.max(axis=1, initial=-np.inf) - self.low) / ((1 << PLANES) - 1)
        self.step = np.where(step > 0, step, 1.0)
        levels = np.rint((q - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        rounded = self.low[:, None] + self.step[:, None] * levels
        self.error, self.sum = np.linalg.norm(q - rounded, axis=1), rounded.sum(axis=1)
        self.planes = np.stack([np.ascontiguousarray(np.packbits(levels >> j & 1, axis=1)).view(np.uint64) for j in range(PLANES)], axis=1)

    def interval(self, some: np.ndarray, code: np.ndarray, align: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of ``some`` anchors with the coded rows."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.float64)
        weighted = np.zeros((len(some), len(code)))
        for j in range(PLANES):
            for word in range(code.shape[1]):
                weighted += np.bitwise_count(self.planes[some, j, word][:, None] & code[None, :, word]) * float(1 << j)
        along = (2 * (self.low[some][:, None] * ones + self.step[some][:, None] * weighted) - self.sum[some][:, None]) / np.sqrt(self.size)
        error = self.error[some][:, None]
        away = np.sqrt(np.maximum(0.0, 1.0 - np.maximum(0.0, np.abs(along) - error) ** 2))
        half = align * error + np.sqrt(np.maximum(0.0, 1.0 - align ** 2)) * away + 1e-9
        with np.errstate(over="ignore"):
            scale = self.length[some][:, None] * norm
            return (align * along - half) * scale - 1e-6, (align * along + half) * scale + 1e-6


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-numbered rows, exact; beyond a long they stay at its ends."""
    bound = np.abs(x).max(initial=0.0) * np.abs(y).max(initial=0.0) * max(1, x.shape[1])
    if bound < 2.0 ** 53:  # every partial sum is a whole double
        return (x @ y.T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in side] for side in (x, y)]
    return np.array([[max(-_MOST - 1, min(_MOST, sum(a * b for a, b in zip(r, s)))) for s in whole[1]] for r in whole[0]], np.int64).reshape(len(x), len(y))


class Best:
    """The first ``k`` rows per key seen so far: higher scores first, ties by smaller id."""

    def __init__(self, keys: int, k: int):
        self.k, self.key, self.score, self.id = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.full = np.zeros(keys, bool)
        self.last = np.full(keys, -_MOST - 1, np.int64)  # the score of place k, where there is one

    def add(self, key: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        key, score, row_id = (np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.id, row_id)))
        order = np.lexsort((row_id, ~score, key))  # ~score descends without overflow
        key, score, row_id = key[order], score[order], row_id[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.k
        self.key, self.score, self.id = key[keep], score[keep], row_id[keep]
        last = place == self.k - 1
        self.last[key[last]] = score[last]


def _kth_lower(lower: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """Per anchor the k-th highest lower bound among the rows that can count: what cannot reach it is not among the first k."""
    if lower.shape[1] < k:
        return np.full(len(lower), -np.inf)
    return -np.partition(np.where(able, -lower, np.inf), k - 1, axis=1)[:, k - 1]


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of one dimension, a block at a time: ids, labels, integers, codes, alignments, lengths."""
    for batch in batches:
        for _, same in batch.groupby(batch["ints"].map(len), sort=False):
            for at in range(0, len(same), _ROWS):
                part = same.iloc[at:at + _ROWS]
                x, code = (np.frombuffer(b"".join(part[c]), t).reshape(len(part), -1) for c, t in (("ints", np.float64), ("code", np.uint64)))
                yield part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), x, code, part["align"].to_numpy(), part["norm"].to_numpy()


def _prepare(rows) -> dict[int, Anchors]:
    """The anchors of a block by dimension."""
    out = {}
    for size in {len(r[2]) for r in rows}:
        same = sorted((r for r in rows if len(r[2]) == size), key=lambda r: (r[1], r[0]))
        x = np.frombuffer(b"".join(r[2] for r in same), np.float64).reshape(len(same), -1)
        out[size // 8] = Anchors(np.array([r[0] for r in same], np.int64), np.array([r[1] for r in same], np.int64), x)
    return out


def _positives(shared):
    """Per task the first POSITIVES rows of the same label for every anchor of the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = _prepare(shared.value)
        best = {d: Best(len(a.ids), POSITIVES) for d, a in anchors.items()}
        for ids, labels, x, code, align, norm in _batches(batches):
            a = anchors.get(x.shape[1])
            for label in np.unique(labels) if a else ():
                mine, rows = np.flatnonzero(a.labels == label), np.flatnonzero(labels == label)
                for at in range(0, len(mine), _ANCHORS):
                    some = mine[at:at + _ANCHORS]
                    lower, upper = a.interval(some, code[rows], align[rows], norm[rows])
                    able = a.ids[some][:, None] != ids[rows][None, :]
                    least = np.maximum(_kth_lower(lower, able, POSITIVES), best[x.shape[1]].last[some].astype(np.float64))
                    able &= upper >= least[:, None]
                    seen = np.flatnonzero(able.any(axis=0))
                    score, able = dots(a.x[some], x[rows[seen]]), able[:, seen]
                    r, c = np.nonzero(able & (score >= best[x.shape[1]].last[some][:, None]))
                    best[x.shape[1]].add(some[r], score[r, c], ids[rows[seen[c]]])
        for d, b in best.items():
            yield pd.DataFrame({"anchor_id": anchors[d].ids[b.key], "positive_id": b.id, "positive_score": b.score})

    return run


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score that a positive score allows: 30 p <= 100 n <= 90 p.  None for p < 0."""
    whole, rest = np.divmod(positive, 10)  # no product of a whole score overflows
    return whole * LOW + -(-rest * LOW // 10), whole * HIGH + rest * HIGH // 10


def _negatives(shared, pairs):
    """Per task the first NEGATIVES rows of another label within the window of every (anchor, positive) of the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = _prepare(shared.value)
        of = {}
        for d, a in anchors.items():  # windows by (anchor, place of the positive); empty where there is none
            low, high = np.full((len(a.ids), POSITIVES), _MOST), np.full((len(a.ids), POSITIVES), -_MOST - 1)
            positive = np.zeros((2, len(a.ids), POSITIVES), np.int64)
            at = {int(v): k for k, v in enumerate(a.ids)}
            for anchor, place, positive_id, score in pairs.value:
                if anchor in at and score >= 0:
                    cell = at[anchor], place - 1
                    low[cell], high[cell] = window(np.int64(score))
                    positive[0][cell], positive[1][cell] = positive_id, score
            of[d] = low, high, positive, Best(len(a.ids) * POSITIVES, NEGATIVES)
        for ids, labels, x, code, align, norm in _batches(batches):
            a = anchors.get(x.shape[1])
            if a is None:
                continue
            low, high, _, best = of[x.shape[1]]
            for at in range(0, len(a.ids), _ANCHORS):
                some = np.arange(at, min(at + _ANCHORS, len(a.ids)))
                some = some[(low[some] <= high[some]).any(axis=1)]
                if not len(some):
                    continue
                lower, upper = a.interval(some, code, align, norm)
                other = a.labels[some][:, None] != labels[None, :]
                able, last = np.zeros_like(other), best.last.reshape(-1, POSITIVES)[some]
                for p in range(POSITIVES):
                    lo, hi = low[some, p].astype(np.float64), high[some, p].astype(np.float64)
                    sure = other & (lower >= lo[:, None]) & (upper <= hi[:, None])
                    least = np.maximum(np.maximum(lo, _kth_lower(np.where(sure, lower, -np.inf), sure, NEGATIVES)), last[:, p].astype(np.float64))
                    able |= (upper >= least[:, None]) & (lower <= hi[:, None])
                able &= other
                seen = np.flatnonzero(able.any(axis=0))
                score, able = dots(a.x[some], x[seen]), able[:, seen]
                for p in range(POSITIVES):
                    fits = able & (score >= np.maximum(low[some, p], last[:, p])[:, None]) & (score <= high[some, p][:, None])
                    r, c = np.nonzero(fits)
                    best.add(some[r] * POSITIVES + p, score[r, c], ids[seen[c]])
        for d, (_, _, positive, b) in of.items():
            row, place = b.key // POSITIVES, b.key % POSITIVES
            yield pd.DataFrame({"anchor_id": anchors[d].ids[row], "positive_id": positive[0][row, place], "place": place,
                                "negative_id": b.id, "positive_score": positive[1][row, place], "negative_score": b.score})

    return run


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        whole = batch.assign(ints=[integers(v) for v in batch["embedding"]])
        whole = whole[whole["ints"].map(lambda v: v is not None)]
        for _, same in whole.groupby(whole["ints"].map(len), sort=False):
            x = np.stack(list(same["ints"]))
            code, align, norm = encode(x)
            yield pd.DataFrame({"vec_id": same["vec_id"], "label": same["label"], "ints": [r.tobytes() for r in x],
                                "code": [c.tobytes() for c in code], "align": align, "norm": norm})


def coded(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, ints, code, align, norm`` of the rows that take part, one per vec_id (the least label, then the least vector)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                             F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    shifted = F.when(F.col("vec_id") % SHIFT_EACH == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    single = fit.select("vec_id", shifted.alias("label"), "embedding").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("m"))
    return materialise(single.select("vec_id", "m.label", "m.embedding").mapInPandas(_coded, CODES), "codes")


def mine(embeddings: DataFrame, anchor_each: int = ANCHOR_EACH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: the first negatives per anchor and positive.

    Anchors are the rows whose vec_id is divisible by ``anchor_each``: a stated query set, sent in blocks of about
    ``block_bytes`` and compared with all rows.  Rows with a null vec_id, label or vector, or with a component that is
    null or not finite, take no part.  Of rows that repeat a vec_id, the one with the least label, then the least
    vector, takes part.  Vectors of different dimension do not meet; zero and empty vectors score 0.  Scores are exact;
    beyond a long they stay at its ends.  A positive with a negative score allows no negative.  An empty table gives no
    rows; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = coded(embeddings)
    anchors = rows.filter(F.col("vec_id") % anchor_each == 0).select("vec_id", "label", "ints")
    size = anchors.agg(F.sum(F.octet_length("ints") + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = None
    for block in range(blocks):
        some = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        if not some:
            continue
        shared = spark.sparkContext.broadcast([(r[0], r[1], bytes(r[2])) for r in some])
        order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
        found = (rows.mapInPandas(_positives(shared), "anchor_id long, positive_id long, positive_score long")
                 .withColumn("place", order).filter(F.col("place") <= POSITIVES))
        # POSITIVES rows per anchor of the block, so bounded as the block is.
        pairs = spark.sparkContext.broadcast([(r["anchor_id"], r["place"], r["positive_id"], r["positive_score"]) for r in found.collect()])
        key = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        ranked = (rows.mapInPandas(_negatives(shared, pairs), "anchor_id long, positive_id long, place int, negative_id long, positive_score long, negative_score long")
                  .withColumn("rank", F.row_number().over(key)).filter(F.col("rank") <= NEGATIVES)
                  .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        ranked = materialise(ranked, "negatives") if blocks > 1 else ranked
        out = ranked if out is None else out.union(ranked)
    return out if out is not None else spark.createDataFrame([], schema)
