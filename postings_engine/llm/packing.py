"""Packing by minimum bin slack.

Documents become token pieces of at most one window.  Only the number of pieces per length counts for
packing, so the plan is made from that histogram: the longest remaining length opens a window, a
bitset subset-sum over the remaining lengths finds the sum closest to the room left, and backtracking
gives how many pieces of each length make it.  The same filling is used as often as its counts allow, so
the plan has a bounded number of fillings for any number of pieces.  Pieces then find their
window by their position within their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .frames import per_worker, python_text, stored
from .ranking import hash_bucket, positions, seeded_hash

WINDOW = 2048
END_ID = 1
SEED = 7
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
# Runs this long go to the slower encoder, whose time doesn't grow with the square of a run.
_LONG_RUN = re.compile(r"\S{1024}|\s{1024}")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoders(folder_json: str, folder_ranks: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(folder_ranks, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(folder_json), fast


def encode(text: str, json_file: str, ranks_file: str) -> list[int]:
    """Token ids as the vocabulary's JSON gives them, without special tokens added.

    The ranks file is the same vocabulary for a faster encoder.  The special token's string
    in a text is its one id in the JSON's encoder, so it is cut out here.
    """
    exact, fast = per_worker(f"encoders {json_file} {ranks_file}", lambda: _encoders(json_file, ranks_file))
    if _LONG_RUN.search(text):
        return exact.encode(text, add_special_tokens=False).ids
    if SPECIAL not in text:
        return fast.encode_ordinary(text)
    ids: list[int] = []
    for i, part in enumerate(text.split(SPECIAL)):
        ids += [SPECIAL_ID] * (i > 0) + fast.encode_ordinary(part)
    return ids


def token_pieces(docs: DataFrame, window: int = WINDOW, with_ids: bool = False, json_file: str | None = None,
                 ranks_file: str | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``, little-endian 32-bit) per piece.

    A document is its text's ids and END_ID, cut into windows and a rest.  A null text is empty: one id.
    """
    files = (json_file or vocabulary("byte_bpe_50k.json"), ranks_file or vocabulary("byte_bpe_50k.tiktoken"))
    fields = "start long, length int, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    @F.pandas_udf(f"array<struct<{fields.replace(' ', ':')}>>".replace(",:", ", "))
    def pieces(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            ids = np.array([*encode(text, *files), END_ID], dtype="<u4")
            rows = []
            for at in range(0, len(ids), window):
                raw = ids[at:at + window].tobytes()
                rows.append({"start": at, "length": len(raw) // 4, "ids_crc32": zlib.crc32(raw), "doc_tokens": len(ids)}
                            | ({"ids": raw} if with_ids else {}))
            out.append(rows)
        return pd.Series(out, dtype=object)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(pieces(python_text(docs))).alias("p")).select("doc_id", "p.*")


@dataclass
class Filling:
    """``times`` windows, each with ``count`` pieces of each length, in order."""

    counts: list[tuple[int, int]]
    times: int


def fill(room: int, counts: dict[int, int], lengths: list[int]) -> list[tuple[int, int]]:
    """The multiset of remaining lengths whose sum comes closest to ``room``: (length, count) pairs.

    Bit s of ``reach`` tells that some of the lengths so far sum to s.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        most = min(counts[length], room // length)
        before, left, step = reach, most, 1
        while left:
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach != before:
            steps.append((length, most, before))
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, []
    for length, most, before in reversed(steps):
        n = next(n for n in range(most + 1) if total >= n * length and before >> (total - n * length) & 1)
        if n:
            used.append((length, n))
            total -= n * length
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[Filling]:
    """Fillings that use up the histogram (length: number of pieces)."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = dict(fill(window - first, counts, [n for n in lengths if counts[n]]))
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= k * times
        out.append(Filling(sorted(chosen.items(), reverse=True), times))
        lengths = [n for n in lengths if counts[n]]
    return out


def places(fillings: list[Filling]) -> dict[int, np.ndarray]:
    """Per length, rows (first position, first sequence, pieces a window, offset) in order of position."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling in fillings:
        at = 0
        for length, count in filling.counts:
            rows.setdefault(length, []).append((used.get(length, 0), sequence, count, at))
            used[length] = used.get(length, 0) + count * filling.times
            at += length * count
        sequence += filling.times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, window: int = WINDOW, with_ids: bool = False, **files: str) -> DataFrame:
    """Pieces (see ``token_pieces``) with ``sequence_id`` and ``offset``: windows of at most ``window`` ids.

    Sequence ids are gapless from 0, and so are offsets within one.  Every id of every document lies in one
    piece; null and empty texts are one id; rows that repeat are packed as often; null ids are kept; an
    empty table gives no rows; other columns are not read.  Texts are tokenised once and not shuffled.
    The histogram has at most ``window`` rows, and the plan's size follows from ``window`` too, not from the input.
    """
    store = materialise if with_ids else stored
    pieces = store(token_pieces(docs, window, with_ids, **files), "token-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, window)))
    ranked = positions(pieces.withColumn("_h", seeded_hash(SEED, "doc_id", "start", "ids_crc32")), ["length"], hash_bucket("_h"),
                       ["_h", F.col("doc_id").asc_nulls_first(), "start", "ids_crc32", "doc_tokens"], "_rank")

    @F.pandas_udf("sequence_id long, offset long")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, ranks in parts:
            lengths, ranks = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows, table = np.flatnonzero(lengths == length), where.value[int(length)]
                first, base, count, at = table[np.searchsorted(table[:, 0], ranks[rows], "right") - 1].T
                nth = ranks[rows] - first
                sequence[rows], offset[rows] = base + nth // count, at + nth % count * length
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                         "_place.sequence_id", "_place.offset", *(["ids"] if with_ids else []))
