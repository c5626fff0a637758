"""Line dedup with two Bloom filters.

A first count of lines tells into how many ranges of hashes the filters are dealt, so that a range has about
the same number of lines at any size.  A pass over the texts sends each range the hashes of its lines (never
the lines), where a filter of lines seen once finds those that are seen again; from these the range makes its
part of the second filter, of lines seen twice, as large as what it holds.  Another pass over the texts sends
only the lines that the second filter suspects to an exact count, which also chooses the first occurrence.

No line of two documents is missed.  Both filters keep 16 bits or more a line, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .frames import python_text, stored, text_key, whole_text

# Bits of the once-seen filter of one range of hashes, and bits a line.
BITS, BITS_PER_LINE = 1 << 24, 16
# Hashes that a task holds before it sends them on.
HELD = 1 << 20
# A second filter up to this size is sent to every task; beyond it, every line is counted exactly.
FILTER_BYTES = 64 << 20
# Repeated lines up to this size are sent to every task; more are joined.
SENT_BYTES = 8 << 20
BLANKS = b" \t\n\x0b\x0c\r"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes) -> bytes:
    """A line with blanks stripped and A-Z lower-cased; bytes.lower() changes ASCII letters alone."""
    return line.strip(BLANKS).lower()


def line_keys(text: str, min_chars: int) -> set[bytes]:
    """The distinct keys of a text that have enough code points."""
    keys = set(map(line_key, (text or "").encode().split(b"\n")))
    if min_chars <= 1:
        keys.discard(b"") if min_chars == 1 else None
        return keys
    return {k for k in keys if len(k.decode()) >= min_chars}


def _segments_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The range of each hash: ``segments`` equal ranges of the upper 32 bits, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _slots(hashes: np.ndarray, bits) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a filter of ``bits`` (a power of two up to 2^24, or one per hash)."""
    last = np.asarray(bits, np.uint64) - np.uint64(1)
    return (hashes & last).astype(np.int64), (hashes * _MIX >> np.uint64(40) & last).astype(np.int64)


def _has(filter_: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the filter, eight bits a byte, has each of the bits."""
    return (filter_[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def _add(filter_: np.ndarray, slots: np.ndarray) -> None:
    np.bitwise_or.at(filter_, slots >> 3, np.left_shift(1, slots & 7).astype(np.uint8))


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _by_segment(held: list[np.ndarray], segments: int) -> pd.DataFrame:
    """One row per range: its hashes in order, those of several documents twice."""
    hashes, counts = np.unique(np.concatenate(held), return_counts=True)
    hashes = np.repeat(hashes, np.minimum(counts, 2))
    of = _segments_of(hashes, segments)
    cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
    return pd.DataFrame({"segment": of[np.r_[0, cuts]], "hashes": [h.tobytes() for h in np.split(hashes, cuts)]})


def _deal(segments: int, min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append(_hashes(line_keys(text, min_chars)))
                size += len(held[-1])
                if size >= HELD:
                    yield _by_segment(held, segments)
                    held, size = [], 0
        if size:
            yield _by_segment(held, segments)

    return run


def _filter_of(hashes: np.ndarray) -> bytes:
    """A filter of these hashes, BITS_PER_LINE to twice as many bits each."""
    bits = min(max(64, 1 << int(BITS_PER_LINE * len(hashes) - 1).bit_length()), 1 << 24)
    filled = np.zeros(bits // 8, np.uint8)
    for slots in _slots(hashes, bits):
        _add(filled, slots)
    return filled.tobytes()


def _part_of(segment, again: list[np.ndarray]) -> pd.DataFrame:
    hashes = np.unique(np.concatenate(again))
    return pd.DataFrame([(segment, _filter_of(hashes))] if len(hashes) else [], columns=["segment", "twice"])


def _find_twice(bits: int):
    """Reads the ranges of a task one after the other: one once-seen filter, and the hashes it has seen again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, segment, again = np.zeros(bits // 8, np.uint8), None, [np.zeros(0, np.uint64)]

        for batch in batches:
            for at, packed in zip(batch["segment"], batch["hashes"]):
                if at != segment:
                    yield _part_of(segment, again)
                    once[:] = 0
                    segment, again = at, [np.zeros(0, np.uint64)]
                hashes = np.frombuffer(packed, np.uint64)
                a, b = _slots(hashes, bits)
                seen = _has(once, a) & _has(once, b)
                seen[1:] |= hashes[1:] == hashes[:-1]
                again.append(np.unique(hashes[seen]))
                if len(again) > 64:
                    again = [np.unique(np.concatenate(again))]
                _add(once, a)
                _add(once, b)
        yield _part_of(segment, again)

    return run


def twice_seen(docs: DataFrame, bits: int = BITS, min_chars: int = 1) -> tuple[DataFrame, int]:
    """``segment, twice``: the parts of the filter of lines that may occur in two documents, and the number of ranges.

    A task holds HELD hashes, or one range's once-seen filter of ``bits`` and its repeated hashes.  A line in many
    documents is sent at most twice for every HELD hashes of a task.
    """
    breaks = F.octet_length(whole_text()) - F.octet_length(F.replace(whole_text(), F.lit("\n"), F.lit("")))
    lines = docs.agg(F.sum(breaks.cast("long") + 1).alias("n")).first()["n"] or 0
    segments = max(1, -(-lines * BITS_PER_LINE // bits))
    dealt = docs.select(python_text(docs).alias("text")).mapInPandas(_deal(segments, min_chars), "segment long, hashes binary")
    parts = dealt.repartition("segment").sortWithinPartitions("segment").mapInPandas(_find_twice(bits), "segment long, twice binary")
    return stored(parts, "twice-seen"), segments


def second_filter(docs: DataFrame, bits: int, min_chars: int, filter_bytes: int):
    """The second filter as every task reads it: a broadcast, or None if it is larger than ``filter_bytes``."""
    parts, segments = twice_seen(docs, bits, min_chars)
    if (parts.agg(F.sum(F.octet_length("twice").cast("long")).alias("n")).first()["n"] or 0) > filter_bytes:
        return None
    # Ranges without a repeated line read one bit that is never set.
    sizes, starts, filled, at = np.ones(segments, np.uint64), np.zeros(segments, np.int64), [bytes(8)], 64
    for row in parts.collect():
        sizes[row["segment"]], starts[row["segment"]] = 8 * len(row["twice"]), at
        filled.append(bytes(row["twice"]))
        at += 8 * len(row["twice"])
    return docs.sparkSession.sparkContext.broadcast((segments, sizes, starts, b"".join(filled)))


def _suspected(keys: list[bytes], segments: int, sizes: np.ndarray, starts: np.ndarray, filled: np.ndarray) -> list[bytes]:
    """The keys that the second filter has."""
    hashes = _hashes(keys)
    of = _segments_of(hashes, segments)
    a, b = _slots(hashes, sizes[of])
    return [keys[i] for i in np.flatnonzero(_has(filled, starts[of] + a) & _has(filled, starts[of] + b))]


def suspects(docs: DataFrame, bits: int = BITS, min_chars: int = 1, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``text_key, doc_id, line``: the distinct keys of every document that the second filter suspects.

    If that filter is too large to be sent, these are all keys: more lines to count, the same repeated ones.
    """
    return _suspects(docs, second_filter(docs, bits, min_chars, filter_bytes), min_chars)


def _suspects(docs: DataFrame, shared, min_chars: int) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def suspected(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if shared is not None:
            segments, sizes, starts, packed = shared.value
            filled = np.frombuffer(packed, np.uint8)
        for texts in parts:
            keys = [list(line_keys(text, min_chars)) for text in texts]
            yield pd.Series(keys if shared is None else [_suspected(k, segments, sizes, starts, filled) for k in keys], dtype=object)

    return docs.select(text_key().alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.explode(suspected(python_text(docs))).alias("line"))


# Stands for "no document keeps it", and for a null id among the keepers.
_NOBODY, _NULL_ID = -(1 << 63), -(1 << 63) + 1


def without(text: str, doc_id: int, keeper_of) -> tuple[int, int, str]:
    """Lines of a text, lines dropped, and the text that stays; ``keeper_of`` gives a repeated line's keeper."""
    lines, kept, stayed = text.encode().split(b"\n"), [], set()
    for line in lines:
        key = line_key(line)
        keeper = keeper_of(key)
        if keeper is None or keeper == doc_id and key not in stayed:
            kept.append(line)
            stayed.add(key)
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode() if len(kept) < len(lines) else text


_OUT = T.StructType().add("n_lines", T.LongType()).add("n_dropped", T.LongType()).add("kept", T.StringType())


def _drop_known(shared):
    """Drops the lines of a table (line: keeper) that every task has."""

    @F.pandas_udf(_OUT)
    def drop(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ids in parts:
            yield pd.DataFrame([without(t, i, shared.value.get) for t, i in zip(texts, ids)], columns=_OUT.names)

    return drop


@F.pandas_udf(_OUT)
def _drop_listed(texts: pd.Series, ids: pd.Series, lines: pd.Series, keepers: pd.Series) -> pd.DataFrame:
    """Drops the lines that come with each text."""
    listed = [{} if ls is None else dict(zip(ls, ks)) for ls, ks in zip(lines, keepers)]
    return pd.DataFrame([without(t, i, ls.get) for t, i, ls in zip(texts, ids, listed)], columns=_OUT.names)


def repeated_lines(found: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """``line, keeper``: keys in at least ``min_docs`` documents, and the document that keeps its first line."""
    counted = (found.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"))
               .filter(F.col("docs") >= min_docs))
    keeper = F.coalesce("first", F.lit(_NULL_ID)) if keep_first else F.lit(_NOBODY)
    return stored(counted.select("line", keeper.alias("keeper")), "repeated-lines")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                        bits: int = BITS, sent_bytes: int = SENT_BYTES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """All columns of ``docs`` in ``row``, and ``n_lines, n_dropped, kept``.

    A line's key is the line stripped of blanks, A-Z lower-cased.  Keys of at least ``min_chars`` code
    points found in at least ``min_docs`` documents (rows) lose their lines everywhere or, with
    ``keep_first``, all but the first line in the document with the least doc_id.  A null or empty text is one
    empty line; rows that repeat a doc_id count as documents and share its choice; an empty table gives no rows.
    Very long texts are read whole.  ``docs`` is read four times: store it first if it is costly.

    Up to ``sent_bytes`` of repeated lines are sent to every task, and the texts stay where they are.  More
    are joined to the texts that have them, by a key of the text, so ids may be null and a third of all
    texts may be equal: Spark's skew join splits them.  Both ways give the same rows.
    """
    found = suspects(docs, bits, min_chars, filter_bytes)
    repeated = repeated_lines(found, min_docs, keep_first)
    ids = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_NULL_ID))
    size = repeated.agg(F.sum(F.octet_length("line") + 64).alias("bytes")).first()["bytes"] or 0
    if size <= sent_bytes:
        known = {bytes(r["line"]): r["keeper"] for r in repeated.collect()}
        # Not deterministic for the planner only: a filter on the results must not run the function twice.
        drop = _drop_known(docs.sparkSession.sparkContext.broadcast(known)).asNondeterministic()
        return docs.select(F.struct("*").alias("row"), drop(python_text(docs), ids("doc_id")).alias("out")).select("row", "out.*")
    pairs = found.select("text_key", "line").distinct()
    # Written out, so that the join with the texts reads both sides by themselves and can split a frequent text.
    drops = materialise(pairs.join(repeated, "line").groupBy("text_key").agg(F.collect_list(F.struct("line", "keeper")).alias("drops")), "lines-to-drop")
    joined = docs.select(F.struct("*").alias("row"), text_key().alias("text_key")).join(drops, "text_key", "left")
    dropped = _drop_listed.asNondeterministic()(F.coalesce("row.text", F.lit("")), ids("row.doc_id"), F.col("drops.line"), F.col("drops.keeper"))
    return joined.select("row", dropped.alias("out")).select("row", "out.*")
