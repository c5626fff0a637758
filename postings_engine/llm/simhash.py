"""SimHash near-dedup by covering locality-sensitive hashing.

Every bit position gets a nonzero vector of r + 1 bits; for each nonzero vector v of r + 1 bits, table
v masks the positions whose vector has an odd product with v.  The vectors of r differing positions
span at most r dimensions, so some v is orthogonal to all of them and table v masks none of them: every
pair within radius r shares a key in one of the 2^(r+1) - 1 tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import python_text, stored
from .graph import components

RADIUS = 3
SHINGLE = 3
SEED = 42
# A bucket with more fingerprints is split by a second cover of the bits that its mask leaves open.
SPLIT_OVER = 512
_BLOCK = 1 << 15


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Bit masks over ``positions``, one per table, such that up to ``radius`` positions miss one mask wholly."""
    tables = (1 << (radius + 1)) - 1
    vector = {p: 1 + i % tables for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, tables + 1)]


def signed(value: int) -> int:
    """A 64-bit pattern as Spark's signed long."""
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text as a signed long; 0 without a word."""
    # bytes.lower() and bytes.split() know ASCII alone: A-Z, and the blanks 0x20 and 0x09-0x0D.
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
        total = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for start in range(0, total, _BLOCK):
        joined = b"".join([digest(s, SEED) for s in islice(shingles, _BLOCK)])
        ones += np.unpackbits(np.frombuffer(joined, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return signed(int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big"))


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _keys(fp, masks: list[int]):
    return F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)]))


def near(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (indexes) that connect everything connected within the radius: a search tree per component.

    Each found fingerprint is compared with those not yet found, so a dense group shrinks at once.
    """
    left, links = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            found = left[close]
            left = left[~close]
            links += [(at, x) for x in found]
            queue += list(found)
    return links


def _connect(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for fps, reps in zip(batch["fps"], batch["reps"]):
                for x, y in near(np.asarray(fps, np.int64).view(np.uint64), radius):
                    a.append(reps[x])
                    b.append(reps[y])
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def link_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between fingerprints (columns fp, rep: distinct) that keep everything within the radius connected.

    A bucket of up to SPLIT_OVER fingerprints is searched as it is.  A larger one is searched in
    sub-buckets of a second cover, over the bits that its mask leaves open, which misses no pair
    either; two masks leave about 2^14 fingerprints possible per sub-bucket, whatever the input.
    """
    masks = covering_masks(list(range(64)), radius)
    open_bits = [[p for p in range(64) if not m >> p & 1] for m in masks]
    finer = [[m | x for x in covering_masks(bits, radius)] for m, bits in zip(masks, open_bits)]
    keyed = prints.select("fp", "rep", _keys(F.col("fp"), masks).alias("k")).select("fp", "rep", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    full = keyed.join(sizes, ["t", "key"])
    sub = [F.struct(F.lit(u).alias("u"), F.col("fp").bitwiseAND(
        F.element_at(F.array(*[F.lit(signed(m[u])) for m in finer]), F.col("t") + 1)).alias("sub")) for u in range(len(masks))]
    whole = F.array(F.struct(F.lit(-1).alias("u"), F.lit(0).cast("long").alias("sub")))
    cut = full.select("t", "key", "fp", "rep", F.explode(F.when(F.col("n") > SPLIT_OVER, F.array(*sub)).otherwise(whole)).alias("s"))
    spread = cut.select("t", "key", "s.u", "s.sub", "fp", "rep").repartition("t", "key", "u", "sub")
    groups = (spread.groupBy("t", "key", "u", "sub").agg(F.collect_list(F.struct("fp", "rep")).alias("m"))
              .filter(F.size("m") > 1).select(F.col("m.fp").alias("fps"), F.col("m.rep").alias("reps")))
    return groups.mapInPandas(_connect(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id``: documents whose fingerprints differ in at most ``radius`` bits are linked.

    component_id is the least doc_id reached.  Null and empty texts have fingerprint 0 and are linked
    like any others.  A row without doc_id is fingerprinted but links to nothing (component_id null);
    rows that repeat an id are each returned.  Texts of any length are read whole, once, a block of shingles at a
    time, and never shuffled; links are made between distinct fingerprints, so copies of any number cost one.  A
    bit set in exactly half of the hashes is 0.  Other columns are not read; an empty table gives no rows.
    """
    prints = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(python_text(docs)).alias("fp")), "fingerprints")
    distinct = stored(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    roots = components(link_fingerprints(distinct, radius))
    # A component of nodes named by their least doc_id: its least node is its least doc_id.
    classes = distinct.join(roots, distinct["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    joined = prints.join(classes, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
