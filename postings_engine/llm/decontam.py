"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A word n-gram of a test item is a seed if some document holds it and it is rare, by itself or beside the rarest ones
around it (a passage with many copies has no rarer ones); and of every SPAN consecutive n-grams the rarest that
some document holds is one.  An n-gram that no document holds, such as one that an edit broke, is never taken for
another.  A document that holds a seed is aligned with the item around it; a score near the item's own length tells a copy,
edited or not.

The test items are a stated query set.  They are read in blocks of bounded size, and each block is compared
with all documents, so what is sent to the executors is bounded by the block size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import python_text

SEED_WORDS = 3
SPAN = 2
# Documents that a rare n-gram may be in, beside RARE_TIMES those of the rarest among the AROUND n-grams around it.
RARE, RARE_TIMES, AROUND = 100, 2, 16
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.6
# Words of test items in one block.
BLOCK_WORDS = 1_000_000

# Scripts written without blanks: each character is a word.
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_SINGLE}]+|[{_SINGLE}]")
HITS = "array<struct<item_id:long, score:double, start_word:int, end_word:int, matched_words:int>>"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Block:
    """Test items as word numbers; ``grams`` are the codes of their n-grams, sorted."""

    vocabulary: dict[str, int]
    ids: list[int | None]
    items: list[np.ndarray]
    grams: np.ndarray
    seeds: dict[int, list[tuple[int, int]]]

    @property
    def short(self) -> set[int]:
        """Lengths of the items that have fewer words than an n-gram."""
        return {len(x) for x in self.items if len(x) < SEED_WORDS}


def gram_codes(numbers: np.ndarray, size: int) -> np.ndarray:
    """One exact code per n-gram of word numbers below ``size``; -1 where a word is unknown."""
    n = len(numbers) - SEED_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(SEED_WORDS):
        part = numbers[k:k + n]
        code = code * size + part
        known &= part >= 0
    return np.where(known, code, -1)


def item_codes(item: np.ndarray, size: int) -> np.ndarray:
    """The codes of an item's n-grams; an item with fewer words than one is a single seed, whole."""
    if len(item) >= SEED_WORDS:
        return gram_codes(item, size)
    return np.array([whole_code(item, size)], np.int64)


def whole_code(words_: np.ndarray, size: int) -> int:
    """A code for fewer words than an n-gram has, apart from those of n-grams."""
    return -2 - int(sum(int(w) * size ** k for k, w in enumerate(words_))) * SEED_WORDS - len(words_)


def text_codes(numbers: np.ndarray, size: int, short: set[int]) -> list[np.ndarray]:
    """Codes by place, -1 where there is none: of n-grams, and of each length of shorter items in the block."""
    out = [gram_codes(numbers, size)]
    for n in sorted(short):
        places = len(numbers) - n + 1
        if places > 0:
            code, known = np.zeros(places, np.int64), np.ones(places, bool)
            for k in range(n):
                part = numbers[k:k + places]
                code += part * size ** k
                known &= part >= 0
            out.append(np.where(known, -2 - code * SEED_WORDS - n, -1))
    return out


def read_block(rows: list[tuple[int | None, list[str]]]) -> Block:
    vocabulary: dict[str, int] = {}
    items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for _, ws in rows]
    codes = [item_codes(x, len(vocabulary)) for x in items]
    grams = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)]))
    return Block(vocabulary, [i for i, _ in rows], items, grams, {})


def choose_seeds(block: Block, documents: np.ndarray) -> None:
    """Keep the n-grams that are rare, and the rarest of every SPAN; ``documents`` counts documents per gram, and none means no seed."""
    seeds = defaultdict(list)
    for no, item in enumerate(block.items):
        codes = item_codes(item, len(block.vocabulary))
        counts = documents[np.searchsorted(block.grams, codes)]
        held = np.where(counts > 0, counts, np.iinfo(np.int64).max)
        chosen = set()
        for at in range(0, len(codes), AROUND // 2):
            near = held[max(0, at - AROUND // 4):at + AROUND * 3 // 4]
            if near.min() < np.iinfo(np.int64).max:
                chosen.update(at + np.flatnonzero(held[at:at + AROUND // 2] <= RARE + RARE_TIMES * near.min()))
        for at in range(max(1, len(codes) - SPAN + 1)):
            best = at + int(np.argmin(held[at:at + SPAN]))
            if counts[best]:
                chosen.add(best)
        for at in sorted(chosen):
            seeds[int(codes[at])].append((no, int(at)))
    block.seeds = dict(seeds)


def _fill(scores: np.ndarray, item: np.ndarray, part: np.ndarray) -> None:
    """Rows 1 and on of ``scores`` from row 0; gaps along a row are a running maximum, since each costs the same."""
    ramp = (-GAP * np.arange(scores.shape[1])).astype(scores.dtype)
    for i in range(1, len(scores)):
        row = np.maximum(scores[i - 1] + GAP, 0)
        row[1:] = np.maximum(row[1:], scores[i - 1, :-1] + np.where(part == item[i - 1], MATCH, MISMATCH))
        scores[i] = np.maximum.accumulate(row + ramp) - ramp


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int, int]:
    """The best local alignment: score, first and one past the last word of ``part``, and matched words.

    Of the score matrix one row in about sqrt(item) is kept; the way back fills the rows between two of them again, so
    memory is some 2 sqrt(item) rows: 50 MB for 20,000 words against 40,000.
    """
    n, m = len(item), len(part)
    step = int(np.sqrt(n)) + 1
    kept, best, top = {0: np.zeros(m + 1, np.int32)}, 0, (0, 0)

    def rows_from(start: int) -> np.ndarray:
        rows = np.zeros((min(step, n - start) + 1, m + 1), np.int32)
        rows[0] = kept[start]
        _fill(rows, item[start:start + len(rows) - 1], part)
        return rows

    for start in range(0, n, step):
        rows = rows_from(start)
        if int(rows.max()) > best:
            best = int(rows.max())
            i, j = np.unravel_index(int(rows.argmax()), rows.shape)
            top = start + int(i), int(j)
        kept[start + len(rows) - 1] = rows[-1].copy()
    (i, j), matched, start, rows = top, 0, None, None
    end = j
    while i and j:
        if start is None or i <= start:
            start = (i - 1) // step * step
            rows = rows_from(start)
        here = rows[i - start, j]
        if here <= 0:
            break
        same = item[i - 1] == part[j - 1]
        if here == rows[i - start - 1, j - 1] + (MATCH if same else MISMATCH):
            i, j, matched = i - 1, j - 1, matched + bool(same)
        elif here == rows[i - start - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, int(j), end, matched


def _could_match(item: np.ndarray, part: np.ndarray, need: float) -> bool:
    """Whether the words that both have, wherever they stand, are enough for ``need`` matches."""
    known = part[part >= 0]
    names, counts = np.unique(item, return_counts=True)
    found = np.bincount(known, minlength=int(names[-1]) + 1)[names]
    return np.minimum(found, counts).sum() >= need


def find(text: str, block: Block, min_score: float = MIN_SCORE) -> list[tuple]:
    """Items that ``text`` holds: (item_id, score, start_word, end_word, matched_words), best alignment each."""
    numbers = np.array([block.vocabulary.get(w, -1) for w in words(text)], np.int64)
    hits = []
    for codes in text_codes(numbers, len(block.vocabulary), block.short):
        known = np.flatnonzero(codes != -1)
        at = np.minimum(np.searchsorted(block.grams, codes[known]), len(block.grams) - 1)
        places = known[block.grams[at] == codes[known]] if len(block.grams) else known[:0]
        hits += [(no, int(p) - at) for p in places for no, at in block.seeds.get(int(codes[p]), ())]
    best: dict[int, tuple] = {}
    regions: dict[int, list[list[int]]] = defaultdict(list)
    for no, start in sorted(hits):
        size = len(block.items[no])
        slack = size // 2 + 1
        low, high = max(0, start - slack), min(len(numbers), start + size + slack)
        # A seed that starts the item close to the one before extends its region, up to some items' lengths.
        if regions[no] and low <= regions[no][-1][1] - size and high - regions[no][-1][0] <= 4 * size + 4:
            regions[no][-1][1] = max(high, regions[no][-1][1])
        else:
            regions[no].append([low, high])
    for no, spans in regions.items():
        item = block.items[no]
        need = min_score * MATCH * len(item)
        for low, high in spans:
            part = numbers[low:high]
            if not _could_match(item, part, need / MATCH):
                continue
            score, start, end, matched = align(item, part)
            if score >= need and (no not in best or score > best[no][0]):
                best[no] = (score, low + start, low + end, matched)
    return [(block.ids[no], s / (MATCH * len(block.items[no])), a, b, m) for no, (s, a, b, m) in sorted(best.items())]


def _share(spark, block: Block):
    """Broadcast the block's parts: its size is bounded by BLOCK_WORDS."""
    return spark.sparkContext.broadcast((block.vocabulary, block.ids, block.items, block.grams, block.seeds))


def _document_counts(docs: DataFrame, block: Block) -> np.ndarray:
    """Documents per n-gram of the block, over the whole corpus."""
    shared = _share(docs.sparkSession, block)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = Block(*shared.value)
        counts, short = np.zeros(len(b.grams), np.int64), b.short
        for batch in batches:
            for text in batch["text"]:
                numbers = np.array([b.vocabulary.get(w, -1) for w in words(text)], np.int64)
                codes = np.concatenate(text_codes(numbers, len(b.vocabulary), short))
                codes = np.unique(codes[codes != -1])
                at = np.minimum(np.searchsorted(b.grams, codes), len(b.grams) - 1)
                counts[at[b.grams[at] == codes]] += 1
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pd.DataFrame({"gram": seen, "n": counts[seen]})

    out = np.zeros(len(block.grams), np.int64)
    texts = docs.select(python_text(docs).alias("text"))
    for row in texts.mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list]:
    rows, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").toLocalIterator():
        ws = words(row[1])
        if not ws:
            continue
        rows.append((row[0], ws))
        size += len(ws)
        if size >= block_words:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def hits(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> Column:
    """A column for ``docs`` (its column text): the test items each text holds.

    Words are runs of letters, digits and underscores, lower-cased; in scripts without blanks each character is one.  The
    score is the alignment's, over that of the item with itself.  An item with fewer than SEED_WORDS words is a seed as a
    whole, so found word for word only; one without a word, and null texts on either side, hold nothing; no items give empty arrays.  A repeated item
    is found under each of its ids, and repeated document rows have each their own.  Texts of any length are read whole.
    Any SPAN + SEED_WORDS - 1 unchanged words of an item hold a seed.
    """
    spark = docs.sparkSession
    found = F.array().cast(HITS)
    for rows in _blocks(benchmark, block_words):
        block = read_block(rows)
        choose_seeds(block, _document_counts(docs, block))
        found = F.concat(found, _finder(_share(spark, block), min_score)(python_text(docs)))
    return found


def _finder(shared, min_score: float):
    @F.pandas_udf(HITS)
    def held(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        b, names = Block(*shared.value), ("item_id", "score", "start_word", "end_word", "matched_words")
        for texts in parts:
            yield pd.Series([[dict(zip(names, h)) for h in find(t, b, min_score)] for t in texts], dtype=object)

    return held


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word, matched_words``: every document and test item it holds.

    Texts are scanned where they lie, once for the counts and once for the hits; nothing is shuffled
    but the counts, so a passage that a third of all documents share costs no more than any other.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(hits(docs, benchmark, **options)).alias("h"))
            .select("doc_id", "h.*"))
