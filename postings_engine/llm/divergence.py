"""Source divergence audit: how differently the sources of a language use its terms.

Terms are counted per (language, source) group where the texts lie; only the counts are shuffled.  The
terms that a language keeps are numbered within buckets of bounded size, so a group is a set of arrays (term
number, count), sorted by number.  One task per unordered pair of groups and bucket merges the two arrays by a
galloping intersection and prices the terms that both, one or none of them have, in both directions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .frames import python_text

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
# Kept terms per bucket, and the counted terms that a task holds before it hands them on.
BUCKET, HELD = 1 << 16, 400_000
# SCALE in two factors: count * _HIGH and a remainder * _LOW fit 64 bits up to 2.9e14 occurrences.
_HIGH, _LOW = 31_250, 32_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")
COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> list[bytes]:
    """Runs of characters that are A-Z, a-z or beyond ASCII, A-Z lower-cased, as UTF-8 bytes."""
    return _TERM.findall(text.encode().lower())  # bytes.lower() knows A-Z alone


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in held.items():
            names = list(n)
            # The empty term stands for the group itself.
            yield pd.DataFrame({"lang": lang, "source": source, "term": ["", *(t.decode() for t in names)],
                                "n": [0, *(n[t] for t in names)], "docs": [0, *(docs[t] for t in names)]})
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = terms(text), len(n)
            n.update(found)
            docs.update(set(found))
            size += len(n) - before
            if size >= HELD:
                yield from rows()
                size = 0
    yield from rows()


def term_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang, source, term, n, lang_n``: occurrences of the kept terms per group and language; the empty term stands for the group.

    Counts meet by (lang, term), so one shuffle serves the groups' sums and the language's.
    """
    part = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), python_text(docs).alias("text"))
    counted = (part.mapInPandas(_count, COUNTS).repartition("lang", "term")
               .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    return (counted.withColumn("lang_n", F.sum("n").over(term)).withColumn("in_docs", F.sum("docs").over(term))
            .filter((F.col("term") == "") | (F.col("in_docs") >= min_documents)).select("lang", "source", "term", "n", "lang_n"))


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total), in 64 bits."""
    high, over = count * _HIGH, F.lit(_LOW).cast("long")
    whole = F.call_function("div", high, total)
    return F.lit(1).cast("long") + whole * over + F.call_function("div", (high % total) * over, total)


def _price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def share(count: np.ndarray, total: int) -> np.ndarray:
    """As ``_share``, for arrays."""
    whole, rest = np.divmod(np.asarray(count, np.int64) * _HIGH, total)
    return 1 + whole * _LOW + rest * _LOW // total


def price(p: np.ndarray, q: np.ndarray) -> int:
    """The sum of floor((p - q)^2 / q): under 9.2e18 for up to 2e9 kept terms, as the shares sum to SCALE and one per term at most."""
    return int(((p - q) ** 2 // q).sum())


def gallop(short: np.ndarray, long: np.ndarray, stride: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``short`` and in ``long`` of the numbers that both have (each sorted, without repeats).

    ``stride`` numbers of the short array at a time: steps through the long one double until they pass the
    last of them, then all are looked up in the stretch passed.
    """
    mine, theirs, at = [], [], 0
    for start in range(0, len(short), stride):
        part = short[start:start + stride]
        step = stride
        while at + step < len(long) and long[at + step] < part[-1]:
            step *= 2
        stretch = long[at:at + step + 1]
        found = np.searchsorted(stretch, part)
        hit = np.flatnonzero(found < len(stretch))
        hit = hit[stretch[found[hit]] == part[hit]]
        mine.append(start + hit)
        theirs.append(at + found[hit])
        at += int(found[-1])
        if at >= len(long):
            break
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(mine or empty), np.concatenate(theirs or empty)


def merge_pair(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], a_total: int, b_total: int) -> tuple[int, int, int]:
    """Prices of a by b and of b by a over the terms (sorted numbers, counts) that either has, and how many these are."""
    (a_ids, a_n), (b_ids, b_n) = a, b
    if len(a_ids) <= len(b_ids):
        in_a, in_b = gallop(a_ids, b_ids)
    else:
        in_b, in_a = gallop(b_ids, a_ids)
    pa, pb = share(a_n + 1, a_total), share(b_n + 1, b_total)
    none_a, none_b = share(np.ones(1, np.int64), a_total), share(np.ones(1, np.int64), b_total)
    only_a, only_b = np.delete(pa, in_a), np.delete(pb, in_b)
    forth = price(pa[in_a], pb[in_b]) + price(only_a, none_b) + price(none_a, only_b)
    back = price(pb[in_b], pa[in_a]) + price(none_b, only_a) + price(only_b, none_a)
    return forth, back, len(a_ids) + len(b_ids) - len(in_a)


def _merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    def arrays(side: pd.DataFrame):
        if side.empty:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.asarray(side["ids"].iloc[0], np.int64), np.asarray(side["ns"].iloc[0], np.int64)

    row = (left if len(left) else right).iloc[0]
    forth, back, size = merge_pair(arrays(left), arrays(right), int(row["a_total"]), int(row["b_total"]))
    return pd.DataFrame({"lang": [row["lang"]], "a": [row["a"]], "b": [row["b"]], "forth": [forth], "back": [back], "n_terms": [size]})


def _arrays(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """``lang, source, bucket, ids, ns``: every group's counts, sorted by the number that a term has within its bucket."""
    names = kept.select("lang", "term").distinct().join(stats.select("lang", "v").distinct(), "lang")
    bucket = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / BUCKET)).cast("long")
    names = names.select("lang", "term", bucket.alias("bucket"))
    numbered = names.withColumn("id", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("term")))
    pairs = kept.select("lang", "term", "source", "n").join(numbered, ["lang", "term"])
    sorted_ = pairs.groupBy("lang", "source", "bucket").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("m"))
    return sorted_.select("lang", "source", "bucket", F.col("m.id").alias("ids"), F.col("m.n").alias("ns"))


def pair_divergence(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of a language's sources."""
    arrays = materialise(_arrays(kept, stats), "term-arrays")
    one, other = (stats.select("lang", F.col("source").alias(x), F.col("total").alias(f"{x}_total"), *extra)
                  for x, extra in (("a", ["v"]), ("b", [])))
    pairs = one.join(other, "lang").filter("a < b")
    tasks = pairs.filter("v > 0").drop("v")
    keys, rest = ["lang", "a", "b", "bucket"], ["a_total", "b_total", "ids", "ns"]
    # toDF names the columns anew, so that the two sides are not taken for one table.
    left, right = (arrays.withColumnRenamed("source", x).join(tasks, ["lang", x]).select(*keys, *rest).toDF(*keys, *rest) for x in "ab")
    merged = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_merge, "lang string, a string, b string, forth long, back long, n_terms long")
    priced = merged.groupBy("lang", "a", "b").agg(*(F.sum(c).alias(c) for c in ("forth", "back", "n_terms")))
    whole = pairs.join(priced, ["lang", "a", "b"], "left")
    one_each = F.lit(1).cast("long")
    p, q = _share(one_each, F.col("a_total")), _share(one_each, F.col("b_total"))
    absent = F.col("v") - F.coalesce("n_terms", F.lit(0))

    def value(side: str, x: Column, y: Column) -> Column:
        # A total is zero only where the language keeps no term.
        return F.when(F.col("v") > 0, F.coalesce(F.col(side), F.lit(0)) + absent * _price(x, y)).otherwise(0).cast("long")

    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), value("forth", p, q).alias("value")),
                   F.struct(F.col("b").alias("source"), F.col("a").alias("item"), value("back", q, p).alias("value")))
    return whole.select("lang", F.explode(both).alias("x")).select("lang", "x.*")


def term_divergence(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for the terms that a group has and uses more than its language does."""
    rows = kept.filter("n > 0").join(stats, ["lang", "source"])
    p, q = _share(F.col("n") + 1, F.col("total")), _share(F.col("lang_n") + 1, F.col("lang_total"))
    return (rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
            .select("lang", "source", "item", _price(F.col("p"), F.col("q")).alias("value")))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` prices every source by every other one, part ``term`` lists a group's terms.

    Null text, lang and source are read as ''.  Texts are read whole, of any length; rows count once each, whatever
    their ids say, so repeated rows count again; other columns are not read; an empty table gives no
    rows, and a group without terms is priced as one that has none of the kept terms.  Ties rank by
    item in UTF-8 order.  Arithmetic is in whole numbers, exact up to 2.9e14 occurrences a group.
    The pairs of a language's sources are the result; a group is never gathered whole, but by buckets of about BUCKET terms.
    """
    kept_and_groups = materialise(term_counts(docs, min_documents), "terms-kept")
    kept = kept_and_groups.filter("term <> ''")
    groups = kept_and_groups.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
    v = F.coalesce("v", F.lit(0))
    stats = materialise(groups.join(langs, "lang", "left").select(
        "lang", "source", v.alias("v"), (F.col("n") + v).alias("total"), (F.coalesce("lang_n", F.lit(0)) + v).alias("lang_total")), "term-groups")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))

    return ranked(pair_divergence(kept, stats), "pair").union(ranked(term_divergence(kept, stats), "term").filter(F.col("rank") <= top_terms))
