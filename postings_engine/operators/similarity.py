"""Shingle similarity of two versions of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ColumnLike, bind, strip
from ..schema import SCORE_COLUMNS

SHINGLE_WORDS = 3
MINOR_CHANGE = 0.10


def shingles(text: ColumnLike, k: int = SHINGLE_WORDS) -> Column:
    """Distinct runs of ``k`` words; a shorter text is one shingle."""
    words = F.split(strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")), " ")

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
        return F.array_distinct(
            F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + (n - 1)) for n in range(k)]))
        )

    return bind(words, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two distinct lists: 1 for equal sets, 0 for disjoint ones."""
    def ratio(pair: Column) -> Column:
        common = F.size(F.array_intersect(pair["a"], pair["b"]))
        return common / (F.size(pair["a"]) + F.size(pair["b"]) - common)

    return bind(F.struct(a.alias("a"), b.alias("b")), ratio)


def text_similarity(old: ColumnLike, new: ColumnLike, k: int = SHINGLE_WORDS) -> Column:
    return jaccard(shingles(old, k), shingles(new, k))


def jd_similarity_skip(merged: DataFrame, previous: DataFrame, minor: float = MINOR_CHANGE) -> DataFrame:
    """Postings whose text changed, with ``similarity`` and ``keep_score``.

    A change of less than ``minor`` keeps the stored score; larger ones need scoring again.
    """
    old = previous.select("job_id", F.col("description").alias("_old"), *SCORE_COLUMNS)
    changed = merged.filter(F.col("action") == "updated_jd").select("job_id", "description")
    pairs = changed.join(old, "job_id").withColumn("similarity", text_similarity("_old", "description"))
    return pairs.withColumn("keep_score", F.col("similarity") > 1 - minor).drop("_old")
