"""A corpus pipeline of five stages, from documents to packed training windows.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and calls one operator of
``postings_engine.llm``; ``run`` writes each result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postings_engine.llm import decontam, langid, line_dedup, packing, simhash
from postings_engine.llm.frames import table
from postings_engine.session import materialise


# A language is recognised where it is likelier than all the others together; shorter texts cannot be told.
MIN_SCORE, MIN_CHARS = 0.5, 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows.

    Those without a letter go, and those of MIN_CHARS characters or more whose prediction has a score under MIN_SCORE.
    Where no language was learned (und), all documents with a letter stay.
    """
    found = langid.language(docs, langid.fit(docs)).alias("found")
    unknown = (F.col("found.lang_pred") != langid.UNDETERMINED) & (F.col("found.score") < MIN_SCORE) & (F.length("_row.text") >= MIN_CHARS)
    judged = docs.select(F.struct("*").alias("_row"), found)
    return judged.filter(F.col("found.lettered") & ~unknown).select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each line that ten of them share left in the first alone.

    n_chars is counted anew.  A document that loses lines and has no other text left repeats what others
    hold, and goes.
    """
    out = line_dedup.drop_repeated_lines(docs, keep_first=True)
    full = out.filter((F.col("n_dropped") == 0) | F.col("kept").rlike(r"[^ \t\n\x0B\f\r]"))
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text")),
           "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return full.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHashes (op3: 3-word shingles) differ in at most 3 bits: the one with the least doc_id.

    Most near copies in the wider sense (5-word similarity of 0.8 or more) differ in more bits and stay.
    Of rows that repeat this id one stays; rows without an id cannot be grouped and stay.
    """
    found = simhash.near_duplicates(docs)
    chosen = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_chosen")).distinct()
    named = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    first = (named.filter("_id is not null").join(chosen, F.col("_id") == F.col("_chosen"), "left_semi")
             .dropDuplicates(["_id"]).select("_row"))
    unnamed = named.filter("_id is null").select("_row")
    return first.union(unnamed).select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _keep(docs, F.size(decontam.hits(docs, table(spark, sf_dir, "benchmark"))) == 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into windows of 2048."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id), ("line_dedup", dedup_lines), ("simhash", dedup_near),
    ("decontamination", decontaminate), ("packing", pack),
]

# The classifier and the hashes of these stages have no counterpart in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def _keep(docs: DataFrame, condition) -> DataFrame:
    """The rows of ``docs`` where ``condition`` holds, with its columns alone, whatever their names."""
    return docs.select(F.struct("*").alias("_row"), condition.alias("_keep")).filter("_keep").select("_row.*")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
