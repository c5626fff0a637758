"""Full-text search: an inverted table of terms and BM25 ranking.

The index is two plain tables, ``terms(job_id, term, field, tf, positions)`` and ``lengths(job_id, tokens)``;
searching filters the first by the query's few terms, and phrases and nearness are decided by the sorted positions of
a term in a field, so no text is read at search time.  :func:`write_index` stores both in buckets of ids, the terms of a
bucket in order, so that a search reads the row groups of its words alone; :func:`refresh_index` rewrites the buckets
of the documents that changed and leaves the others as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ColumnLike, bind, col
from ..session import materialise, ship_code
from .stemmer import porter_stem

# BM25 constants and the smallest inverse document frequency.
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6
# Fixed value: words that may stand between the first and the last of words that are near.
NEAR_DISTANCE = 10

# Fixed value: words whose stems a task remembers.
STEMS_KEPT = 1 << 17

FIELDS = ("title", "company", "description")


# Latin letters with marks, and the letters that are left without them.
_MARKED = {
    chr(cp): base for cp in range(0xC0, 0x250)
    if (base := unicodedata.normalize("NFD", chr(cp))[0]) != chr(cp) and chr(cp).islower()
}


def fold(text: ColumnLike) -> Column:
    """Lower-cased text with the accents of Latin letters removed."""
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    # A text of plain letters alone, one byte each, has no accents to look up.
    return bind(lowered, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(
        F.translate(t, "".join(_MARKED), "".join(_MARKED.values()))))


def _folded(word: str) -> str:
    return word.lower().translate(str.maketrans(_MARKED))


def tokenize(text: ColumnLike) -> Column:
    """Lower-cased runs of letters and digits, accents folded."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]++"), F.lit(0))


def _stemmed(words: ColumnLike) -> Column:
    """The stems of an array of words, in place; a task remembers the stems of the words it met last."""
    ship_code(porter_stem.__module__, __name__)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = lru_cache(maxsize=STEMS_KEPT)(porter_stem)
        for listed in batches:
            yield pd.Series([[known(w) for w in one] for one in listed], dtype=object)

    return F.pandas_udf(run, "array<string>")(col(words))


def _places_by_term(words: Column) -> Column:
    """Structs ``(term, positions)`` of an array of words: each word once, its places sorted, from 0."""
    def grouped(s: Column) -> Column:
        first = F.array_compact(F.transform(
            s, lambda x, i: F.when((i == 0) | (x["term"] != F.get(s, i - 1)["term"]), i)))
        return bind(first, lambda b: F.transform(b, lambda at, n: F.struct(
            F.get(s, at)["term"].alias("term"),
            F.transform(F.slice(s, at + 1, F.coalesce(F.get(b, n + 1), F.size(s)) - at), lambda x: x["p"]).alias("positions"))))

    return bind(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("p")))), grouped)


def _with_copies(docs: DataFrame, id_column: str) -> DataFrame:
    """``docs`` with ``job_id`` and ``_copies``: how many rows share the id, NULL if none does; only ids are counted."""
    docs = docs.withColumn("job_id", F.col(id_column))
    copies = docs.groupBy(F.col("job_id").alias("_id")).agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > 1)
    return docs.join(copies, F.col("job_id").eqNullSafe(F.col("_id")), "left").drop("_id")


def _listed(docs: DataFrame, fields: tuple[str, ...], stem: bool) -> DataFrame:
    """``(job_id, _copies, tokens, found)``: one row per document, all its ``(field, term, positions)`` and its number of tokens.

    A document's words are sorted and cut into runs where its text is read: no token is shuffled.
    """
    words = docs.select("job_id", "_copies", *[tokenize(f).alias(f"_words{n}") for n, f in enumerate(fields)])
    total = reduce(lambda a, b: a + b, [F.size(f"_words{n}") for n in range(len(fields))], F.lit(0))
    if stem:
        words = words.withColumns({f"_terms{n}": _stemmed(f"_words{n}") for n in range(len(fields))})

    def of_field(n: int, field: str) -> Column:
        return F.transform(_places_by_term(F.col(f"_terms{n}" if stem else f"_words{n}")), lambda x: F.struct(
            F.lit(field).alias("field"), x["term"].alias("term"), x["positions"].alias("positions")))

    found = [of_field(n, field) for n, field in enumerate(fields)]
    return words.select("job_id", "_copies", total.cast("bigint").alias("tokens"), F.concat(*found).alias("found"))


def _inverted(alone: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of :func:`build_positions` from :func:`_listed` documents: those whose ids are theirs alone, and the others, gathered by id."""
    def rows(listed: DataFrame) -> DataFrame:
        # A plain explode is given a filter on the list's size, which would list every document twice.
        return listed.select("job_id", F.explode_outer("found").alias("f")).filter("f IS NOT NULL").select("job_id", "f.*")

    shared = rows(copies).groupBy("job_id", "field", "term").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return rows(alone).unionByName(shared).select("job_id", "field", "term", F.size("positions").cast("bigint").alias("tf"), "positions")


def build_terms(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_column: str = "job_id", stem: bool = True
) -> DataFrame:
    """The inverted table, counted inside the documents.

    ``tf`` counts a term per document and field; :func:`build_positions` also says where.
    """
    return build_positions(docs, fields, id_column, stem).drop("positions")


def build_lengths(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_column: str = "job_id"
) -> DataFrame:
    """Tokens per document over all fields; no shuffle."""
    total = F.lit(0)
    for field in fields:
        total = total + F.size(tokenize(field))
    return docs.select(F.col(id_column).alias("job_id"), total.cast("bigint").alias("tokens"))


def build_positions(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_column: str = "job_id", stem: bool = True
) -> DataFrame:
    """The inverted table with places: :func:`build_terms`, and ``positions``, sorted, from 0, as many as ``tf``.

    A list holds the places of one term in one field of one document; documents that share an id count as one.
    """
    docs = _with_copies(docs, id_column)
    alone, copies = (docs.filter(test) for test in ("_copies IS NULL", "_copies IS NOT NULL"))
    return _inverted(_listed(alone, fields, stem), _listed(copies, fields, stem))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("job_id").cast("string")), F.lit(buckets)).cast("int").alias("bucket")


def _store(rows: DataFrame, path: str, order: list[str], mode: str) -> None:
    """Rows by bucket, in order; only the buckets among them are replaced."""
    dealt = rows.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
    dealt.write.partitionBy("bucket").mode(mode).option("partitionOverwriteMode", "dynamic").parquet(path)


def write_index(
    docs: DataFrame, root: str, fields: tuple[str, ...] = FIELDS, id_column: str = "job_id", stem: bool = True, buckets: int = 16
) -> None:
    """Store the index under ``root``, which holds none, in ``buckets`` buckets of ids."""
    terms, lengths = _index_rows(docs, fields, id_column, stem, buckets)
    _store(terms, f"{root}/terms", ["term", "job_id"], "error")
    _store(lengths, f"{root}/lengths", ["job_id"], "error")


def _index_rows(docs: DataFrame, fields: tuple[str, ...], id_column: str, stem: bool, buckets: int) -> tuple[DataFrame, DataFrame]:
    """``(terms, lengths)`` by bucket.  The listed documents are stored once: dealing rows by ranges reads them twice, and both tables come from them."""
    listed = materialise(_listed(_with_copies(docs, id_column), fields, stem), "index-documents")
    terms = _inverted(listed.filter("_copies IS NULL"), listed.filter("_copies IS NOT NULL"))
    return terms.select("*", _bucket(buckets)), listed.select("job_id", "tokens", _bucket(buckets))


def read_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The stored ``(terms, lengths)``."""
    return tuple(spark.read.parquet(f"{root}/{part}").drop("bucket").filter("job_id is not null") for part in ("terms", "lengths"))


def refresh_index(
    root: str, changed_docs: DataFrame, removed_ids: DataFrame, fields: tuple[str, ...] = FIELDS, id_column: str = "job_id",
    stem: bool = True, buckets: int = 16,
) -> None:
    """Bring the stored index up to date after some documents changed, came or disappeared; one writer at a time.

    Only the buckets of these documents are read and replaced (a dynamic partition overwrite); the texts of others
    are not read.  ``buckets``, ``fields`` and ``stem`` are those the index was written with.
    """
    spark = changed_docs.sparkSession
    changed = changed_docs.withColumn("job_id", F.col(id_column))
    terms, lengths = _index_rows(changed, fields, "job_id", stem, buckets)
    gone = materialise(removed_ids.select("job_id").union(changed.select("job_id")).distinct().select("job_id", _bucket(buckets)), "index-gone")
    touched = gone.select("bucket").distinct()
    # A row without id keeps a bucket that lost all its documents among those replaced.
    empty = touched.select("bucket")
    for part, order, fresh in (
        ("terms", ["term", "job_id"], terms),
        ("lengths", ["job_id"], lengths),
    ):
        old = spark.read.parquet(f"{root}/{part}")
        ids = [r["bucket"] for r in touched.collect()]  # numbers below ``buckets``
        kept = old.filter(F.col("bucket").isin(ids) & F.col("job_id").isNotNull()).join(gone.select("job_id"), "job_id", "left_anti")
        rows = kept.unionByName(fresh).unionByName(empty, allowMissingColumns=True)
        # The buckets are read before any is replaced.
        _store(materialise(rows, f"index-{part}"), f"{root}/{part}", order, "overwrite")


def refresh_terms(terms: DataFrame, changed_docs: DataFrame, removed_ids: DataFrame, **options) -> DataFrame:
    """The index after some documents changed or disappeared, without reading the others' texts."""
    gone = removed_ids.select("job_id").union(changed_docs.select("job_id")).distinct()
    return terms.join(gone, "job_id", "left_anti").unionByName(build_terms(changed_docs, **options))


def _query_terms(query: list[str], stem: bool) -> list[str]:
    words = [_folded(w) for w in query]
    return [porter_stem(w) for w in words] if stem else words


def _weigh(hits: DataFrame, lengths: DataFrame, wanted: int) -> DataFrame:
    """BM25 over ``hits(job_id, slot, tf)``: one slot per query part, all slots required."""
    facts = lengths.agg(
        F.struct(F.count(F.lit(1)).alias("docs"), F.avg("tokens").alias("average")).alias("facts")
    ).scalar()
    # Counting tf keeps both uses of the hits identical, so that they share one shuffle.
    frequency = hits.groupBy("slot").agg(F.count("tf").alias("df"))
    per_doc = hits.groupBy("job_id").agg(
        F.collect_list(F.struct("slot", "tf")).alias("parts"), F.count(F.lit(1)).alias("slots")
    ).filter(F.col("slots") == wanted)
    # At most one entry per query part: bounded by the length of the query.
    df_of = frequency.agg(F.map_from_entries(F.collect_list(F.struct("slot", "df"))).alias("m")).scalar()
    matched = per_doc.join(lengths, "job_id")

    def weight(part: Column) -> Column:
        df = F.element_at(F.col("_df"), part["slot"])
        idf = F.log((F.col("_facts.docs") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(MIN_IDF)).otherwise(idf)
        size = K1 * (1 - B + B * F.col("tokens") / F.col("_facts.average"))
        return idf * part["tf"] * (K1 + 1) / (part["tf"] + size)

    weighed = matched.withColumns({"_facts": facts, "_df": df_of})
    score = F.aggregate(
        F.array_sort("parts"), F.lit(0.0), lambda acc, part: acc + weight(part)
    )
    return weighed.select("job_id", score.alias("score"))


def matching_slots(terms: DataFrame, query: list[str], stem: bool = True, prefix: bool = False) -> DataFrame:
    """``(job_id, slot, tf)``: occurrences of each query word, fields added up.

    With ``prefix`` the last word matches every term it starts.  The word test is a plain filter
    on ``term``, so it reaches the scan of a stored index.
    """
    words = _query_terms(query, stem)
    tests = [F.col("term") == w for w in words]
    if prefix:
        tests[-1] = F.col("term").startswith(words[-1])
    slots = F.filter(
        F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(tests)]), lambda s: s.isNotNull()
    )
    hits = terms.filter(reduce(or_, tests)).select("job_id", "tf", F.explode(slots).alias("slot"))
    return hits.groupBy("job_id", "slot").agg(F.sum("tf").alias("tf"))


def search(
    docs: DataFrame, terms: DataFrame, lengths: DataFrame, query: list[str], k: int = 20,
    stem: bool = True, prefix: bool = False, field: str | None = None,
) -> DataFrame:
    """Top ``k`` documents holding every query word (in ``field``, if given), best first."""
    if field is not None:
        terms = terms.filter(F.col("field") == field)
    scored = _weigh(matching_slots(terms, query, stem, prefix), lengths, len(query))
    top = scored.orderBy(F.desc("score"), "job_id").limit(k)
    return docs.join(top, "job_id").orderBy(F.desc("score"), "job_id")


def _places(terms: DataFrame, words: list[str], field: str | None) -> DataFrame:
    """``(job_id, field, at)`` for the fields that hold all ``words``: a map from each to its positions."""
    wanted = sorted(set(words))
    found = terms.filter(F.col("term").isin(*wanted))
    if field is not None:
        found = found.filter(F.col("field") == field)
    # At most one list per word of the query.
    lists = found.groupBy("job_id", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    return lists.filter(F.size("at") == len(wanted))


def phrase_hits(terms: DataFrame, phrase: list[str], stem: bool = True, field: str | None = None) -> DataFrame:
    """``(job_id, slot, tf)``: times the words stand next to each other in one field, by their positions alone."""
    words = _query_terms(phrase, stem)

    def starts_by(offset: int) -> Column:
        return F.transform(F.element_at("at", F.lit(words[offset])), lambda p: p - offset)

    starts = reduce(F.array_intersect, map(starts_by, range(len(words))))
    counted = _places(terms, words, field).select("job_id", F.size(starts).cast("bigint").alias("n")).filter("n > 0")
    return counted.groupBy("job_id").agg(F.sum("n").alias("tf")).withColumn("slot", F.lit(0))


def near_hits(terms: DataFrame, words: list[str], distance: int = NEAR_DISTANCE, stem: bool = True, field: str | None = None) -> DataFrame:
    """``(job_id, slot, tf)``: places in one field from which all words follow with at most ``distance`` words between the first and the last.

    One pass over the merged positions, last to first, keeps where each word comes next; a place counts
    if it holds one of the words and the others all come soon enough.  A repeated word counts once.
    """
    wanted = sorted(set(_query_terms(words, stem)))

    def tagged(number: int) -> Column:
        return F.transform(F.element_at("at", F.lit(wanted[number])), lambda p: F.struct(p.alias("p"), F.lit(number).alias("word")))

    merged = F.reverse(F.array_sort(F.concat(*map(tagged, range(len(wanted))))))
    never = F.lit(None).cast("int")
    start = F.struct(F.array(*[never] * len(wanted)).alias("next"), F.lit(0).cast("bigint").alias("n"))

    def step(state: Column, here: Column) -> Column:
        following = F.transform(state["next"], lambda p, i: F.when(i == here["word"], here["p"]).otherwise(p))
        soon = F.forall(following, lambda p: F.coalesce(p - here["p"] - 1 <= distance, F.lit(False)))
        return F.struct(following.alias("next"), (state["n"] + F.when(soon, 1).otherwise(0)).alias("n"))

    counted = _places(terms, wanted, field).select("job_id", F.aggregate(merged, start, step, lambda s: s["n"]).alias("n")).filter("n > 0")
    return counted.groupBy("job_id").agg(F.sum("n").alias("tf")).withColumn("slot", F.lit(0))


def _top(docs: DataFrame, hits: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    top = _weigh(hits, lengths, 1).orderBy(F.desc("score"), "job_id").limit(k)
    return docs.join(top, "job_id").orderBy(F.desc("score"), "job_id")


def search_phrase(
    docs: DataFrame, lengths: DataFrame, phrase: list[str], k: int = 20,
    fields: tuple[str, ...] = FIELDS, stem: bool = True, terms: DataFrame | None = None, field: str | None = None,
) -> DataFrame:
    """Top ``k`` documents with the words next to each other in a field.

    With ``terms``, an index with positions, ``docs`` is read for the documents found alone; without, it is indexed first.
    """
    if terms is None:
        terms = build_positions(docs, fields, stem=stem)
    return _top(docs, phrase_hits(terms, phrase, stem, field), lengths, k)


def search_near(
    docs: DataFrame, terms: DataFrame, lengths: DataFrame, words: list[str], distance: int = NEAR_DISTANCE, k: int = 20,
    stem: bool = True, field: str | None = None,
) -> DataFrame:
    """Top ``k`` documents with all words near one another in a field."""
    return _top(docs, near_hits(terms, words, distance, stem, field), lengths, k)
