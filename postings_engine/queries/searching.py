"""Full-text search over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as X
from ..session import scratch_path
from .registry import query

_FIELDS = ("title", "description")


def _docs(t):
    return t.documents.select(
        F.col("doc_id").alias("job_id"), F.concat(F.lit("Posting "), F.col("lang"), F.lit(" that "), F.col("source")).alias("title"),
        F.col("text").alias("description"))


_SQL_TOKENS = """d AS (SELECT doc_id AS job_id, concat('Posting ', lang, ' that ', source) AS title, text FROM documents),
    tokens AS (SELECT job_id, 'title' AS field, t, p FROM (SELECT job_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM (
            SELECT job_id, list_filter(regexp_split_to_array(strip_accents(lower(title)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM d))
        UNION ALL SELECT job_id, 'description', t, p FROM (SELECT job_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM (
            SELECT job_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM d))),
    lens AS (SELECT job_id, count(*) AS tokens FROM tokens GROUP BY 1),
    facts AS (SELECT count(*) AS n, avg(tokens) AS average FROM (SELECT d.job_id, coalesce(tokens, 0) AS tokens FROM d LEFT JOIN lens USING (job_id)))"""


def _sql_rank(hits: str, wanted: int) -> str:
    return f"""WITH {_SQL_TOKENS}, hits AS ({hits}),
    dfs AS (SELECT slot, count(*) AS df FROM hits GROUP BY 1),
    weighed AS (SELECT job_id, count(*) AS slots, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2
            / (tf + 1.2 * (0.25 + 0.75 * tokens / average))) AS score
        FROM hits JOIN dfs USING (slot) JOIN lens USING (job_id), facts GROUP BY job_id HAVING count(*) = {wanted})
    SELECT job_id, round(score, 6) AS score FROM weighed ORDER BY score DESC, job_id LIMIT 20"""


def _indexed(t, stem=False):
    """The documents, and their index as it is read from the shared folder."""
    docs, root = _docs(t), scratch_path(t.spark, "index")
    X.write_index(docs, root, _FIELDS, stem=stem)
    return docs, *X.read_index(t.spark, root)


@query("build_terms", sql=f"WITH {_SQL_TOKENS} SELECT t AS term, count(DISTINCT job_id) AS docs, count(*) AS tf FROM tokens GROUP BY 1")
def build_terms(t):
    per_doc = X.build_terms(_docs(t), _FIELDS, stem=False).groupBy("job_id", "term").agg(F.sum("tf").alias("tf"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("tf"))


@query("build_lengths", sql=f"WITH {_SQL_TOKENS} SELECT d.job_id, coalesce(tokens, 0) AS tokens FROM d LEFT JOIN lens USING (job_id)")
def build_lengths(t):
    return X.build_lengths(_docs(t), _FIELDS)


@query("bm25_search", sql=_sql_rank("SELECT job_id, t AS slot, count(*) AS tf FROM tokens WHERE t IN ('that', 'thble') GROUP BY 1, 2", 2))
def bm25_search(t):
    docs, terms, lengths = _indexed(t)
    return X.search(docs, terms, lengths, ["That", "thble"], stem=False).select("job_id", F.round("score", 6).alias("score"))


@query("bm25_prefix", sql=_sql_rank("""SELECT job_id, CASE WHEN t = 'the' THEN 0 ELSE 1 END AS slot, count(*) AS tf FROM tokens
    WHERE t = 'the' OR starts_with(t, 'onwh') GROUP BY 1, 2""", 2))
def bm25_prefix(t):
    docs, terms, lengths = _indexed(t)
    return X.search(docs, terms, lengths, ["the", "onwh"], stem=False, prefix=True).select("job_id", F.round("score", 6).alias("score"))


@query("bm25_field", sql=_sql_rank("SELECT job_id, t AS slot, count(*) AS tf FROM tokens WHERE t = 'src7' AND field = 'title' GROUP BY 1, 2", 1))
def bm25_field(t):
    docs, terms, lengths = _indexed(t)
    return X.search(docs, terms, lengths, ["SRC7"], stem=False, field="title").select("job_id", F.round("score", 6).alias("score"))


@query("bm25_phrase", sql=_sql_rank("""SELECT a.job_id, 0 AS slot, count(*) AS tf FROM tokens a JOIN tokens b
    ON a.job_id = b.job_id AND a.field = b.field AND b.p = a.p + 1 WHERE a.t = 'of' AND b.t = 'the' GROUP BY 1""", 1))
def bm25_phrase(t):
    docs, terms, lengths = _indexed(t)
    return X.search_phrase(docs, lengths, ["of", "the"], stem=False, terms=terms).select("job_id", F.round("score", 6).alias("score"))


_NEAR = ("of", "the", "and")


@query("bm25_near", sql=_sql_rank(f"""SELECT a.job_id, 0 AS slot, count(*) AS tf FROM tokens a WHERE a.t IN {_NEAR}
    {' '.join(f"AND EXISTS (SELECT 1 FROM tokens b WHERE b.job_id = a.job_id AND b.field = a.field AND b.t = '{w}' AND b.p BETWEEN a.p AND a.p + 6)" for w in _NEAR)}
    GROUP BY 1""", 1))
def bm25_near(t):
    """All three words with at most five words between the first and the last."""
    docs, terms, lengths = _indexed(t)
    return X.search_near(docs, terms, lengths, list(_NEAR), distance=5, stem=False).select("job_id", F.round("score", 6).alias("score"))


# SQL cannot stem, but the words that share the stems of this query can be listed.
@query("bm25_search_porter", sql=_sql_rank("""SELECT job_id, CASE WHEN t LIKE 'that%' THEN 0 ELSE 1 END AS slot, count(*) AS tf FROM tokens
    WHERE t IN ('that', 'thats', 'thated', 'thating', 'tion', 'tions', 'tione', 'tiones', 'tioned', 'tioning') GROUP BY 1, 2""", 2))
def bm25_search_porter(t):
    docs, terms, lengths = _indexed(t, stem=True)
    return X.search(docs, terms, lengths, ["that", "tions"], stem=True).select("job_id", F.round("score", 6).alias("score"))


@query("refresh_terms", sql=f"""WITH {_SQL_TOKENS}
    SELECT t AS term, count(*) AS tf FROM tokens WHERE job_id % 10 <> 4 GROUP BY 1""")
def refresh_terms(t):
    docs = _docs(t)
    stale = docs.withColumn("description", F.when(F.col("job_id") % 10 == 3, F.lit("old words")).otherwise(F.col("description")))
    terms = X.build_terms(stale, _FIELDS, stem=False)
    changed, removed = docs.filter(F.col("job_id") % 10 == 3), docs.filter(F.col("job_id") % 10 == 4)
    fresh = X.refresh_terms(terms, changed, removed, fields=_FIELDS, stem=False)
    return fresh.groupBy("term").agg(F.sum("tf").alias("tf"))


@query("refresh_index", sql=f"""WITH {_SQL_TOKENS},
    kept AS (SELECT job_id, field, count(DISTINCT t) AS terms, count(*) AS tf, sum(p) AS places FROM tokens WHERE job_id % 10 <> 4 GROUP BY 1, 2)
    SELECT k.job_id, k.field, k.terms, k.tf, CAST(k.places AS BIGINT) AS places, l.tokens FROM kept k JOIN lens l USING (job_id)""")
def refresh_index(t):
    """The stored index, document by document, after a tenth of them changed, a tenth disappeared and a tenth came."""
    docs, root = _docs(t), scratch_path(t.spark, "index")
    digit = F.col("job_id") % 10
    stale = docs.filter(digit != 5).withColumn("description", F.when(digit == 3, F.lit("old words")).otherwise(F.col("description")))
    X.write_index(stale, root, _FIELDS, stem=False)
    X.refresh_index(root, docs.filter(digit.isin(3, 5)), docs.filter(digit == 4), _FIELDS, stem=False)
    terms, lengths = X.read_index(t.spark, root)
    found = terms.groupBy("job_id", "field").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tf"), F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, p: a + p + 1)).alias("places"))
    return found.join(lengths, "job_id").select("job_id", "field", "terms", "tf", "places", "tokens")
