"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """A narrow table written to the shared folder and read back, in no more files than the cluster has cores.

    The tasks that made it may be many more than such a table is worth files.
    """
    return materialise(df.hint("rebalance").coalesce(df.sparkSession.sparkContext.defaultParallelism), label)


def whole_text(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def python_text(docs: DataFrame) -> Column:
    """The whole text as an argument of a Python function.

    Texts can be long: Arrow batches of the session become a few hundred rows, and a few megabytes where
    Spark bounds them by size, instead of 10,000 rows of any length.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return whole_text()


def text_key(name: str = "text") -> Column:
    """A 128-bit key of a text: rows with equal texts share every decision that depends on text alone.

    Joining on it needs neither unique nor filled ids.
    """
    return F.unhex(F.md5(whole_text(name)))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True for the fold that a classifier must not learn from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def per_worker(name: str, make):
    """``make()``, called once per Python worker.

    Functions that travel with a task get new globals each time; the worker's modules stay.
    """
    store = sys.modules.setdefault("_llm_per_worker", types.ModuleType("_llm_per_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)
