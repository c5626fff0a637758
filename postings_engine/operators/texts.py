"""Long texts kept once, apart from the records that name them.

A merge, a filter and a batch only copy descriptions.  Records whose ``description`` holds a text's name, a digest of
it, go through them as narrow rows, and the texts join where one is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ColumnLike, col


def text_name(text: ColumnLike) -> Column:
    """The name of a text; NULL for none.  Equal names are equal texts."""
    return F.sha2(col(text), 256)


def named_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``(_name, _text)``: every text of ``rows`` once."""
    return rows.filter(F.col(text).isNotNull()).groupBy(text_name(text).alias("_name")).agg(F.first(text).alias("_text"))


def with_texts(rows: DataFrame, texts: DataFrame | None, column: str = "description") -> DataFrame:
    """``rows`` with the texts that ``column`` names; without ``texts`` it holds them already."""
    if texts is None:
        return rows
    found = rows.withColumnRenamed(column, "_name").join(texts, "_name", "left").withColumnRenamed("_text", column)
    return found.select(*rows.columns)
