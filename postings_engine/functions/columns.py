"""Small column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str

# Characters Python's str.strip() removes: ASCII blanks and separators plus Unicode spaces.
WHITESPACE = "".join(
    chr(cp)
    for cp in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: ColumnLike) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(col(value), F.lit(WHITESPACE))


def first_filled(*values: ColumnLike) -> Column:
    """The first value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(col(v), F.lit("")) for v in values])


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values) -> Column:
    """A literal array<string>, also when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters read but must not compute again.

    A filter on a plain projected column is pushed below the projection together with the whole
    expression, which then runs once per reference; it cannot be pushed below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
