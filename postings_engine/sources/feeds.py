"""The extension point for feeds: anything that reads landed data and maps it to common columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from . import shapes as H
from .landing import good_records, read_landed, union_sources


class Feed(Protocol):
    """A source of postings."""

    name: str

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """Raw postings, one row each, from landed data under ``path``."""

    def to_common(self, raw: DataFrame) -> DataFrame:
        """Raw postings in the columns of :data:`postings_engine.sources.shapes.COMMON`."""


@dataclass(frozen=True)
class PagedApi:
    name: str = H.SOURCE_NAMES["paged_api"]
    results_per_query: int | None = None

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return H.paged_items(good_records(read_landed(spark, path, H.PAGED_API)), self.results_per_query)

    def to_common(self, raw: DataFrame) -> DataFrame:
        return H.map_paged_api(raw, self.name)


@dataclass(frozen=True)
class ListDetail:
    """List pages under ``path/list`` and per-id details under ``path/detail``."""

    name: str = H.SOURCE_NAMES["list_detail"]
    results_per_query: int | None = None

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        pages = good_records(read_landed(spark, f"{path}/list", H.LIST_PAGE))
        details = good_records(read_landed(spark, f"{path}/detail", H.DETAIL))
        return H.list_items(pages, details, self.results_per_query)

    def to_common(self, raw: DataFrame) -> DataFrame:
        return H.map_list_detail(raw, self.name)


@dataclass(frozen=True)
class Board:
    companies: DataFrame
    name: str = H.SOURCE_NAMES["board"]

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return H.board_items(good_records(read_landed(spark, path, H.BOARD)), self.companies)

    def to_common(self, raw: DataFrame) -> DataFrame:
        return H.map_board(raw, self.name)


@dataclass(frozen=True)
class Postings:
    companies: DataFrame
    name: str = H.SOURCE_NAMES["postings"]

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        landed = read_landed(spark, path, H.POSTINGS, multi_line=True)
        return H.postings_items(good_records(landed), self.companies)

    def to_common(self, raw: DataFrame) -> DataFrame:
        return H.map_postings(raw, self.name)


@dataclass(frozen=True)
class Tenant:
    name: str = H.SOURCE_NAMES["tenant"]
    cap: int | None = None

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return H.tenant_items(good_records(read_landed(spark, path, H.TENANT)), self.cap)

    def to_common(self, raw: DataFrame) -> DataFrame:
        return H.map_tenant(raw, self.name)


@dataclass(frozen=True)
class Widget:
    companies: DataFrame
    name: str = H.SOURCE_NAMES["widget"]

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return H.widget_items(good_records(read_landed(spark, path, H.WIDGET)), self.companies)

    def to_common(self, raw: DataFrame) -> DataFrame:
        return H.map_widget(raw, self.name)


@dataclass(frozen=True)
class Frame:
    """Tabular postings stored as Parquet."""

    name: str = H.SOURCE_NAMES["frame"]

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return H.frame_items(spark.read.parquet(path))

    def to_common(self, raw: DataFrame) -> DataFrame:
        return H.map_frame(raw, self.name)


@dataclass(frozen=True)
class Gathered:
    postings: DataFrame | None
    ok: list[str]
    failed: dict[str, str]


def gather(spark: SparkSession, feeds: Iterable[tuple[Feed, str]]) -> Gathered:
    """All feeds appended; one whose data is missing or misshapen does not stop the others.

    Single bad records are kept apart when a feed is read, so only a feed's absence or a wrong
    layout counts as failure here.
    """
    mapped, ok, failed = [], [], {}
    for feed, path in feeds:
        try:
            mapped.append(feed.to_common(feed.read(spark, path)))
            ok.append(feed.name)
        except AnalysisException as error:
            failed[feed.name] = str(error).splitlines()[0]
    return Gathered(union_sources(mapped) if mapped else None, ok, failed)
