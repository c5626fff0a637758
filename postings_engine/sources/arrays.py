"""JSON arrays in large files, read by byte ranges cut at element boundaries.

A range cannot tell by itself whether it begins inside a string or how deep it is nested.  So ranges are read twice:
once for what each does to that state, whatever it is, and once for the elements, with the state known from a running
sum over the few numbers per range.  The texts themselves are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_code

# Bytes of a range, which is a task's work.
RANGE = 1 << 27
# Bytes handled at a time within a range, and bytes of elements per batch handed on.
CHUNK = 1 << 20
BATCH = 1 << 22

_SUMMARY = "path string, start long, stop long, quotes long, closed_depth long, open_depth long, head string"
_PACKED = (".gz", ".bz2", ".zst", ".lz4")
_BLANK = b" \t\r\n"


@dataclass
class Marks:
    """What a stretch of bytes holds: quotes up to each byte, brackets, and whether its end escapes the next byte."""

    raw: np.ndarray
    quotes: np.ndarray
    step: np.ndarray
    escaped: bool


def marks(data: bytes, escaped: bool) -> Marks:
    """Quotes that open or close a string counted up to each byte, and +1 or -1 at brackets; ``escaped`` says
    whether the first byte follows an unpaired backslash, and in the result whether the byte after the last does."""
    raw = np.frombuffer(data, np.uint8)
    place = np.arange(len(raw), dtype=np.int32)
    slash = raw == 92
    # The last byte before each that is no backslash; the run since then escapes the byte if its length is odd.
    plain = np.maximum.accumulate(np.where(slash, -1, place))
    run = place - plain + ((plain < 0) & escaped)
    before = np.concatenate([[int(escaped)], run[:-1]])
    quote = (raw == 34) & (before % 2 == 0)
    step = ((raw == 123) | (raw == 91)).astype(np.int32) - ((raw == 125) | (raw == 93))
    return Marks(raw, np.cumsum(quote, dtype=np.int32), step, bool(run[-1] % 2))


class Source:
    """One file's bytes, from the local file system or one that Arrow knows; packed files are unpacked as a stream."""

    def __init__(self, path: str):
        local = re.sub(r"^file:/+", "/", path)
        if "://" in local:
            scheme, rest = local.split("://", 1)
            host, _, name = rest.partition("/")
            files, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
            local = f"{base.rstrip('/')}/{name}"
        else:
            files = fs.LocalFileSystem()
        packed = path.endswith(_PACKED)
        self.file = files.open_input_stream(local) if packed else files.open_input_file(local)
        self.seekable = not packed

    def chunks(self, start: int, stop: int | None = None) -> Iterator[bytes]:
        """The bytes from ``start`` up to ``stop`` or the end, CHUNK at a time; a byte order mark reads as blanks."""
        if self.seekable:
            self.file.seek(start)
        at = start
        while stop is None or at < stop:
            data = self.file.read(CHUNK if stop is None else min(CHUNK, stop - at))
            if not data:
                return
            if at == 0 and data.startswith(b"\xef\xbb\xbf"):
                data = b"   " + data[3:]
            yield data
            at += len(data)

    def escaped(self, start: int) -> bool:
        """Whether the byte at ``start`` follows an odd run of backslashes."""
        run, at = 0, start
        while at > 0:
            low = max(0, at - 1024)
            self.file.seek(low)
            part = self.file.read(at - low)
            tail = len(part) - len(part.rstrip(b"\\"))
            run += tail
            if tail < len(part):
                break
            at = low
        return run % 2 == 1


def summarise(path: str, start: int, stop: int | None) -> tuple[int, int, int, str | None]:
    """Quotes in a range, its change of depth if it begins outside or inside a string, and its first filled byte."""
    source, quotes, outside, inside, head = Source(path), 0, 0, 0, None
    escaped = source.escaped(start) if start else False
    for data in source.chunks(start, stop):
        found = marks(data, escaped)
        escaped = found.escaped
        odd = (found.quotes + quotes) % 2
        outside += int(found.step[odd == 0].sum())
        inside += int(found.step[odd == 1].sum())
        quotes += int(found.quotes[-1])
        if head is None and data.strip(_BLANK):
            head = data.lstrip(_BLANK)[:1].decode("latin-1")
    return quotes, outside, inside, head


def elements(path: str, start: int, stop: int | None, quotes: int, depth: int) -> Iterator[bytes]:
    """The elements that begin in a range which has ``quotes`` quotes and ``depth`` open brackets before it.

    An element begins after the array's bracket or a comma directly in it, and ends before the next such place; the
    range that holds the place before an element reads it to its end, past its own.
    """
    source, at, open_parts = Source(path), start, None
    escaped = source.escaped(start) if start else False
    for data in source.chunks(start):
        found = marks(data, escaped)
        escaped = found.escaped
        out = (found.quotes + quotes) % 2 == 0
        after = depth + np.cumsum(np.where(out, found.step, 0))
        raw = found.raw
        cut = out & (((raw == 91) | (raw == 44)) & (after == 1) | (raw == 93) & (after == 0))
        begin = 0
        for place in np.flatnonzero(cut).tolist():
            if open_parts is not None:
                yield b"".join([*open_parts, data[begin:place]])
            if stop is not None and at + place >= stop:
                return
            open_parts, begin = [], place + 1
        if open_parts is not None:
            open_parts.append(data[begin:])
        at, quotes, depth = at + len(data), quotes + int(found.quotes[-1]), int(after[-1])
        if open_parts is None and stop is not None and at >= stop:
            return
    if open_parts is not None:
        yield b"".join(open_parts)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            quotes, outside, inside, head = summarise(r["path"], r["start"], r["stop"])
            yield pa.RecordBatch.from_pylist(
                [{**r, "quotes": quotes, "closed_depth": outside, "open_depth": inside, "head": head}],
                pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("quotes", pa.int64()),
                           ("closed_depth", pa.int64()), ("open_depth", pa.int64()), ("head", pa.string())]))


def _records(r: dict) -> Iterator[bytes]:
    if r["array"]:
        yield from elements(r["path"], r["start"], r["stop"], r["quotes"], r["depth"])
    elif r["start"] == 0:  # no array: the file is one record
        yield b"".join(Source(r["path"]).chunks(0))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ready, size = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            for record in _records(r):
                text = record.strip(_BLANK)
                if text:
                    ready.append(text.decode("utf-8", "replace"))
                    size += len(text)
                if size >= BATCH:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(ready, pa.string())})
                    ready, size = [], 0
    if ready:
        yield pa.RecordBatch.from_pydict({"value": pa.array(ready, pa.string())})


def byte_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """``path, start, stop`` of every file under ``path``, from the listing alone; a packed file is one open range."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    packed = F.lower("path").rlike("|".join(rf"\{e}$" for e in _PACKED))
    starts = F.when(packed, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    return files.select("path", F.explode(starts).alias("start"), packed.alias("_packed")).select(
        "path", "start", F.when(~F.col("_packed"), F.col("start") + range_bytes).alias("stop"))


def read_array_records(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """``value``: one JSON text per element of the arrays in the files under ``path``; a file that is no array is one text.

    Each range of ``range_bytes`` is a task of its own; their number is counted from the listing.  Arrays that follow one another in a file are read as one; blank files and blank elements give nothing.  A file cut off gives the elements before
    the cut and what is left of the last one, which then fails to parse.  Elements come in no order.  Packed files
    (.gz, .bz2, .zst, .lz4) are read by one task each.
    """
    ship_code(__name__)
    ranges = byte_ranges(spark, path, range_bytes)
    tasks = max(1, ranges.count())
    states = ranges.repartition(tasks).mapInArrow(_summaries, _SUMMARY)
    file = Window.partitionBy("path")
    earlier = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))
    states = states.withColumn("change", F.when(F.col("before") % 2 == 0, F.col("closed_depth")).otherwise(F.col("open_depth")))
    known = states.select(
        "path", "start", "stop", (F.col("before") % 2).alias("quotes"),
        F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth"),
        (F.min_by("head", F.when(F.col("head").isNotNull(), F.col("start"))).over(file) == "[").alias("array"))
    return known.repartition(tasks).mapInArrow(_values, "value string")
