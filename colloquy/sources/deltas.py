"""Recorded reply streams as a data source: ``format("deltas")``, in batches and as a stream.

A file holds event-stream text: events end with a blank line, ``data:`` lines hold a completion chunk as
JSON or ``[DONE]``, ``id:`` names the request from there on (files without it: the file's name). Files may
grow at their end and new ones may come.

Rows: request, file, offset (of the event in its file, so (file, offset) is the order), delta, done. An
event whose chunk has no content has no row; ``[DONE]`` is a row without a delta. An event that has no
blank line after it is not complete: it is left for a later read. Data that are not JSON fail the read.

Files are cut into ranges of bytes; a range's events are those that begin in it, so what a task holds is a
range and the event at its end. A stream's offset is how many bytes of complete events have been read of
each file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "request string, file string, offset long, delta string, done boolean"
RANGE = 8 << 20
BLANK = re.compile(rb"\r?\n\r?\n")
#: Bytes that are looked at in a step when a border is sought.
STEP = 1 << 16


class Span(InputPartition):
    """Of a file the events that begin at or after ``begin`` and before ``end``, as far as ``size`` bytes are known."""

    def __init__(self, file: str, begin: int, end: int, size: int) -> None:
        self.file, self.begin, self.end, self.size = file, begin, end, size


class Event(NamedTuple):
    offset: int
    request: str | None
    data: str | None


def event_of(raw: bytes, offset: int) -> Event:
    """The fields of an event, by the rules of event streams: a space after the colon goes, a line that begins with one is a comment."""
    data, request = [], None
    for line in raw.decode("utf-8").splitlines():
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "data":
            data.append(value)
        elif name == "id":
            request = value
    return Event(offset, request, "\n".join(data) if data else None)


def delta_of(data: str) -> str | None:
    """The text of a completion chunk, if it has any."""
    choices = json.loads(data).get("choices") or [{}]
    return (choices[0].get("delta") or {}).get("content") or None


def border_after(source: pa.NativeFile, at: int, size: int) -> int:
    """Where the first event begins at or after a position (size: none does)."""
    if at == 0:
        return 0
    held, start = b"", max(0, at - 4)
    source.seek(start)
    while start + len(held) < size:
        held += source.read(min(STEP, size - start - len(held)))
        for found in BLANK.finditer(held):
            if start + found.end() >= at:
                return start + found.end()
    return size


def request_before(source: pa.NativeFile, at: int, otherwise: str) -> str:
    """The last request named before a position."""
    held = b""
    while at > 0:
        step = min(STEP, at)
        source.seek(at - step)
        held = source.read(step) + held[:256]  # of what was seen, a name that begins in the step before
        at -= step
        found = list(re.finditer(rb"(?:^|\n)id:[ ]?([^\r\n]*)[\r\n]", held if at == 0 else b"\0" + held))
        if found:
            return found[-1][1].decode("utf-8")
    return otherwise


def rows_of(span: Span, system: fs.FileSystem) -> Iterator[pa.RecordBatch]:
    name = span.file.rsplit("/", 1)[-1]
    with system.open_input_file(span.file) as source:
        begin, end = (border_after(source, x, span.size) if x < span.size else span.size for x in (span.begin, span.end))
        if begin >= end:
            return
        request = request_before(source, begin, name.rsplit(".", 1)[0])
        source.seek(begin)
        raw = source.read(end - begin)
    rows, at = [], 0
    for border in BLANK.finditer(raw):
        event = event_of(raw[at : border.start()], begin + at)
        at = border.end()
        request = event.request if event.request is not None else request
        if event.data is not None:
            done = event.data.strip() == "[DONE]"
            try:
                delta = None if done else delta_of(event.data)
            except (ValueError, AttributeError, TypeError) as broken:
                raise ValueError(f"{span.file}, byte {event.offset}: not a completion chunk") from broken
            if done or delta:
                rows.append((request, name, event.offset, delta, done))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["request", "file", "offset", "delta", "done"])


class Files:
    """The files of a folder, in whatever file system its address names."""

    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError("deltas: a path is needed")
        self.path, self.range = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def sizes(self) -> dict[str, int]:
        system, folder = self.system()
        found = system.get_file_info(fs.FileSelector(folder))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith((".", "_"))}

    def spans(self, begins: dict[str, int], ends: dict[str, int]) -> list[Span]:
        return [Span(f, a, min(a + self.range, end), end) for f, end in ends.items() for a in range(begins.get(f, 0), end, self.range)]

    def complete(self, since: dict[str, int]) -> dict[str, int]:
        """Up to where each file holds complete events."""
        system, _ = self.system()
        out = {}
        for file, size in self.sizes().items():
            begin, out[file] = since.get(file, 0), since.get(file, 0)
            with system.open_input_file(file) as source:
                at = size
                while at > begin:  # from the end, as the last border is near
                    low = max(begin, at - STEP)
                    source.seek(low)
                    found = list(BLANK.finditer(source.read(min(size, at + 4) - low)))
                    if found:
                        out[file] = low + found[-1].end()
                        break
                    at = low
        return out


class DeltaReader(DataSourceReader):
    def __init__(self, files: Files) -> None:
        self.files = files

    def partitions(self) -> list[Span]:
        return self.files.spans({}, self.files.sizes())

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return rows_of(partition, self.files.system()[0])


class DeltaStream(DataSourceStreamReader):
    def __init__(self, files: Files) -> None:
        self.files, self.known = files, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.known = self.files.complete(self.known)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.files.spans(start, {f: n for f, n in end.items() if n > start.get(f, 0)})

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return rows_of(partition, self.files.system()[0])


class DeltaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "deltas"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DeltaReader:
        return DeltaReader(Files(self.options))

    def streamReader(self, schema) -> DeltaStream:
        return DeltaStream(Files(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("deltas")`` and ``spark.readStream.format("deltas")`` known to a session."""
    spark.dataSource.register(DeltaSource)
