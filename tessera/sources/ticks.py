"""Tick streams: gzip files of JSON lines, a header first, that a recorder may still be writing or have left cut off."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PIECE = 1 << 20
SCHEMA = "path string, s bigint, t double, line string"


def _lines(data: bytes) -> Iterator[bytes]:
    """The whole lines of a gzip file of any number of members, as far as it can be read."""
    rest, tail = memoryview(data), b""
    while len(rest):
        member, at = zlib.decompressobj(31), 0
        try:
            while at < len(rest) and not member.eof:
                tail += member.decompress(rest[at : at + PIECE])
                at += PIECE
                *whole, tail = tail.split(b"\n")
                yield from whole
        except zlib.error:
            break
        if not member.eof:
            break
        rest = rest[min(at, len(rest)) - len(member.unused_data) :]
    if tail:
        yield tail


def _ticks(data: bytes) -> Iterator[tuple[int, float, str]]:
    """The ticks of whole stretches. A stretch is whole once the next begins; the last one if all that the header names are there,
    or, where the header lists finished ones, exactly those. Nothing after the first broken line counts."""
    head, held, seen = None, [], set()
    try:
        for raw in _lines(data):
            row = json.loads(raw)
            if head is None:
                head = row
                done = set(head["sam_done"]) if "sam_done" in head else None
                continue
            if held and row["s"] != held[0][0]:
                yield from held
                held = []
            if done is None or row["s"] in done:
                seen.add(row["s"])
                held.append((row["s"], float(row["t"]), raw.decode()))
    except (ValueError, KeyError, TypeError):
        pass
    if held and (done is not None or len(seen) >= len(head.get("spans", []))):
        yield from held


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """(path, s, t, line): the ticks of whole stretches of all files under ``path``, their JSON as it stands.

    A file is one task's work, as gzip can't be entered in the middle; its lines stream through, a stretch at a time. A file
    without a readable header has no ticks. The files are read by Spark, wherever it reads from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows: list[tuple] = []
                for tick in _ticks(data.as_buffer().to_pybytes() if data.is_valid else b""):
                    rows.append((name, *tick))
                    if len(rows) == 8192:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "s", "t", "line"])
