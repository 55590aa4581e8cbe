"""A write-ahead log of framed binary records, for interchange: each frame is a payload with its
CRC-32C, written as half-byte symbols between frame marks, so a torn frame can't be mistaken for a
whole one. Segments are read in parallel, a task each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import crc32c_bytes

#: Fixed values of the frame format.
BEGIN, END = 0xFA, 0xFB


def frame(payload: bytes) -> bytes:
    body = crc32c_bytes(payload).to_bytes(4, "little") + payload
    return bytes([BEGIN, *(s for b in body for s in (b >> 4, b & 15)), END])


def frames(data: bytes) -> Iterator[tuple[int, bytes | None, bool]]:
    """(offset, payload, terminated) of each frame; payload is null if the frame is corrupt."""
    at = 0
    while at < len(data):
        end = data.find(bytes([END]), at)
        part = data[at + 1 : end if end >= 0 else len(data)]
        good = data[at] == BEGIN and len(part) % 2 == 0 and all(s < 16 for s in part)
        body = bytes(a << 4 | b for a, b in zip(part[::2], part[1::2])) if good else b""
        good = good and end >= 0 and len(body) >= 4 and crc32c_bytes(body[4:]) == int.from_bytes(body[:4], "little")
        yield at, body[4:] if good else None, end >= 0
        if end < 0:
            return
        at = end + 1


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """segment, ord, offset, payload, terminated of every frame of segment-<n>.wal files."""
    files = spark.read.format("binaryFile").load(f"{path}/segment-*.wal")
    return _frames(files.select(F.regexp_extract("path", r"segment-(\d+)\.wal$", 1).alias("segment"), "content"))


def _frames(segments: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(int(s), i, *f) for s, data in zip(pdf["segment"], pdf["content"]) for i, f in enumerate(frames(bytes(data)))]
            yield pd.DataFrame(rows, columns=["segment", "ord", "offset", "payload", "terminated"])

    return segments.mapInPandas(run, "segment int, ord long, offset long, payload binary, terminated boolean")


def append_segments(rows: DataFrame, path: str) -> None:
    """Append records to a framed log: a segment is one binary value of its frames in order, written
    with its number. rows: segment, ord, payload; a segment is bounded by the log's rotation. The
    write is one commit: it appears whole or not at all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(frame(bytes(p)) for p in pdf.sort_values("ord")["payload"])
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "content": [data]})

    rows.groupBy("segment").applyInPandas(run, "segment long, content binary").write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """segment, ord, offset, payload, terminated of every frame that append_segments wrote."""
    return _frames(spark.read.schema("segment long, content binary").parquet(path))
