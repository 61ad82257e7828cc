"""Chunk streams: start code 00 00 01, a type byte A1 to A7, a payload with emulation prevention."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = b"\x00\x00\x01"
FIRST, LAST = 0xA1, 0xA7


def as_chunk(kind: Column, payload: Column) -> Column:
    """The bytes of one chunk from its type (a number) and payload."""
    return F.concat(F.unhex(F.lit("000001")), F.unhex(F.lpad(F.hex(kind.cast("long")), 2, "0")), payload)


def split_chunks(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    marks = []
    while (at := data.find(START, at)) >= 0:
        if at + 3 < len(data) and FIRST <= data[at + 3] <= LAST:
            marks.append(at)
            at += 4
        else:
            at += 1
    for a, b in zip(marks, [*marks[1:], len(data)]):
        out.append((data[a + 3], data[a + 4 : b]))
    return out


def unescape_payload(data: bytes) -> bytes:
    """After two or more zero bytes a byte 02 gives up two bits; the bits behind it move up."""
    escapes = np.array([m.end() - 1 for m in re.finditer(b"\x00{2,}\x02", data)], dtype=np.int64)
    if not len(escapes):
        return data
    kept = np.ones(8 * len(data), dtype=bool)
    kept[8 * escapes + 6] = kept[8 * escapes + 7] = False
    return np.packbits(np.unpackbits(np.frombuffer(data, np.uint8))[kept]).tobytes()


def scan_chunks(spark: SparkSession, path: str) -> DataFrame:
    """path, seq, type, payload of every chunk of the files."""

    def run(batches):
        for pdf in batches:
            rows = [(p, i, kind, load) for p, c in zip(pdf["path"], pdf["content"]) for i, (kind, load) in enumerate(split_chunks(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "seq", "type", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, seq int, type int, payload binary")
