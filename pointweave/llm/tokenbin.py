"""Operator 10, token-id output: best-fit-decreasing packing with a segment tree over capacities.

Each task packs its own documents in windows of a bounded number of ids, so nothing is shuffled and memory
does not grow with the input. In a window pieces go longest first, each into the fullest sequence
that still has room: a segment tree over the room left (one leaf for each capacity, holding how many
sequences have just that room) finds the smallest sufficient room in log(capacity) steps. Documents
longer than a sequence are cut into full sequences and a rest, losslessly.

A packed sequence is one row: its padded id matrix row (little-endian unsigned 32-bit), the cumulative
segment lengths as attention kernels take them, and the position ids (unsigned 16-bit), which start
again at 0 with each segment. Rows go to Parquet, so lost tasks are repeated by Spark.

Defined results: null text is empty and its only id is the end id; repeated rows are packed once each; a null
doc_id is kept as null; an empty table writes no sequences; extra columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, materialise, slices, table, text_or_empty, vocabulary
from .tokens import word_ids

CAPACITY = 4096
END_ID = 2
WINDOW_IDS = 2_000_000
#: Rows of 24 KB each: how many leave a task at once, and how large the row groups are that readers hold.
BATCH_ROWS = 64
ROW_GROUP = {"parquet.block.size": str(16 << 20)}

SEGMENT = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())])
PACKED = (
    "sequence_id long, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "segments array<struct<doc_id:long,start:long,length:long,doc_tokens:long>>"
)


class RoomTree:
    """Counts of open sequences by room left, and the smallest room of at least so much."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.counts[at] += by
            at >>= 1

    def smallest(self, room: int) -> int:
        """-1 if no open sequence has that much room."""
        at, counts = room + self.size, self.counts
        if counts[at]:
            return room
        while at > 1 and (at & 1 or not counts[at + 1]):
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.size:
            at = 2 * at if counts[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces of each sequence."""
    tree, open_at, packs = RoomTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.smallest(lengths[i])
        if room < 0:
            pack, room = len(packs), capacity
            packs.append([])
        else:
            pack = open_at[room].pop()
            tree.add(room, -1)
        packs[pack].append(i)
        if left := room - lengths[i]:
            open_at.setdefault(left, []).append(pack)
            tree.add(left, 1)
    return packs


def packed_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = 0, window: int = WINDOW_IDS) -> DataFrame:
    if not 0 < capacity <= 65_536:
        raise ValueError("position ids are unsigned 16-bit numbers: capacity must be 1 to 65536")

    def rows_of(pieces: list[tuple], first: int) -> pa.RecordBatch:
        packs = best_fit_decreasing([p[2] for p in pieces], capacity)
        own = [pieces[i] for pack in packs for i in pack]
        docs_, starts, lengths, tokens = (np.array([p[k] for p in own], dtype=object if k == 0 else np.int64) for k in range(4))
        n, counts = len(packs), np.array([len(pack) for pack in packs])
        heads = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        filled = np.diff(ends[heads])
        # Pieces lie in their sequences' order, so the ids in a row fill the rows of the matrix from the left.
        matrix = np.full((n, capacity), pad_id, dtype="<u4")
        matrix[np.arange(capacity) < filled[:, None]] = np.frombuffer(b"".join([p[4] for p in own]), dtype="<u4")
        places = (np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)).astype("<u2")
        # Every sequence has one bound more than segments: a zero before the running ends of its segments.
        cuts = np.zeros(len(own) + n, dtype=np.int32)
        inner = np.arange(len(own)) + np.repeat(np.arange(n), counts) + 1
        cuts[inner] = ends[1:] - np.repeat(ends[heads[:-1]], counts)

        def binary(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])

        segments = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (docs_, starts, lengths, tokens)], fields=list(SEGMENT))
        columns = [
            pa.array(np.arange(first, first + n), pa.int64()),
            binary(np.arange(n + 1) * (4 * capacity), matrix),
            pa.ListArray.from_arrays(pa.array((heads + np.arange(n + 1)).astype(np.int32)), pa.array(cuts)),
            binary(2 * ends[heads], places),
            pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), segments),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["sequence_id", "input_ids", "cu_seqlens", "position_ids", "segments"])

    def run(batches):
        from pyspark import TaskContext

        ids_of, end = word_ids(path).encode, struct.pack("<I", end_id)
        sequence, held, pieces = TaskContext.get().partitionId() << 36, 0, []
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(field(part, "doc_id").to_pylist(), field(part, "text").to_pylist()):
                    ids = ids_of(text) + end
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        pieces.append((doc, at, min(capacity, n - at), n, ids[4 * at : 4 * (at + capacity)]))
                        held += pieces[-1][2]
                        if held >= window:
                            out = rows_of(pieces, sequence)
                            sequence, held, pieces = sequence + out.num_rows, 0, []
                            yield from slices(out, BATCH_ROWS)
        if pieces:
            yield from slices(rows_of(pieces, sequence), BATCH_ROWS)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, PACKED)


def segment_rows(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece, read back from written sequences; resets: its position ids count from 0."""
    ramp = F.lit(bytearray(np.arange(capacity, dtype="<u2").tobytes()))
    start, length = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1) - F.get("cu_seqlens", F.col("k"))
    pieces = packed.select("sequence_id", "input_ids", "position_ids", "cu_seqlens", F.posexplode("segments").alias("k", "s"))
    return pieces.select(
        "s.doc_id",
        "s.start",
        length.cast("long").alias("length"),
        F.crc32(F.substr("input_ids", start * 4 + 1, length * 4)).alias("ids_crc32"),
        "s.doc_tokens",
        "sequence_id",
        start.cast("long").alias("offset"),
        (F.substr("position_ids", start * 2 + 1, length * 2) == F.substr(ramp, F.lit(1), length * 2)).alias("resets"),
    )


def write_packed(docs: DataFrame, path: str, out: str, **options) -> None:
    """Writes the packed sequences as Parquet files."""
    packed_sequences(docs, path, **options).write.options(compression="zstd", **ROW_GROUP).parquet(out)


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = materialise(packed_sequences(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")), "packed", **ROW_GROUP)
    return segment_rows(packed)
