"""Operator 1, packing: shortest-pack-first over the histogram of lengths.

Documents become token counts; a document longer than a sequence is cut into full sequences and a
rest. Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. There
lengths are placed longest first, each into the packs with the most room left; what is kept is
not packs but patterns with counts, as runs of sequence ids. Each placement is a run of ranks among
the pieces of one length, and pieces join their slots by (length, rank).

Hot lengths: pieces are ranked inside (length, bucket) with as many buckets as there are tasks, and
the buckets' first ranks come from their counts; no task sees all pieces of a length. Slots are
made by exploding runs, so neither side of the join is broadcast, and its keys are unique.

Defined results: null text is empty, its only id is the end id; repeated rows are packed once
each; a null doc_id is kept as null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import field, materialise, partitions, slices, table, text_or_empty, vocabulary
from .tokens import word_ids

CAPACITY = 4096
END_ID = 2
#: Ranks that one row of the run table may stand for before it is exploded.
RUN_ROWS = 65_536

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenises whole texts; one row for each piece of at most ``capacity`` ids."""

    def run(batches):
        ids_of = word_ids(path).encode
        end = struct.pack("<I", end_id)
        for batch in batches:
            out: list[list[int | None]] = [[], [], [], [], []]
            for part in slices(batch):
                for doc, text in zip(field(part, "doc_id").to_pylist(), field(part, "text").to_pylist()):
                    ids = ids_of(text) + end
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        size = min(capacity, n - at)
                        crc = zlib.crc32(ids[4 * at : 4 * (at + size)])
                        for column, value in zip(out, (doc, at, size, crc, n)):
                            column.append(value)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def place_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece.

    A heap entry (-room, first sequence, count) is a pattern: ``count`` sequences with the same
    lengths so far. The roomiest, that is shortest, pack comes first; a run that needs fewer packs
    than the pattern counts splits it.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    heap: list[tuple[int, int, int]] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left > 0:
            if heap and -heap[0][0] >= length:
                room, first, count = heapq.heappop(heap)
                room, used = -room, min(left, count)
                if used < count:
                    heapq.heappush(heap, (-room, first + used, count - used))
            else:
                room, first, used = capacity, sequences, left
                sequences += left
            runs.append((length, rank, used, first, capacity - room))
            if room > length:
                heapq.heappush(heap, (length - room, first, used))
            left -= used
            rank += used
    return runs


def _run_table(spark: SparkSession, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    short = [(n, rank + k, min(RUN_ROWS, count - k), first + k, offset) for n, rank, count, first, offset in runs for k in range(0, count, RUN_ROWS)]
    names = ["length", "rank0", "count", "sequence0", "offset"]
    columns = list(zip(*short)) or [()] * 5
    return spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in zip(names, columns)}))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (doc_id, start, length, ...)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = _run_table(spark, place_lengths(counts, capacity))
    wide = max(1, partitions(spark))
    slots = (
        runs.repartition(wide, "length", "rank0")
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
        .select("length", (F.col("rank0") + F.col("k")).alias("rank"), (F.col("sequence0") + F.col("k")).alias("sequence_id"), "offset")
    )
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(2 * wide)).cast("int"))
    before = (
        dealt.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    )
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .drop("bucket", "before", "inside")
    )
    return ranked.join(slots, ["length", "rank"]).drop("rank")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    pieces = materialise(pieces_of(docs, path, capacity, end_id), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pack(pieces, capacity).select(*columns)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
