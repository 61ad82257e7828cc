"""Operator 9, SimHash near-duplicates: covering locality-sensitive hashing.

Every bit position gets a random vector of radius+1 bits. Each non-zero vector v of that length makes a
table whose mask holds the positions with an odd inner product with v. Two fingerprints that
differ in at most ``radius`` positions give that many linear conditions on v, fewer than its length, so
some v fulfils them all: they agree on that mask and collide in that table. Nothing is missed.

Equal fingerprints are one row from the start. In a bucket no pairs are emitted: links are searched
breadth-first, a fingerprint against those not yet reached, and what leaves is at most one edge for
each fingerprint, a spanning forest of the bucket's links. A bucket over BLOCK fingerprints is dealt out
as blocks against blocks over many tasks. The forests' components come from rounds of
hooking each node to its smallest smaller neighbour, pointer jumping and contraction, all as joins of
written tables; a hot component is met only by partial aggregates and joins that AQE may split.

Defined results: null text is empty; no word gives fingerprint zero, which links like any other; repeated rows
give repeated results; an empty table gives no rows; extra columns are ignored; a null doc_id takes
no part as a component's name unless no other row has one.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Cut, field, materialise, slices, table

WORDS = 4
RADIUS = 4
BLOCK = 2048
SEED = 42


def bit_counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many hashes of each run set each of the 64 bits; runs are not empty."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, bounds, axis=0, dtype=np.int64)


def fingerprint_rows(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Signed 64-bit fingerprints of UTF-8 texts."""
    import xxhash

    digest, weights = xxhash.xxh64_intdigest, np.uint64(1) << np.arange(64, dtype=np.uint64)
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    owners: list[int] = []
    bounds: list[int] = []

    def settle() -> None:
        if owners:
            counts = bit_counts(np.array(hashes, dtype=np.uint64), np.array(bounds))
            sizes = np.diff([*bounds, len(hashes)])
            out[owners] = ((2 * counts > sizes[:, None]) * weights).sum(axis=1, dtype=np.uint64)
        hashes.clear(), owners.clear(), bounds.clear()

    for i, text in enumerate(texts):
        tokens = text.lower().split()  # on bytes: only A-Z, only ASCII white space
        if not tokens:
            continue
        if len(tokens) > 200_000:  # a very long text is summed by stretches
            counts, total = np.zeros(64, dtype=np.int64), len(tokens) - words + 1
            for at in range(0, total, 100_000):
                run = [digest(b" ".join(tokens[k : k + words]), seed=SEED) for k in range(at, min(total, at + 100_000))]
                counts += bit_counts(np.array(run, dtype=np.uint64), np.array([0]))[0]
            out[i] = ((2 * counts > total) * weights).sum(dtype=np.uint64)
            continue
        owners.append(i)
        bounds.append(len(hashes))
        if len(tokens) <= words:
            hashes.append(digest(b" ".join(tokens), seed=SEED))
        else:
            hashes += [digest(b" ".join(s), seed=SEED) for s in zip(*(tokens[k:] for k in range(words)))]
        if len(hashes) > 100_000:
            settle()
    settle()
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame, words: int = WORDS, name: str = "fp", keep: bool = False) -> DataFrame:
    """doc_id and the fingerprint (a signed long) of every row; keep: all columns of docs instead of doc_id."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1024):
                texts = [t or b"" for t in field(part, "text").cast(pa.binary()).to_pylist()]
                own = part.columns if keep else [field(part, "doc_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(fingerprint_rows(texts, words))], names=[*(part.schema.names if keep else ["doc_id"]), name])

    rows = docs if keep else docs.select(F.col("doc_id").cast("long"), "text")
    schema = StructType([*(rows.schema.fields if keep else rows.schema.fields[:1]), StructField(name, LongType())])
    return rows.mapInArrow(run, schema)


def covering_masks(radius: int = RADIUS, seed: int = 20) -> list[int]:
    """One 64-bit mask for each non-zero vector; every mask is made of whole classes of positions."""
    rng = random.Random(seed)
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(64)]
    rng.shuffle(vectors)
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among ``left``, or between ``left`` and ``right``."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    if right is None:
        rest = left
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                node = queue.pop()
                near = np.bitwise_count(rest ^ node) <= radius
                if near.any():
                    found = rest[near]
                    a.append(found)
                    b.append(np.full(len(found), node))
                    queue += list(found)
                    rest = rest[~near]
    else:
        sides = [left, right]
        while len(sides[0]) and len(sides[1]):
            queue, sides[0] = [(0, sides[0][0])], sides[0][1:]
            while queue:
                side, node = queue.pop()
                rest = sides[1 - side]
                near = np.bitwise_count(rest ^ node) <= radius
                if near.any():
                    found = rest[near]
                    a.append(found)
                    b.append(np.full(len(found), node))
                    queue += [(1 - side, x) for x in found]
                    sides[1 - side] = rest[~near]
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v), u > v, whose components are those of all pairs within the radius. fps: distinct fp."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"))
    large = Cut(sizes.where(F.col("n") > block).select("t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    # Small buckets meet as they are. Fingerprints of a large one go to every block pair of their own block.
    whole = keyed
    parts: list[DataFrame] = []
    if not large.df.isEmpty():
        whole = keyed.join(large.df.select("t", "key"), ["t", "key"], "left_anti")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        split = keyed.join(large.df, ["t", "key"]).withColumn("own", own)
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        pairs = split.withColumn("other", other).select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "fp")
        met = pairs.groupBy("t", "key", "i", "j")
        firsts, seconds = [F.collect_list(F.when(c, F.col("fp"))) for c in (~F.col("second"), F.col("second"))]
        parts.append(met.agg(firsts.alias("left"), seconds.alias("right"), F.first(F.col("i") == F.col("j")).alias("same")).select("left", "right", "same"))
    groups = whole.groupBy("t", "key").agg(F.collect_list("fp").alias("left")).where(F.size("left") > 1)
    parts.append(groups.select("left", F.array().cast("array<bigint>").alias("right"), F.lit(True).alias("same")))

    def run(batches):
        for batch in batches:
            us, vs = [], []
            lefts, rights, same = field(batch, "left"), field(batch, "right"), field(batch, "same").to_pylist()
            for i in range(batch.num_rows):
                left = lefts[i].values.to_numpy().view(np.uint64)
                right = None if same[i] else rights[i].values.to_numpy().view(np.uint64)
                u, v = forest(left, right, radius)
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    edges = [p.mapInArrow(run, "u long, v long") for p in parts]
    return reduce(DataFrame.unionByName, edges).distinct()


def _jump(hooks: Cut) -> DataFrame:
    """Every node with the end of its path; each round halves the paths."""
    while True:
        to = hooks.df.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = hooks.df.select("node", "root").join(to, "root", "left")
        after = Cut(jumped.select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumped")
        hooks.drop()
        hooks = after
        if after.df.where("moved").isEmpty():
            return after.df.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v) with u > v; the root is the smallest node reachable."""
    spark = edges.sparkSession
    steps: list[DataFrame] = []
    rest = Cut(edges, "edges")
    while not rest.df.isEmpty():
        hooks = _jump(Cut(rest.df.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "hooks"))
        steps.append(hooks)
        to_u = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        to_v = hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved_on = rest.df.join(to_u, "u").join(to_v, "v", "left").select("ru", F.coalesce("rv", "v").alias("rv")).where("ru <> rv")
        smaller = Cut(moved_on.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct(), "edges")
        rest.drop()
        rest = smaller
    rest.drop()
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    found = steps[-1]
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = step.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(found)
    return found


def named(rows: DataFrame, edges: DataFrame | None = None, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, root (the smallest fp of the component) and component_id of rows (doc_id, fp), written."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = materialise(components(links(distinct.select("fp"), radius) if edges is None else edges), "roots")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    smallest = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    names = materialise(rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"), "named")
    return rows.join(names, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, root (the smallest fingerprint of the component) and component_id of every row."""
    return named(materialise(with_fingerprints(docs, words), "fingerprints"), radius=radius)


def smallest_rows(docs: DataFrame, found: DataFrame, hashed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of every component of found the row of docs with the smallest doc_id; hashed adds the column __fp to docs.

    Rows that share a doc_id are told apart by fingerprint; repeats of such a row leave one.
    """
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = materialise(found.groupBy("doc_id", "root").agg(F.min("fp").alias("kept_fp"), F.count("*").alias("n")), "best")
    ids = best.groupBy(F.col("doc_id").alias("kept_id")).agg(F.sum("n").alias("n"))
    if ids.where("n > 1").isEmpty():
        return docs.join(best.select(F.col("doc_id").alias("kept_id")), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("__fp") == F.col("kept_fp"))
    one = hashed(docs).join(best.select(F.col("doc_id").alias("kept_id"), "kept_fp"), same, "left_semi")
    return one.dropDuplicates(["doc_id", "__fp"]).drop("__fp")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without near copies: of every component the row with the smallest doc_id stays."""
    return smallest_rows(docs, near_duplicates(docs, words, radius), lambda d: with_fingerprints(d, words, "__fp", keep=True))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
