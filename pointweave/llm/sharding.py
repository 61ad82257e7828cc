"""Operator 2, sharding: rendezvous hashing of stable record keys over weighted shards. Native.

Every shard draws a number for every key and the largest draw, scaled by the shard's weight, wins. A
shard's draws don't depend on the others, so one more shard takes rows only into itself. The mixing
function is 32-bit integer arithmetic that any SQL engine repeats exactly.

Slots number the rows of each shard without gaps. Rows are ranked inside (shard, bucket); the
buckets' first slots come from their counts, for which only the key column is read again. That table
has at most shards x buckets rows, a fixed bound, so it is broadcast. Texts are never shuffled: size and
checksum are taken at the scan. Equal texts are dealt by their own keys, so a hot group spreads.

Defined results: null text has size 1 and checksum 0; a null key counts as -1; repeated rows share a
shard and get slots of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, text_or_empty

SHARDS = 16
BUCKETS = 256
MASK = 0xFFFFFFFF
#: The odd multiplier of the mixing rounds and the step between shard seeds.
MULTIPLIER = 0x45D9F3B
SEED_STEP = 0x9E3779B9


def mix_int(x: int) -> int:
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MULTIPLIER) & MASK
    return x ^ (x >> 16)


def mixed(values: Column) -> Column:
    """An array of unsigned 32-bit longs, each mixed by a bijection; products stay under 2^63.

    Each round reads its input twice. As rounds are lambdas over an array, it is computed once all the same,
    wherever the optimiser moves or repeats the expression.
    """
    for _ in range(2):
        values = F.transform(values, lambda x: (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK)))
    return F.transform(values, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))


def mixed_one(value: Column) -> Column:
    return F.coalesce(F.get(mixed(F.array(value)), F.lit(0)), F.lit(0).cast("long"))


def seed_of(shard: int) -> int:
    return mix_int((shard + 1) * SEED_STEP & MASK)


def with_digest(df: DataFrame, key: str, name: str = "__digest") -> DataFrame:
    """A 32-bit digest of a long key; both halves take part."""
    whole = F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long"))
    high = F.shiftright(whole, 32).bitwiseAND(F.lit(MASK))
    return df.withColumn(name, mixed_one(mixed_one(whole.bitwiseAND(F.lit(MASK))).bitwiseXOR(high)))


def rendezvous(df: DataFrame, weights: dict[str, list[float]], digest: str = "__digest") -> DataFrame:
    """Adds for each name the shard with the largest draw under its weights; of equal draws the smaller shard."""
    for own in weights.values():
        if not own or any(not (w > 0 and math.isfinite(w)) for w in own):
            raise ValueError("weights must be positive")
    seeds = [F.lit(seed_of(j)).cast("long") for j in range(max(map(len, weights.values())))]
    df = df.withColumn("__draws", mixed(F.array(*[F.col(digest).bitwiseXOR(s) for s in seeds])))
    for name, own in weights.items():
        draws = F.slice("__draws", 1, len(own))
        if len(set(own)) > 1:  # -weight / ln(u) orders as the weighted draws do
            scales = F.array(*[F.lit(float(w)) for w in own])
            draws = F.zip_with(draws, scales, lambda d, w: -w / F.ln((d + 0.5) / F.lit(float(MASK + 1))))
        best = F.array_max(F.transform(draws, lambda d, j: F.struct(d.alias("d"), (-j).alias("j"))))
        df = df.withColumn(name, F.coalesce(-best["j"], F.lit(0)).cast("int"))
    return df.drop("__draws")


def shard_documents(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, by the law ``key``."""
    equal, larger = [1.0] * shards, [1.0] * (shards + 1)

    def dealt(rows: DataFrame, laws: dict[str, list[float]]) -> DataFrame:
        rows = rendezvous(with_digest(rows, "doc_id"), laws)
        spread = mixed_one(F.col("__digest").bitwiseXOR(F.lit(MASK)))
        return rows.withColumn("bucket", F.coalesce(spread % buckets, F.lit(0)).cast("int")).drop("__digest")

    raw = text_or_empty().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    starts = (
        dealt(docs.select("doc_id"), {"shard": equal})
        .groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    )
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    placed = dealt(rows, {"shard": equal, "grown_shard": larger}).withColumn("inside", F.row_number().over(inside) - 1)
    slot = (F.col("first") + F.col("inside")).cast("long").alias("slot")
    return placed.join(F.broadcast(starts), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def _sql() -> str:
    seeds = ", ".join(f"({j}, {seed_of(j)})" for j in range(SHARDS + 1))
    steps = ["a0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -1) AS k, coalesce(text, '') AS t FROM documents)"]

    def mixed(source: str, expression: str, keep: str, out: str) -> str:
        """Three nested steps, so that no expression is repeated in full."""
        one = f"SELECT *, ((xor(m0, m0 >> 16) * {MULTIPLIER}) & {MASK}) AS m1 FROM (SELECT *, {expression} AS m0 FROM {source})"
        two = f"SELECT *, ((xor(m1, m1 >> 16) * {MULTIPLIER}) & {MASK}) AS m2 FROM ({one})"
        return f"SELECT {keep}, xor(m2, m2 >> 16) AS {out} FROM ({two})"

    steps.append(f"a1 AS ({mixed('a0', f'k & {MASK}', 'rid, doc_id, k, t', 'low')})")
    steps.append(f"a2 AS ({mixed('a1', f'xor(low, (k >> 32) & {MASK})', 'rid, doc_id, t', 'digest')})")
    steps.append(f"a3 AS ({mixed('a2', f'xor(digest, {MASK})', 'rid, doc_id, t, digest', 'spread')})")
    steps.append(f"seeds(j, seed) AS (VALUES {seeds})")
    steps.append("pairs AS (SELECT a3.*, j, seed FROM a3 CROSS JOIN seeds)")
    steps.append(f"draws AS ({mixed('pairs', 'xor(digest, seed)', 'rid, j', 'draw')})")
    steps.append(f"won AS (SELECT rid, arg_max(j, draw * 32 - j) FILTER (j < {SHARDS}) AS shard, arg_max(j, draw * 32 - j) AS grown FROM draws GROUP BY rid)")
    # crc32 of UTF-8 bytes by its definition: the reflected polynomial, a nibble at a time
    nibbles = list(range(16))
    for _ in range(4):
        nibbles = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in nibbles]
    table_ = f"({nibbles}::BIGINT[])"
    half = f"xor(c >> 4, {table_}[(xor(c, b) & 15) + 1])"
    byte = f"xor(({half}) >> 4, {table_}[(xor({half}, b >> 4) & 15) + 1])"
    pairs = "list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {pairs}), lambda c, b: {byte}), 4294967295)"
    steps.append(f"sized AS (SELECT rid, doc_id, octet_length(encode(t)) + 1 AS size, {crc} AS text_crc32, spread % {BUCKETS} AS bucket FROM a3)")
    return f"""WITH {', '.join(steps)}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM sized JOIN won USING (rid)"""


ORACLE_SQL = _sql()
