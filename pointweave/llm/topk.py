"""Operator 5, exact top-k search by inner product: three-phase uniform threshold.

The coordinates are cut into LISTS ranges; the inner product over one range is a row's score in that list and its whole
score is the sum over the lists. A task holds one block of queries against one group of rows.

Phase 1 scores the lists of every task once. Each list's k best entries are resolved, and the k best whole scores
among them leave the task for its local list. The k-th of those bounds the query's k-th best whole score from below,
and a whole score of t or more needs an entry of t / LISTS or more in some list; so the task keeps, beside the local
list, only the entries that reach its own bound. Phase 2 gathers the local lists into one safe cutoff for each query
and collects the kept entries that reach it. Phase 3 resolves the whole scores of the collected entries, and of
nothing else, from the vectors of their group and keeps the best k.

Queries come in blocks of at most BLOCK, rows in groups of about GROUP, both dealt out by the row's own number, so that
many rows of one vec_id, or of one vector, spread over all tasks. A row is copied once for each block of queries, which is
the stated query set in blocks; no pair of rows is emitted: what leaves a task is one line for each query.

Defined results: components become floor(256 x) in doubles; vectors that are null, empty, or hold null or non-finite
components (also once scaled), and rows without vec_id, take no part; vectors of different lengths aren't compared; all rows with a query's
vec_id are its own; equal scores go to the smaller vec_id; repeated rows stand once each (a repeated query is asked once,
with the smallest of its vectors); scores beyond a long are held at its ends; sums are exact at every magnitude; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

K = 5
EVERY = 50
LISTS = 2
BLOCK, GROUP, SUB, TILE = 2048, 8192, 64, 128
SCALE = 256.0
LEAST, MOST = -(2**63), 2**63 - 1

KEPT = "query_id long, b int, g int, v array<double>, heads array<long>, kept array<struct<rid:long,part:double>>"
FOUND = "query_id long, vec_id long, score long"


def _by_length(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length: places in the table and scaled components."""
    values = t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"]
    flat = np.floor(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    starts = np.cumsum([0, *(sizes := np.diff(values.offsets.to_numpy()))])
    out = {}
    for size in np.unique(sizes):
        at = np.nonzero(sizes == size)[0]
        out[int(size)] = at, flat[starts[at][:, None] + np.arange(size)]
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the narrowest type that holds every sum of products exactly: single, double or unbounded integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**24:
        return a.astype(np.float32), b.astype(np.float32)
    if most < 2.0**53:
        return a, b
    whole = np.vectorize(int, otypes=[object])
    return whole(a), whole(b)


def _parts(q: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    cuts = np.linspace(0, q.shape[1], LISTS + 1).astype(int)
    return [q[:, a:b] @ v[:, a:b].T if b > a else np.zeros((len(q), len(v)), q.dtype) for a, b in zip(cuts, cuts[1:])]


def _floor_of_best(part: np.ndarray, k: int) -> np.ndarray:
    """For each row a bound that its k best values, and not many others, reach: the k-th best of the maxima of tiles."""
    rows, n = part.shape
    if n < 2 * k * TILE:
        tiles = part
    else:
        whole = n - n % TILE
        tiles = part[:, :whole].reshape(rows, -1, TILE).max(axis=2)
    return np.sort(tiles, axis=1)[:, -k if tiles.shape[1] >= k else 0]


def _long(score) -> int:
    return max(LEAST, min(MOST, int(score)))


def _lists(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Phase 1: for every query of the block its local list (heads) and the entries that reach the local bound (kept)."""

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[dict] = []
        have, row_ids, vec_ids = _by_length(rows), rows["rid"].to_numpy(), rows["vec_id"].to_numpy()
        query_ids = queries["vec_id"].to_numpy()
        for size, (asked, q_all) in _by_length(queries).items():
            if size not in have:
                continue
            at, v_all = have[size]
            ids, numbers = vec_ids[at], row_ids[at]
            q, v = _exact(q_all, v_all)
            for first in range(0, len(asked), SUB):
                own = query_ids[asked[first : first + SUB]]
                parts = _parts(q[first : first + SUB], v)
                other = own[:, None] != ids[None, :] if np.isin(own, ids).any() else None
                seen = np.zeros(parts[0].shape, bool)
                for part in parts:
                    seen |= part >= _floor_of_best(np.where(other, part, part.min() - 1) if other is not None else part, k)[:, None]
                if other is not None:
                    seen &= other
                bounds = []
                for i in range(len(own)):
                    places = np.nonzero(seen[i])[0]
                    best = np.sort(sum(part[i, places] for part in parts))[::-1][:k]
                    # Scores held at an end of a long are equal: there the bound is that end, or there is none.
                    bounds.append((best, min(best[k - 1], MOST) if len(best) == k and best[k - 1] > LEAST else None))
                for i, (best, bound) in enumerate(bounds):
                    # Without k entries there is no bound, and every row of the group is kept.
                    tops = parts[0][i] if LISTS == 1 else np.maximum.reduce([part[i] for part in parts])
                    keep = (tops * LISTS >= bound) if bound is not None else np.ones(len(ids), bool)
                    if other is not None:
                        keep = keep & other[i]
                    places = np.nonzero(keep)[0]
                    out.append(
                        {
                            "query_id": int(own[i]), "b": key[0], "g": key[1], "v": (q_all[first + i] / SCALE).tolist(), "heads": [_long(x) for x in best],
                            "rids": numbers[places], "tops": np.nextafter(tops[places].astype(np.float64), np.inf),
                        }
                    )
        sizes = np.cumsum([0, *(len(o["rids"]) for o in out)])
        flat = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in ("rids", "tops")]
        entries = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.float64))], names=["rid", "part"])
        kinds = {"query_id": pa.int64(), "b": pa.int32(), "g": pa.int32(), "v": pa.list_(pa.float64()), "heads": pa.list_(pa.int64())}
        columns = {c: pa.array([o[c] for o in out], kind) for c, kind in kinds.items()}
        return pa.table(columns | {"kept": pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), entries)})

    return lambda key, queries, rows: run(tuple(k.as_py() for k in key), queries, rows)


def _resolve(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Phase 3: whole scores of the collected entries alone, and the k best of each query."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], []]
        numbers, vec_ids = rows["rid"].to_numpy(), rows["vec_id"].to_numpy()
        order = np.argsort(numbers)
        have = {size: (dict(zip(at.tolist(), range(len(at)))), v) for size, (at, v) in _by_length(rows).items()}
        for query, vector, rids in zip(asked["query_id"].to_pylist(), asked["v"].to_pylist(), asked["rids"].combine_chunks()):
            places = order[np.searchsorted(numbers, rids.values.to_numpy(), sorter=order)]
            index, v = have[len(vector)]
            q, near = _exact(np.array([vector]) * SCALE, v[[index[p] for p in places.tolist()]])
            scores = (near @ q[0]).tolist()
            for score, vec_id in sorted((-_long(s), i) for s, i in zip(scores, vec_ids[places].tolist()))[:k]:
                for column, x in zip(out, (query, vec_id, -score)):
                    column.append(x)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return run


def _dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
    spread = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    return rows.withColumn(own, F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")).withColumn(other, spread)


def collected(vectors: DataFrame, queries: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Phases 1 and 2. What is left: (query_id, b, g, v, rids), and the numbered rows dealt to (b, g)."""
    numbered = materialise(vectors.select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("v"), F.monotonically_increasing_id().alias("rid")), "vectors")
    one = queries.groupBy("vec_id").agg(F.min(F.transform("v", lambda x: x.cast("double"))).alias("v"))
    asked = materialise(one.withColumn("rid", F.col("vec_id")), "asked")
    groups, blocks = max(1, -(-numbered.count() // GROUP)), max(1, -(-asked.count() // BLOCK))
    dealt = _dealt(numbered, "g", groups, "b", blocks)
    met = _dealt(asked, "b", blocks, "g", groups).groupBy("b", "g").cogroup(dealt.groupBy("b", "g"))
    lists = materialise(met.applyInArrow(_lists(k), KEPT), "lists")
    head = W.partitionBy("query_id").orderBy(F.desc("head"))
    heads = lists.select("query_id", F.explode("heads").alias("head")).withColumn("r", F.row_number().over(head)).where(F.col("r") == k)
    # A cutoff at the low end of a long may stand for less, so it cuts nothing; doubles of large longs may be rounded up.
    tau = heads.select("query_id", F.when(F.col("head") > LEAST, F.col("head").cast("double")).alias("tau"))
    cut = F.coalesce((F.col("tau") - F.abs("tau") * 1e-12) / LISTS, F.lit(float("-inf")))
    left = lists.join(tau, "query_id", "left").withColumn("cut", cut)
    rids = F.transform(F.filter("kept", lambda e: e["part"] >= F.col("cut")), lambda e: e["rid"])
    return left.select("query_id", "b", "g", "v", rids.alias("rids")).where(F.size("rids") > 0), dealt


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables: vec_id long, v array of float or double, all usable."""
    left, dealt = collected(vectors, queries, k)
    local = left.groupBy("b", "g").cogroup(dealt.groupBy("b", "g")).applyInArrow(_resolve(k), FOUND)
    ranked = local.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def usable(embeddings: DataFrame) -> DataFrame:
    vector = F.col("embedding")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & (F.size(vector) > 0) & fine).select("vec_id", vector.alias("v"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
