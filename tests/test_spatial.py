"""Nearest points, codes and coders against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pointweave import catalog
from pointweave.functions import columns as C
from pointweave.operators import contexts, kernels, neighbors, predict

DATA = "/root/testdata/sf0.001"


def brute_nearest(queries, points, k, skip_zero):
    out = set()
    for i, *q in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(q, p)), j) for j, *p in points)
        near = [n for n in near if n[0] > 0] if skip_zero else near
        if near:
            worst = near[min(k, len(near)) - 1][0]
            out |= {(i, j, d) for d, j in near if d <= worst}
    return out


@pytest.mark.parametrize(("low", "high", "n"), [(0, 10_000, 60), (0, 12, 200), (-700, 700, 40)])
def test_nearest_equals_brute_force(spark, low, high, n):
    rng = random.Random(n)
    place = lambda: tuple(rng.randint(low, high) for _ in range(3))
    queries, points = [(i, *place()) for i in range(60)], [(i, *place()) for i in range(n)]
    points += [(n + i, *points[0][1:]) for i in range(3)]
    q, p = spark.createDataFrame(queries, "qid long, x long, y long, z long"), spark.createDataFrame(points, "pid long, x long, y long, z long")
    for k, skip_zero in ((1, False), (1, True), (3, False)):
        found = {(r["qid"], r["pid"], r["d2"]) for r in neighbors.nearest(q, p, k=k, skip_zero=skip_zero).collect()}
        assert found == brute_nearest(queries, points, k, skip_zero)


def test_no_query_is_lost_far_from_all_points(spark):
    q, p = spark.createDataFrame([(1, 1000, 0, 0)], "qid long, x long, y long, z long"), spark.createDataFrame([(1, 500, 0, 0)], "pid long, x long, y long, z long")
    assert [tuple(r) for r in neighbors.nearest(q, p).collect()] == [(1, 1, 250_000)]
    assert neighbors.nearest(q.limit(0), p).count() == 0 and neighbors.nearest(q, p.limit(0)).count() == 0


@pytest.mark.parametrize("code", [C.morton3, C.hilbert3])
def test_coordinates_out_of_range_are_errors(spark, code):
    rows = spark.createDataFrame([(5, 0, 0), (None, 1, 1)], "x long, y long, z long")
    assert rows.select(code(*map(F.col, "xyz"), 7).alias("c")).where("c is not null").count() == 1
    for bad in ((133, 0, 0), (0, -1, 0)):
        with pytest.raises(Exception, match="fit into 7 bits"):
            spark.createDataFrame([bad], "x long, y long, z long").select(code(*map(F.col, "xyz"), 7).alias("c")).collect()


def test_nodes_move_on_their_codes(spark):
    top = (1 << 21) - 1
    rows = spark.createDataFrame([(3, 0, 7), (0, 0, 0), (top, 1, 2)], "x long, y long, z long").withColumn("node", C.morton3(*map(F.col, "xyz")))
    for d in ((1, 0, -1), (-1, 1, 0), (0, 0, 0), (1, 1, 1)):
        for r in rows.select("x", "y", "z", contexts.moved(*d).alias("to")).collect():
            want = [a + b for a, b in zip(r[:3], d)]
            inside = all(0 <= v <= top for v in want)
            assert r["to"] == (sum((v >> i & 1) << 3 * i + p for v, p in zip(want, (2, 1, 0)) for i in range(21)) if inside else None)


def slices(spark, name):
    out = {}
    for r in sorted(catalog.queries()[name](spark, DATA).collect(), key=lambda r: (r["slice_id"], r["pos"])):
        out.setdefault(r["slice_id"], []).append(r)
    return out


@pytest.mark.parametrize(("coder", "decoder", "columns"), [("encode_refl", "decode_refl", ("recon",)), ("encode_color", "decode_color", ("c0", "c1", "c2"))])
def test_decoding_gives_what_the_coder_reconstructed(spark, coder, decoder, columns):
    mine, back = slices(spark, coder), slices(spark, decoder)
    assert mine and mine.keys() == back.keys()
    for s, rows in mine.items():
        assert [tuple(r[c] for c in columns) for r in rows] == [tuple(r)[2:] for r in back[s]]


def test_lossy_reflectance_equals_brute_force(spark):
    points = [r.asDict() for r in predict.ranked(catalog_points(spark)).collect()]
    qp, got = 16, slices(spark, "encode_refl")
    for s in got:
        own = sorted((p for p in points if p["slice_id"] == s), key=lambda p: p["pos"])
        cells, recon = [(p["x"], p["y"], p["z"]) for p in own], []
        for i, p in enumerate(own):
            near = sorted((sum(abs(a - b) for a, b in zip(cells[i], cells[j])), i - j) for j in range(max(0, i - 128), i))[:3]
            guess = kernels.refl_prediction(i, recon, cells, near)
            q, value = kernels.quantised(p["refl"] - guess, qp)
            recon.append(max(-32768, min(32767, guess + value)))
            assert (got[s][i]["refl"], got[s][i]["coded"], got[s][i]["recon"]) == (p["refl"], q, recon[-1])


def catalog_points(spark):
    from pointweave.plans.base import sliced

    return sliced(spark, DATA)


def test_previous_points_across_stretches(spark, monkeypatch):
    points = predict.ranked(catalog_points(spark))
    whole = {(r["slice_id"], r["pos"]): r["near"] for r in predict.previous_nearest(points).collect()}
    monkeypatch.setattr(predict, "CHUNK", 200)
    assert {(r["slice_id"], r["pos"]): r["near"] for r in predict.previous_nearest(points).collect()} == whole


def test_many_points_are_never_broadcast(spark, monkeypatch, capsys):
    """a broadcast of as many rows as points is built in the driver; how small their file is doesn't matter."""
    rng = random.Random(5)
    queries, points = [[(i, *(rng.randint(0, 40) for _ in range(3))) for i in range(n)] for n in (50, 70)]
    q, p = spark.createDataFrame(queries, "qid long, x long, y long, z long"), spark.createDataFrame(points, "pid long, x long, y long, z long")
    for few in (True, False):
        if not few:
            monkeypatch.setattr(neighbors, "FEW", 10, raising=False)
        near = neighbors.nearest(q, p, skip_zero=True)
        near.explain()
        assert ("BroadcastHashJoin" in capsys.readouterr().out) == few
        assert {tuple(r) for r in near.collect()} == brute_nearest(queries, points, 1, True)
