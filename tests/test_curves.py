"""Space-filling curves, box splits, adaptive bins and parameters."""

import itertools

import pytest
from pyspark.sql import functions as F

from pointweave.functions import columns as C
from pointweave.operators import kernels, splits
from pointweave.sources.options import CodingOptions, measurable, read_config, read_flags


def codes(spark, bits, rows=None):
    cells = rows or list(itertools.product(range(1 << min(bits, 3)), repeat=3))
    df = spark.createDataFrame(cells, "x long, y long, z long").withColumn("code", C.hilbert3(*map(F.col, "xyz"), bits))
    return {(r["x"], r["y"], r["z"]): r["code"] for r in df.collect()}


def test_hilbert_walks_through_all_cells_by_faces(spark):
    path = sorted((c, p) for p, c in codes(spark, 3).items())
    assert [c for c, _ in path] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(path, path[1:]))


@pytest.mark.parametrize("bits", [3, 4, 5, 20])
def test_hilbert_codes_do_not_depend_on_leading_zeros(spark, bits):
    assert codes(spark, bits, [(1, 2, 3), (7, 0, 5), (0, 0, 0)]) == codes(spark, 20, [(1, 2, 3), (7, 0, 5), (0, 0, 0)])


def test_hilbert_has_twelve_states_and_known_places(spark):
    following, rank = C.hilbert_tables()
    assert len(following) == len(rank) == 12 * 8
    # Places of the first cells of the curve over 20 bits.
    known = {(0, 0, 0): 0, (0, 1, 0): 1, (1, 1, 0): 2, (1, 0, 0): 3, (1, 0, 1): 4, (1, 1, 1): 5, (0, 1, 1): 6, (0, 0, 1): 7, (0, 0, 2): 8, (0, 2, 0): 26}
    assert codes(spark, 20, list(known)) == known


@pytest.mark.parametrize("bits", [0, 21])
def test_hilbert_refuses_other_sizes(bits):
    with pytest.raises(ValueError):
        C.hilbert3(F.lit(0), F.lit(0), F.lit(0), bits)


@pytest.mark.parametrize("size,before,smallest", [((3, 3, 3), 2, 2), ((9, 7, 6), 1, 3), ((5, 0, 2), 0, 0), ((4, 2, 2), 9, 9), ((1, 0, 0), 0, 0)])
def test_schedule_ends_in_single_cells(size, before, smallest):
    levels = list(splits.schedule(size, before, smallest))
    assert levels[0].size == size and levels[-1].child == (0, 0, 0)
    assert all(a.child == b.size for a, b in zip(levels, levels[1:]))
    assert all(v.unsplit < 7 for v in levels)


def test_schedule_of_a_cell_is_empty_and_cubes_split_evenly():
    assert not list(splits.schedule((0, 0, 0)))
    assert {v.unsplit for v in splits.schedule((4, 4, 4), 3, 2)} == {0}
    with pytest.raises(ValueError):
        list(splits.schedule((1, -1, 0)))


def test_split_octree_keeps_every_cell_and_empty_clouds(spark):
    levels = list(splits.schedule((3, 2, 1), 1, 1))
    cells = [(0, 0, 0), (7, 3, 1), (7, 3, 1), (5, 0, 1)]
    made = splits.split_octree(spark.createDataFrame(cells, "x long, y long, z long"), levels)
    children = {r["depth"]: r["n"] for r in made.groupBy("depth").agg(F.sum(F.bit_count("occupancy")).alias("n")).collect()}
    assert children[levels[-1].depth] == 3
    none = splits.split_octree(spark.createDataFrame([], "x long, y long, z long"), levels)
    assert none.count() == 0


def test_adaptation_falls_flips_and_stays_in_bounds():
    state = (kernels.ADAPT_START, 0, 0, 0)
    state = kernels.adapted(state, 1)
    assert state == (2047 - (1023 + 197), 1, 1, 1)
    for _ in range(200):
        state = kernels.adapted(state, 1)
    assert state[1:] == (1, 1, 1) and 0 <= state[0] < 10
    for bit in (0, 1) * 300:
        state = kernels.adapted(state, bit)
        assert 0 <= state[0] < kernels.ADAPT_HALF and 1 <= state[1] <= 3


def test_adaptation_of_no_bins_is_empty(spark):
    assert kernels.adapt_contexts(spark.createDataFrame([], "slice_id long, ctx long, pos long, bit long")).count() == 0


def test_options_read_files_and_flags():
    text = "# all\n step : 2.5 # half\nqp:8\nodd line\na : b : c\n"
    assert read_config(text) == {"step": "2.5", "qp": "8"}
    assert read_flags(["--slices", "4", "-lossless", "--shift", "-3"]) == {"slices": "4", "lossless": "1", "shift": "-3"}
    assert CodingOptions.read(text, ["--qp", "9"]) == CodingOptions(step=2.5, qp=9)
    with pytest.warns(UserWarning, match="strange"):
        CodingOptions.read("strange : 1")


def test_options_name_every_fault():
    with pytest.raises(ValueError, match="step.*qp"):
        CodingOptions(step=0, qp=64)


def test_measurable_names_what_a_cloud_has(spark):
    full = spark.createDataFrame([(0, 0, 0, 1, 2, 3)], "x long, y long, z long, r long, g long, b long")
    assert measurable(full) == {"geometry", "color"}
    for bad in (full.drop("z"), full.limit(0)):
        with pytest.raises(ValueError):
            measurable(bad)
