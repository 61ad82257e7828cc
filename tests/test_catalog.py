"""Queries against their DuckDB texts on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pointweave import catalog

DATA = "/root/testdata/sf0.001"
#: One or two of every family; the driver compares all.
CHOSEN = (
    "attr_coerce", "digest", "rgb_to_yuv", "ceil_log2", "quant_residual", "psnr", "bbox_grid", "fast_recolor", "dup_report", "slice_by_morton", "octree_bfs",
    "decode_octree", "octree_single_point", "context_counts", "ctx_mode1_child", "context_counts_mode1", "ctx_adapt", "hilbert_rank", "qtbt_schedule", "qtbt_octree", "knn_ties", "recolour", "frame_average", "intrinsic_resolution", "geo_mse", "lod_shift", "occ_insert", "ctx_sibling", "single_point_bins", "residual_symbols_color", "brick_headers", "ply_binary", "encode_refl_lossless", "decode_color_lossless", "pred_color", "pred_refl_hilbert", "pred_refl_dual", "residual_stats",
)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    df, other = catalog.queries()[name](spark, DATA), duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    at = [other.columns.index(c) for c in columns]
    assert mine == sorted(repr(tuple(plain(r[i]) for i in at)) for r in other.fetchall())


def test_flagship_has_rows(spark):
    rows = catalog.flagship(spark, DATA).collect()
    assert len(rows) == 5 and all(r["n_children"] >= r["n_nodes"] for r in rows)
