"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from octaspark.plans.queries import ORACLE, QUERIES

#: One of each family here; the rest run with FULL_ORACLE=1 and in the driver's comparison.
SOME = (
    "cloud_bbox grid_cell_counts subgrid_counts count_pyramid octree_leaves_skewed octree_nodes leaf_slices node_stats level_rate hierarchy_stats voxels_average voxels_neighborhood "
    "cloud_voxels_interpolated visible_nodes closest_color hqs_resolve edl_response depth_dilate morton_sort_rank block_shuffle quantize_30bit_planes delta_bits morton_image_xy "
    "mask_stream_dfs mask_decode byte_offset_bins bench_median_run timing_report height_field_tiles las_scan octree_hierarchy_roundtrip voxels_first voxel_occupancy "
    "cloud_voxels_smooth export_samples vertex_voxels plane_distance bits_total pack_variable_bits pack_20bit batch_octants strict_octants node_morton_order batch_morton_order order_by_centre "
    "residue_order morton_runs blue_noise_tiles distinct_check incremental_octree incremental_voxels las_sorted_rewrite probe_point_counts node_csv payload_scan "
    "closing_bins packed_block_plan packed_block_roundtrip ray_through_frustum las_box_scan octree_file_roundtrip octree_file_view incremental_coloured_voxels growing_blue_noise las_crop_file"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)
    return df[cols].sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE) if os.environ.get("FULL_ORACLE") else SOME)
def test_query(spark, duck, sf, name):
    got, want = tidy(QUERIES[name](spark, sf).toPandas()), tidy(duck.execute(ORACLE[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)
    spark.catalog.clearCache()
