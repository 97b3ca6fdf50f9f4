from __future__ import annotations

import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

import __spark_entry__
from orthoquilt.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])


def test_entry_point(spark):
    assert __spark_entry__.entry(spark).columns == ["face_id", "pred_class", "n_obs"]
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_library_does_not_import_the_training_data_operators():
    import os
    import re

    top = os.path.join(os.path.dirname(__spark_entry__.__file__), "orthoquilt")
    for folder, _, files in os.walk(top):
        if "llm" in os.path.relpath(folder, top).split(os.sep):
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"orthoquilt\.llm|from \.llm", open(os.path.join(folder, f)).read()), f


@pytest.mark.parametrize("name", ["kmeans_chunks"])
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def steep_parts(spark, path) -> str:
    """A camera and two triangles whose shared edge goes through a pixel's centre, at a depth that is a half in the tenth decimal."""
    spark.createDataFrame([(40, "s", 8623.05)], "s_suppkey long, s_name string, s_acctbal double").write.parquet(f"{path}/supplier.parquet")
    parts = [(3, 37, "b"), (4, 2, "b"), (53, 6, "b"), (54, 45, "b")]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_brand string").coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_depths_are_rounded_as_in_sql(spark, tmp_path):
    d = steep_parts(spark, tmp_path)
    assert_same(QUERIES["zbuffer_raster"](spark, d), connect(d), ORACLE_SQL["zbuffer_raster"])


def test_pixels_of_a_class_are_those_of_sql(spark, tmp_path):
    d = steep_parts(spark, tmp_path)
    assert_same(QUERIES["rendered_labels"](spark, d), connect(d), ORACLE_SQL["rendered_labels"])


def test_a_part_that_is_there_twice_does_not_count_its_pixels_twice(spark, tmp_path):
    d = steep_parts(spark, tmp_path)
    spark.createDataFrame([(3, 37, "b")], "p_partkey long, p_size int, p_brand string").coalesce(1).write.mode("append").parquet(f"{d}/part.parquet")
    assert_same(QUERIES["rendered_labels"](spark, d), connect(d), ORACLE_SQL["rendered_labels"])


def test_closest_points_of_parallel_rays_are_those_of_sql(spark, tmp_path):
    """Two rays of a group are parallel and overlap, so both ends of the overlap are as near."""
    events = [(97872, 1, 6.27), (97875, 2, 6.27), (97873, 3, 80.0), (8608, 1, 4.58), (8611, 1, 4.58)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert_same(QUERIES["ray_point_average"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLE_SQL["ray_point_average"])


def test_a_part_that_is_there_twice_with_two_brands_keeps_the_edges_of_each(spark, tmp_path):
    parts = [(k, 1, "b") for k in range(0, 104)] + [(3, 1, "c")]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert_same(QUERIES["boundary_edges"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLE_SQL["boundary_edges"])


def test_rows_of_one_small_file_are_spread(spark, tmp_path):
    from orthoquilt.plans import scene

    spark.range(50_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert scene.spread(spark.range(5).where("false")).rdd.getNumPartitions() == 1
    assert QUERIES["distort_pixels"](spark, str(tmp_path)).rdd.getNumPartitions() == 3
