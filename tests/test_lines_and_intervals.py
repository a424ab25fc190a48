import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import lines, planar, tiles, wkb
from tidemark.functions.names import buffer_of, is_date, zoom_of
from tidemark.functions.planar import point
from tidemark.operators import cells, intervals, scan


def line(*points):
    return F.array(*[point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def vertices(l):
    return [tuple(p) for p in l]


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def test_pieces_of_lines(one):
    df = lines.with_measures(one.withColumn("line", line((0, 0), (3, 0), (3, 2))), "line")
    r = df.select(lines.split_every("line", 2.0, "along").alias("a"), lines.split_every("line", 9.0, "along").alias("b"), lines.split_every("line", 2.49, "along", 0.1).alias("c"), lines.midpoint("line", "along").alias("m")).first()
    assert [vertices(x) for x in r["a"]] == [[(0, 0), (2, 0)], [(2, 0), (3, 0), (3, 1)], [(3, 1), (3, 2)]]
    assert [vertices(x) for x in r["b"]] == [[(0, 0), (3, 0), (3, 2)]]
    assert len(r["c"]) == 2 and tuple(r["m"]) == (2.5, 0)
    places = F.array(*[point(F.lit(x), F.lit(y)) for x, y in ((3.0, 1.0), (1.0, 0.05), (1.0, 5.0), (0.0, 0.0))])
    r = df.withColumn("p", places).select(lines.split_at("line", "p", "along").alias("a")).first()
    assert [vertices(x) for x in r["a"]] == [[(0, 0), (1, 0)], [(1, 0), (3, 0), (3, 1)], [(3, 1), (3, 2)]]


def test_parallels(one):
    r = one.select(lines.parallel(line((0, 0), (2, 0), (4, 0)), 1.0).alias("straight"), lines.parallel(line((0, 0), (2, 0), (2, 2)), -1.0).alias("right"), lines.parallel(line((0, 0), (1, 1)), 0.0).alias("same")).first()
    assert vertices(r["straight"]) == [(0, 1), (2, 1), (4, 1)]
    assert vertices(r["right"]) == [(0, -1), (3, -1), (3, 2)]
    assert vertices(r["same"]) == [(0, 0), (1, 1)]


def test_geojson_bounds(spark):
    texts = ['{"type":"Point","coordinates":[1,2]}', '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,3],[0,0]]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,7],[5,5]]]]}', None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r["b"] for r in df.select("k", lines.geojson_bbox("t").alias("b")).orderBy("k").collect()] == [[1, 2, 1, 2], [0, 0, 4, 3], [0, 0, 6, 7], None]
    with pytest.raises(Exception, match="no such geometry type"):
        spark.createDataFrame([('{"type":"Blob"}',)], "t string").select(lines.geojson_bbox("t")).collect()


def test_names(spark):
    df = spark.createDataFrame([("a/grid_z8_15000m.parquet",), ("x.parquet",)], "p string")
    assert [tuple(r) for r in df.select(zoom_of("p"), buffer_of("p")).collect()] == [(8, 15000), (None, None)]
    df = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024-2-9",), (None,)], "d string")
    assert [r[0] for r in df.select(is_date("d")).collect()] == [True, False, False, False]


def test_asof_and_intervals(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    a = spark.createDataFrame([(1, "x", at(1)), (2, "x", at(5)), (3, "y", at(5)), (4, None, at(5))], "id int, k string, t timestamp")
    b = spark.createDataFrame([("x", at(1), 10.0), ("x", at(4), None), ("y", at(6), 30.0)], "k string, t timestamp, v double")
    got = {r["id"]: r["v"] for r in intervals.asof(a, b, ["k"], "t", ["v"]).collect()}
    assert got == {1: 10.0, 2: None, 3: None, 4: None}
    b = spark.createDataFrame([("x", at(1), 10.0), ("x", at(2), 20.0)], "k string, t timestamp, v double")
    assert {r["id"]: r["v"] for r in intervals.asof(a, b, ["k"], "t", ["v"], tolerance=3600.0).collect()} == {1: 10.0, 2: None, 3: None, 4: None}
    spans = spark.createDataFrame([("p", at(0), at(5)), ("q", at(5), at(9))], "s string, a timestamp, b timestamp")
    got = sorted((r["id"], r["s"]) for r in intervals.within_intervals(a, spans, "t", "a", "b", 7200.0).collect())
    assert got == [(1, "p"), (2, "q"), (3, "q"), (4, "q")]


def test_inputs_and_cells(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "k int, v double")
    assert [tuple(r) for r in df.select("k", scan.resolved(df, "v", "v", default=0.0, cast="float"), scan.resolved(df, 7, "w")).orderBy("k").collect()] == [(1, 0.0, 7), (2, 5.0, 7)]
    with pytest.raises(ValueError):
        scan.resolved(df, "gone", "v", required=True)
    row = spark.range(1).select(cells.region_class(F.lit(True), F.lit(True), F.lit(True)), cells.region_class(F.lit(True), F.lit(False), F.lit(False)), cells.classified(F.lit(None).cast("double"), (1.0,)), cells.as_byte(F.lit(0.5), 0.0, 1.0), cells.is_rotated(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0))).first()
    assert tuple(row) == (3, 1, None, 128, False)
    with pytest.raises(ValueError):
        cells.with_static_time(spark.createDataFrame([(1,), (2,)], "time int"), "2020-01-01", "2020-12-31")


def mentions(df, what):
    """How often an expression stands in the optimised plan: each mention is evaluated anew inside a lambda function."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_splits_make_each_value_once(spark, one):
    df = lines.with_measures(one.withColumn("line", line((0, 0), (3, 0), (3, 2))), "line")
    places = F.array(*[point(F.col("id") + x, F.col("id") + y) for x, y in ((3.0, 1.0), (1.0, 0.05))])
    split = df.withColumn("p", places).select(lines.split_at("line", "p", "along").alias("a"))
    assert mentions(split, "array_distinct(") == 1
    assert [vertices(x) for x in split.first()["a"]] == [[(0, 0), (1, 0)], [(1, 0), (3, 0), (3, 1)], [(3, 1), (3, 2)]]

    every = df.select(lines.split_every("line", 2.0, "along").alias("a"))
    assert mentions(every, "SQRT(") <= 3
    assert [vertices(x) for x in every.first()["a"]] == [[(0, 0), (2, 0)], [(2, 0), (3, 0), (3, 1)], [(3, 1), (3, 2)]]


def test_long_rows_are_spread(spark, data):
    from tidemark import plans

    for name in ("split_by_points", "geojson_bounds", "parallel_line", "quadkey_feature", "geojson_quadkey", "split_by_distance", "projected_rectangle"):
        plan = plans.load()[0][name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name


def test_offsets_measure_a_side_once(one):
    a, b = point(F.col("id") + 0.0, F.col("id") + 0.0), point(F.col("id") + 3.0, F.col("id") + 4.0)
    df = one.select(planar.offset_rectangle(a, b, 5.0).alias("ring"), planar.shift_point(a, b, 10.0).alias("held"))
    assert mentions(df, "SQRT(") <= 3
    assert vertices(df.first()["ring"]) == [(-4, 3), (-1, 7), (7, 1), (4, -3), (-4, 3)] and tuple(df.first()["held"]) == (3, 4)


def test_quadkeys_make_each_tile_number_once(spark):
    df = spark.createDataFrame([(5.1, 52.0, 1.0), (-179.9, 0.0, 5.0), (3.0, -84.9, 0.001), (12.0, 12.0, 0.0)], "lon double, lat double, w double")
    lon, lat, w = F.col("lon"), F.col("lat"), F.col("w")
    box = tiles.bounding_quadkey(lon - w, lat - w, lon + w, lat + w, 12)
    got = df.select(tiles.quadkey_of("lon", "lat", 12).alias("key"), box.alias("box"), tiles.quadkey_of(lon - w, lat + w, 12).alias("a"), tiles.quadkey_of(lon + w, lat - w, 12).alias("b"), tiles.clamped(tiles.tile_x("lon", 12), 12).alias("x"), tiles.clamped(tiles.tile_y("lat", 12), 12).alias("y"))
    for r in got.collect():
        assert r["key"] == "".join(str((r["x"] >> k & 1) + 2 * (r["y"] >> k & 1)) for k in range(11, -1, -1))
        assert r["box"] == os.path.commonprefix([r["a"], r["b"]])
    assert mentions(df.select(box.alias("k")), "ASINH(") == 2


def test_geojson_is_read_once(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, -4.0)], "x double, y double")
    text = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(F.array("x", "y"), F.array("y", "x")).alias("coordinates")))
    boxes = df.select(lines.geojson_bbox(text).alias("b"))
    assert mentions(boxes, "get_json_object(") == 2
    assert [r["b"] for r in boxes.collect()] == [[1, 1, 2, 2], [-4, -4, 3, 3]]


def test_boxes_of_quadkeys_are_made_once(spark):
    df = spark.createDataFrame([("213",), ("0",)], "k string").select(tiles.quadkey_geojson("k").alias("g"))
    assert mentions(df, "SINH(") == 2
    assert [[round(v, 3) for v in r["b"]] for r in df.select(lines.geojson_bbox("g").alias("b")).collect()] == [[-45.0, -66.513, 0.0, -40.98], [-180.0, 0.0, 0.0, 85.051]]


def test_parallels_move_each_side_once(one):
    df = one.withColumn("x", F.col("id") * 1.0).withColumn("line", F.array(point("x", "x"), point(F.col("x") + 2, "x"), point(F.col("x") + 2, F.col("x") + 2)))
    moved = df.select(lines.parallel("line", 1.0).alias("l"))
    assert mentions(moved, "SQRT(") == 1
    assert vertices(moved.first()["l"]) == [(0, 1), (1, 1), (1, 2)]


def test_clipping_takes_many_segments_at_once(spark, monkeypatch):
    ring = [(20.0, 0.0), (40.0, 30.0), (0.0, 60.0), (-40.0, 30.0), (-20.0, 0.0), (20.0, 0.0)]
    long = np.array([((k * 37) % 3600 / 10 - 180, (k * 53) % 1600 / 10 - 80) for k in range(20_000)])
    singly = [p for a, b in zip(long[:-1], long[1:]) for p in wkb.clip_line(np.array([a, b]), ring)]
    calls, inside = [], wkb.inside
    monkeypatch.setattr(wkb, "inside", lambda *a: calls.append(1) or inside(*a))
    parts = wkb.clip_line(long, ring)
    assert len(calls) == 3
    segments = np.concatenate([np.stack([p[:-1], p[1:]], 1) for p in parts])
    assert len(parts) < len(singly) and np.array_equal(segments, np.array(singly))
    df = spark.createDataFrame([(1.0,), (None,)], "x double").select("x", F.when(F.col("x").isNotNull(), F.array(point("x", "x"), point(F.col("x") + 1, "x"))).alias("line"))
    made = df.select(wkb.line_wkb("line").alias("w"))
    assert mentions(made, "flatten(") == 1  # numbers go to Python, not a dict for each vertex
    assert [r["w"] and wkb.decode(bytes(r["w"]))[1][0].tolist() for r in made.collect()] == [[[1, 1], [2, 1]], None]
