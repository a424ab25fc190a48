import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.planar import point
from tidemark.operators import grids, items, joins, partition, scan, series, typology, worklog
from tidemark.operators.cubes import RasterCube
from tidemark.sources import tables
from tidemark.streaming import worklog as stream


def boxes(spark, n, seed, size):
    rng = random.Random(seed)
    rows = [(k, *(x := (rng.uniform(-50, 50), rng.uniform(-50, 50))), x[0] + rng.uniform(0, size), x[1] + rng.uniform(0, size)) for k in range(n)]
    return rows, spark.createDataFrame(rows, f"id{seed} long, xmin double, ymin double, xmax double, ymax double")


@pytest.mark.parametrize("cell", [1.0, 5.0, 40.0])
def test_box_join_like_brute_force(spark, cell):
    (a, da), (b, db) = boxes(spark, 80, 1, 12), boxes(spark, 90, 2, 3)
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    got = [tuple(r)[:2] for r in joins.box_join(da, db, "id1", "id2", cell).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_like_brute_force(spark):
    rng = random.Random(4)
    a = [(k, rng.uniform(0, 50), rng.uniform(0, 50)) for k in range(60)]
    b = [(k, rng.uniform(0, 50), rng.uniform(0, 50)) for k in range(40)]
    got = {r["i"]: r["j"] for r in joins.nearest(spark.createDataFrame(a, "i long, x double, y double"), spark.createDataFrame(b, "j long, x double, y double"), "i", "j", 6.0).collect()}
    for i, x, y in a:
        d, j = min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in b)
        assert got[i] == (j if d <= 36 else None)


def test_nearest_among_copies(spark):
    """Copies of a place meet no row of a more than once: one join, no pairs; the smallest id wins, with its columns."""
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 90.0, 0.0), (4, None, 0.0)], "i long, x double, y double")
    b = spark.range(400).select((400 - F.col("id")).alias("j"), ((F.col("id") % 2) * 2 - 1.0).alias("x"), F.lit(0.0).alias("y"), F.concat(F.lit("n"), 400 - F.col("id")).alias("name"))
    found = joins.nearest(a, b, "i", "j", 6.0, ["name"])
    assert sorted(tuple(r) for r in found.select("i", "j", "distance", "name").collect()) == [(1, 1, 1.0, "n1"), (2, 1, 4.0, "n1"), (3, None, None, None), (4, None, None, None)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_counts_of_areas(spark):
    areas = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0), (3, None, None, None, None)], "a long, xmin double, ymin double, xmax double, ymax double")
    things = spark.createDataFrame([(k, 0.5, 0.5, 0.5, 0.5) for k in range(3)], "t long, xmin double, ymin double, xmax double, ymax double")
    assert {r["a"]: r["n"] for r in joins.count_within(areas, things, "a", "t").collect()} == {1: 3, 2: 0, 3: None}


def test_catalog_reads_only_the_files_it_needs(spark, tmp_path):
    rows = []
    for k in range(4):
        path = str(tmp_path / f"part{k}")
        df = spark.range(10).select(F.col("id"), F.struct(*[(F.lit(float(10 * k)) + F.col("id") + d).alias(c) for c, d in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 0.5), ("ymax", 0.5))]).alias("bbox"))
        df.write.parquet(path)
        rows.append((path, 10.0 * k, 10.0 * k, 10.0 * k + 9.5, 10.0 * k + 9.5))
    cat = scan.Catalog(spark, spark.createDataFrame(rows, "href string, xmin double, ymin double, xmax double, ymax double"), ("id", "bbox"))
    assert len(cat.files((12.0, 12.0, 15.0, 15.0))) == 1
    assert cat.fetch((12.0, 12.0, 15.0, 15.0)).count() == 4 and cat.fetch((12.0, 12.0, 15.0, 15.0), mode="within").count() == 2
    assert cat.fetch((500.0, 500.0, 501.0, 501.0)).count() == 0
    plan = cat.fetch((12.0, 12.0, 15.0, 15.0), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(bbox.xmin,15.0)" in plan
    with pytest.raises(ValueError, match="unknown columns"):
        cat.fetch((0.0, 0.0, 1.0, 1.0), ["nope"])
    many = spark.createDataFrame([(float(k), float(k), k + 0.1, k + 0.1) for k in range(1500)], "xmin double, ymin double, xmax double, ymax double")
    assert scan.matching_files(cat.items, many).count() == 4


def test_equal_size_parts_like_the_rule(spark):
    rng = random.Random(6)
    rows = [("ab"[k % 2], k, rng.randrange(1, 60)) for k in range(300)]
    want, held = {}, {}
    for g, k, s in rows:
        total, part = held.get(g, (0, 0))
        want[k] = part
        total += s
        held[g] = (0, part + 1) if total > 100 else (total, part)
    got = partition.equal_size(spark.createDataFrame(rows, "g string, k long, s long").repartition(4), "s", 100, ["k"], "g")
    assert {r["k"]: r["part"] for r in got.collect()} == want


def test_partition_writers(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("g"), F.lit(10).alias("s"))
    partition.write_equal_size(df, str(tmp_path / "a"), "s", 200, ["id"], "g")
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.count() == 100 and back.groupBy("g", "part").count().agg(F.max("count")).first()[0] == 21
    partition.write_ranges(df, str(tmp_path / "b"), "id", 10, 300)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 100


def test_worklog(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    log = worklog.create(ids)
    events = spark.createDataFrame([("a", 1, "Failed", "x", "t1", "B1"), ("a", 2, "Failed", "y", "t2", None), ("b", 1, "Failed", "x", "t1", "B2"), ("b", 2, "Success", "", "t3", "B1"), ("zz", 1, "Success", "", "t", None)], "id string, seq long, status string, message string, datetime string, band string")
    got = {r["id"]: r for r in worklog.merge(log, events).collect()}
    assert (got["a"]["status"], got["a"]["retries"], got["a"]["message"], got["a"]["bands"]) == ("Failed", 2, "y (retry count: 2)", ["B1"])
    assert (got["b"]["status"], got["b"]["retries"], got["b"]["bands"]) == ("Success", 0, ["B1", "B2"])
    assert got["c"]["status"] == "Pending" and len(got) == 3
    assert worklog.reset(worklog.merge(log, events), ["Failed"]).where("status = 'Pending'").count() == 2
    with pytest.raises(ValueError, match="missing"):
        worklog.validated(log, spark.createDataFrame([("q",)], "id string"))
    assert worklog.validated(log, spark.createDataFrame([("q",)], "id string"), True).count() == 4
    log = worklog.assign_priority(log, spark.createDataFrame([("a", 5), ("b", 9)], "id string, priority int"))
    assert [r["id"] for r in worklog.draw(log, 9).collect()] == ["b"] and worklog.to_process(log, min_priority=5).first()["n"] == 2
    assert [r["id"] for r in worklog.draw(log, 2, min_priority=0).collect()] == ["b", "a"]
    files = spark.createDataFrame([("s/a_B1.tif",), ("s/a_B2.tif",), ("s/b_B1.tif",), ("junk",)], "path string")
    found = worklog.from_files(files, r"(\w)_(B\d)\.tif")
    done = {r["id"]: (r["status"], r["message"]) for r in worklog.update_from_files(log, found, ["B1", "B2"]).collect()}
    assert done["a"] == ("Success", "All bands processed.") and done["b"] == ("Partly", "Missing bands: B2") and done["c"][0] == "Pending"


def test_json_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    worklog.append_json(spark, path, "tile", "Success")
    worklog.append_json(spark, path, "tile", "Failed", "why")
    (tmp_path / "log" / "bad.json").write_text("{not json\n")
    assert worklog.read_json(spark, path).count() == 2


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "log")
    events = spark.createDataFrame([("a", 1, "Failed", "x", "t1", "B1")], "id string, seq long, status string, message string, datetime string, band string")
    events.write.parquet(src)
    worklog.create(events.select("id")).write.parquet(f"{out}/v0")
    q = stream.keep_log(spark, spark.readStream.schema(events.schema).parquet(src), out, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(f"{out}/v1").first()["retries"] == 1
    rows = spark.createDataFrame([("k", "2024-01-03", 1.0), ("k", "2024-01-04", 3.0), ("k", "2024-01-20", 5.0)], "k string, t string, v double").select("k", F.to_timestamp("t").alias("t"), "v")
    rows.write.parquet(str(tmp_path / "ev"))
    q = stream.binned(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev")), "t", "k", "v").writeStream.format("memory").queryName("bins").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["n"], r["mean"]) for r in spark.table("bins").collect()) == [(1, 5.0), (2, 2.0)]


def test_admin_filters_and_priorities(spark):
    g = spark.createDataFrame([("1", ["EU"], ["NL"], 50.0, 51.0), ("2", ["EU"], ["NL", "RU"], 50.0, 51.0), ("3", ["EU"], ["NO"], 50.0, 51.0), ("4", ["AS"], [], 0.0, 1.0), ("5", ["AS"], ["RU"], 75.0, 76.0)], "grid_id string, continents array<string>, countries array<string>, ymin double, ymax double")
    ids = lambda df: {r["grid_id"] for r in df.collect()}
    assert ids(grids.filter_by_admins(g, include_continents=["EU"], include_countries=["NL", "NO"])) == {"1", "2", "3"}
    assert ids(grids.filter_by_admins(g, exclude_countries=["RU"])) == {"1", "2", "3"}
    assert {r["grid_id"]: r["p"] for r in g.select("grid_id", grids.priority().alias("p")).collect()} == {"1": 10, "2": 8, "3": 9, "4": 7, "5": 6}
    assert [r[0] for r in spark.createDataFrame([("['a', \"b\"]",), ("",), (None,)], "t string").select(grids.json_list("t")).collect()] == [["a", "b"], [], []]


def test_item_selection(spark):
    rows = [(k, f"2024-01-{1 + k % 28:02d}", float(k * 7 % 90), k % 3) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, d string, cloud_cover double, tile long").select("id", F.to_timestamp("d").alias("datetime"), "cloud_cover", "tile")
    got = items.select_items(df, ["tile"], most=12).collect()
    assert len(got) == 12 and [r["cloud_cover"] for r in got] == sorted(r["cloud_cover"] for r in got)
    per_bin = items.best_per_bin(df, "tile")
    assert per_bin.groupBy("tile", "time_bin").count().where("count > 1").count() == 0


def test_projection_moves_along_the_transect(spark):
    df = spark.createDataFrame([("a", 10.0, 32631), ("b", 1e6, 32631)], "transect_id string, change double, utm_epsg int")
    near = lambda dx: point(F.lit(3.0) + dx, F.lit(52.0))
    df = df.withColumns({"start": near(-0.01), "end": near(0.01), "reference": near(0.0)})
    got = {r["transect_id"]: r["geometry"] for r in series.project(df, "change").collect()}
    metres = 111_320 * np.cos(np.radians(52.0))
    assert (got["a"]["x"] - 3.0) * metres == pytest.approx(10.0, rel=0.01) and (got["b"]["x"] - 3.0) * metres == pytest.approx(5000, rel=0.01)
    ring = series.project(df.where("transect_id = 'a'"), "change", kind="rectangle").first()["geometry"]
    assert len(ring) == 5 and (max(p["y"] for p in ring) - min(p["y"] for p in ring)) * 111_260 == pytest.approx(100, rel=0.01)
    assert series.project(df, "change", kind="rectangle", extend_to=10.0).where("geometry is not null").count() == 0


def test_projection_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0, [1.0, 2.0, 3.0], []), (1.0, float("nan"), None, [4.0])], "ambient_change_mean double, ambient_change_std double, slr_retreat_samples array<double>, total_change_samples array<double>")
    a, b = series.projection_statistics(df).collect()
    assert a["slr_retreat_p50"] == 2.0 and a["total_change_p50"] is None and b["slr_retreat_p95"] == 0.0 and b["ambient_change_p5"] is None and b["total_change_p5"] == 4.0


def test_typology(spark):
    assert typology.encoding("class:coastal_type")["dune"] == 4 and typology.code_colours("class:has_defense")[1] == "#4D4D4D"
    assert typology.observed_encoding("class:shore_type", ["MUDDY_SEDIMENTS"]) == {"muddy_sediments": 0}
    df = spark.createDataFrame([("Dune",), ("nope",), (None,)], "`class:coastal_type` string")
    assert [r[0] for r in typology.with_codes(df, "class:coastal_type").collect()] == [4, None, None]
    assert typology.with_codes(df, "class:has_defense").columns == df.columns
    with pytest.raises(ValueError):
        typology.observed(df, ["not_there"])


def test_sources(spark, tmp_path):
    df = spark.range(5).select("id", F.struct(F.lit(0.0).alias("xmin"), F.lit(1.0).alias("ymin"), F.col("id").cast("double").alias("xmax"), F.lit(3.0).alias("ymax")).alias("bbox"), F.timestamp_seconds("id").alias("t"))
    path = str(tmp_path / "t")
    assert tables.write_parquet(df.limit(0), path) == 0
    n = tables.write_parquet(df, path)
    assert n > 0 and tables.write_parquet(df.limit(1), path, overwrite=False) == n
    back = spark.read.parquet(path)
    assert sum(r["row_count"] for r in tables.table_items(back, "bbox", "t").collect()) == 5
    assert tuple(tables.bounds(back).first()) == (0.0, 1.0, 4.0, 3.0)
    assert [c["name"] for c in tables.columns_of(df.schema)] == ["id", "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax", "t"]
    assert tables.delete(spark, path) and spark.read.parquet(path).count() == 5
    tables.delete(spark, path, confirmed=True)
    assert tables.size_of(spark, path) == 0
    items_ = spark.createDataFrame([("i", 1, {"a": "x"}), ("i", 2, {"a": "y", "b": "z"})], "id string, seq int, assets map<string,string>")
    assert tables.collate(items_).first()["assets"] == {"a": "y", "b": "z"}


def test_cube(spark):
    px = spark.createDataFrame([("i", 0, 0, 0.2, 0.6, 4), ("j", 0, 0, 0.4, 0.8, 9), ("far", 0, 0, 9.0, 9.0, 4)], "id string, y int, x int, red double, nir double, SCL int")
    its = spark.createDataFrame([("i", 0.0, 0.0, 1.0, 1.0), ("j", 0.0, 0.0, 1.0, 1.0), ("far", 50.0, 0.0, 51.0, 1.0)], "id string, xmin double, ymin double, xmax double, ymax double")
    cube = RasterCube(its, px, ("red", "nir")).search((0.0, 0.0, 2.0, 2.0))
    assert cube.load(["red"]).execute().columns == ["id", "y", "x", "red"] and cube.execute().count() == 2
    r = cube.mask_and_scale(mask_scene=[9]).composite("median").add_spectral_indices(["NDVI"]).execute().first()
    assert (r["red"], round(r["NDVI"], 6)) == (0.2, 0.5)
    with pytest.raises(ValueError):
        cube.load(["swir16"])
    with pytest.raises(ValueError):
        cube.composite("mode")
