import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import chips, crs, metrics, names, planar, raster, tiles, wkb
from tidemark.functions.names import PathParts, size_to_bytes
from tidemark.functions.planar import point
from tidemark.functions.samples import array_quantile, normal_bounds
from tidemark.functions.trends import ols


def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


def line(*points):
    return F.array(*[point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


# planar


def test_shift_point_and_bearings(spark):
    a, b = point(F.lit(0.0), F.lit(0.0)), point(F.lit(3.0), F.lit(4.0))
    assert one(spark, planar.shift_point(a, b, 2.5)) == (1.5, 2.0)
    assert one(spark, planar.shift_point(a, b, 99)) == (3.0, 4.0)
    assert one(spark, planar.shift_point(a, b, -5)) == (-3.0, -4.0)
    assert one(spark, planar.shift_point(a, a, 2)) == (0.0, 0.0)
    north, west = point(F.lit(0.0), F.lit(2.0)), point(F.lit(-1.0), F.lit(0.0))
    assert one(spark, planar.bearing(a, north), planar.bearing(a, west)) == (0.0, 270.0)


@pytest.mark.parametrize(
    "axis,angles",
    [("closest", (30, 30, 30, -30)), ("vertical", (30, 120, -60, -30)), ("horizontal", (-60, 30, -60, 60)), ("horizontal-right-aligned", (120, -150, -60, 60))],
)
def test_rotation_angles(spark, axis, angles):
    a = point(F.lit(0.0), F.lit(0.0))
    for t, want in zip((30, 120, 210, 330), angles, strict=True):
        b = point(F.lit(math.sin(math.radians(t))), F.lit(math.cos(math.radians(t))))
        assert one(spark, planar.rotation_angle(a, b, axis)) == pytest.approx(want)
    assert one(spark, planar.rotation_angle(a, point(F.lit(0.0), F.lit(9.0)), axis)) == 0
    with pytest.raises(ValueError):
        planar.rotation_angle(a, a, "sideways")


def test_lines(spark):
    l = line((0, 0), (3, 4), (3, 10))
    assert one(spark, planar.length(l), planar.is_closed(l)) == (11.0, False)
    assert one(spark, planar.sinuosity(l)) == pytest.approx(11 / math.hypot(3, 10))
    assert one(spark, planar.sinuosity(line((0, 0), (1, 1), (0, 0)))) is None
    assert one(spark, planar.interpolate(l, F.lit(6.0))) == (3.0, 5.0)
    assert one(spark, planar.interpolate(l, F.lit(-1.0)), planar.interpolate(l, F.lit(50.0))) == ((0.0, 0.0), (3.0, 10.0))
    assert one(spark, planar.crosses_antimeridian(line((179, 0), (-179, 0))), planar.crosses_antimeridian(l)) == (True, False)
    ring = planar.offset_rectangle(point(F.lit(0.0), F.lit(0.0)), point(F.lit(10.0), F.lit(0.0)), 2.0)
    assert one(spark, planar.area(ring), planar.centroid(ring)) == (40.0, (5.0, 0.0))
    assert one(spark, planar.offset_rectangle(point(F.lit(0.0), F.lit(0.0)), point(F.lit(0.0), F.lit(0.0)), 2.0))[0][0] is None


def test_extension(spark):
    l = line((0, 0), (10, 0))
    assert one(spark, planar.extend_transect(l, 20.0)) == [(-5.0, 0.0), (15.0, 0.0)]
    assert one(spark, planar.extend_transect(l, 20.0, "end")) == [(0.0, 0.0), (15.0, 0.0)]
    with pytest.raises(Exception, match="only be extended"):
        one(spark, planar.extend_transect(l, 5.0))


@pytest.mark.parametrize("total,want", [(1000.0, 9), (1060.0, 10), (140.0, 1), (120.0, 1), (40.0, 0)])
def test_transect_origins(spark, total, want):
    got = one(spark, planar.transect_origins(F.lit(total), 100.0))
    assert len(got) == want
    if want > 1:
        assert got[0] == pytest.approx((total - want * 100) / 2)


# reference systems


def test_utm_against_known_places_and_back(spark):
    # central meridian and the equator; a place in zone 31 worked out by series of another kind
    x, y = one(spark, crs.utm(F.lit(3.0), F.lit(0.0), F.lit(32631)))
    assert (round(x, 6), round(y, 6)) == (500000.0, 0.0)
    a, e2 = crs.SEMI_MAJOR, crs.FLATTENING * (2 - crs.FLATTENING)
    steps = np.linspace(0, math.radians(52), 20001)
    meridian = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5, steps) * crs.SCALE
    assert one(spark, crs.utm(F.lit(3.0), F.lit(52.0), F.lit(32631)))[1] == pytest.approx(meridian, abs=1e-2)
    df = spark.createDataFrame([(lon, lat) for lon in (-179.5, -60.2, 3.0, 5.9, 120.7) for lat in (-79.0, -33.3, -0.1, 12.0, 51.99, 83.0)], "lon double, lat double")
    df = df.withColumn("epsg", crs.utm_epsg("lon", "lat")).withColumn("p", crs.utm("lon", "lat", "epsg"))
    for r in df.select("lon", "lat", crs.utm_inverse(F.col("p.x"), F.col("p.y"), "epsg").alias("g")).collect():
        assert r["g"] == pytest.approx((r["lon"], r["lat"]), abs=1e-9)


def test_mercator_and_zones(spark):
    p = crs.mercator(F.lit(180.0), F.lit(85.0511287798066))
    assert one(spark, p) == pytest.approx((20037508.342789244, 20037508.34278925))
    assert one(spark, crs.mercator_inverse(p["x"], p["y"])) == pytest.approx((180.0, 85.0511287798066))
    assert one(spark, crs.utm_zone(F.lit(-180.0)), crs.utm_zone(F.lit(179.9)), crs.utm_zone(F.lit(180.0))) == (1, 60, 1)
    assert one(spark, crs.epsg_of_mgrs(F.lit("31UFU")), crs.epsg_of_mgrs(F.lit("18HYD")), crs.epsg_of_mgrs(F.lit("31"))) == (32631, 32718, None)


def test_azimuth(spark):
    az = lambda *v: one(spark, crs.azimuth(*[F.lit(float(x)) for x in v]))
    assert az(0, 0, 0, 10) == pytest.approx(0) and az(0, 0, 10, 0) == pytest.approx(90) and az(5, 50, 5, 40) == pytest.approx(180)
    assert az(1, 1, 1, 1) is None


# tiles


def test_tiles(spark):
    q = tiles.quadkey(F.lit(3).cast("bigint"), F.lit(5).cast("bigint"), 3)
    assert one(spark, q) == "213"
    assert tuple(one(spark, tiles.tile_of_quadkey(F.lit("213")))) == (3, 5, 3)
    b = one(spark, tiles.quadkey_box(F.lit("0")))
    assert (b["xmin"], b["xmax"], round(b["ymin"], 9)) == (-180.0, 0.0, 0.0) and b["ymax"] == pytest.approx(85.0511287798)
    assert one(spark, tiles.quadkey_of(F.lit(180.0), F.lit(-89.9), 2)) == "33"
    assert one(spark, tiles.bounding_quadkey(F.lit(-1.0), F.lit(-1.0), F.lit(1.0), F.lit(1.0), 5)) == ""
    assert tiles.all_tiles(spark, 3).select("quadkey").distinct().count() == 64
    assert len(one(spark, tiles.covering_tiles(F.lit(-1.0), F.lit(-1.0), F.lit(1.0), F.lit(1.0), 4))) == 4


# names


def test_paths():
    p = PathParts.parse("az://tmp/s2-l2a-composite/release/2025-01-17/file.tif")
    assert (p.bucket, p.key, p.filename) == ("tmp", "s2-l2a-composite/release/2025-01-17", "file.tif")
    assert p.uri() == "az://tmp/s2-l2a-composite/release/2025-01-17/file.tif"
    with pytest.raises(ValueError):
        p.url()
    url = p.with_(account="acc").url()
    assert PathParts.parse(url).url() == url and PathParts.parse(url).key == p.key
    assert PathParts.parse("az://tmp/file.tif").key == ""
    assert PathParts.parse("https://acc.blob.core.windows.net/tmp/file.tif").key == ""
    assert p.with_(band="nir").filename == "file_nir.tif" and p.with_(band="nir", resolution="10m").filename == "file_nir_10m.tif"
    local = PathParts.parse("/data/release/file.tif")
    assert (local.protocol, local.filename, local.bucket, local.local()) == ("file", "file.tif", "", "/data/release/file.tif")
    with pytest.raises(ValueError):
        local.uri()
    assert local.with_(protocol="az", bucket="b", key="k").uri() == "az://b/k/file.tif"
    with pytest.raises(ValueError):
        PathParts.parse("ftp://host/file.tif")


def test_sizes(spark):
    assert (size_to_bytes("5GB"), size_to_bytes(7.9), size_to_bytes(" 1.5 kb ")) == (5368709120, 7, 1536)
    for bad in ("5b", "x GB", ""):
        with pytest.raises(ValueError):
            size_to_bytes(bad)
    assert one(spark, names.readable_bytes(F.lit(5368709120)), names.readable_bytes(F.lit(0)), names.readable_bytes(F.lit(-1))) == ("5.00 GB", "0.00 B", None)
    assert one(spark, names.bytes_of(F.lit("2MB")), names.bytes_of(F.lit("nonsense"))) == (2097152, None)


def test_names(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, names.bounds_name(*lit(123.2, 45.4))) == "n45e123"
    assert one(spark, names.bounds_name(*lit(-5.0, -5.0))) == "s05w005"
    assert one(spark, names.bounds_name_with_hash(*lit(5, -3, 6, -2))).startswith("s03e05-")
    assert one(spark, names.signed(F.lit("az://b/k.parquet"), "acc", "sv=1")) == "https://acc.blob.core.windows.net/b/k.parquet?sv=1"
    assert one(spark, names.signed(F.lit("https://h/x?y=1"), token="sv=1"), names.signed(F.lit("s3://h/x"))) == ("https://h/x?y=1&sv=1", None)
    assert one(spark, names.zero_padded_ids(F.lit("cl5s0tr9"), (F.lit(3), F.lit(2), F.lit(4)))) == "cl005s00tr0009"


# statistics


def test_ols_like_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(1990, 2020, 40).astype(float)
    y = 0.3 * x + rng.normal(size=40)
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)] + [("few", 1.0, 2.0), ("few", 2.0, 3.0), *[("flat", 5.0, v) for v in (1.0, 2.0, 6.0)], *[("level", v, 4.0) for v in (1.0, 2.0, 6.0)]], "g string, x double, y double")
    got = {r["g"]: r for r in df.groupBy("g").agg(*[c.alias(k) for k, c in ols("x", "y").items()]).collect()}
    slope, icpt = np.polyfit(x - 2000, y, 1)
    assert got["a"]["slope"] == pytest.approx(slope) and got["a"]["intercept"] == pytest.approx(icpt - 2000 * slope)
    rest = y - (icpt + slope * (x - 2000))
    assert got["a"]["slope_se"] == pytest.approx(math.sqrt((rest**2).sum() / 38 / ((x - x.mean()) ** 2).sum()))
    assert got["a"]["r_squared"] == pytest.approx(1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["few"]["slope"] is None and (got["flat"]["slope"], got["flat"]["intercept"], got["flat"]["slope_se"]) == (0.0, 3.0, None)
    assert got["level"]["slope"] == 0.0 and got["level"]["r_squared"] is None


def test_quantiles(spark):
    v = F.array(*[F.lit(float(x)) for x in (5, 1, 4, 2, 3)])
    assert one(spark, array_quantile(v, 0.05), array_quantile(v, 0.5)) == (1.2, 3.0)
    assert one(spark, array_quantile(F.array().cast("array<double>"), 0.5)) is None
    assert one(spark, *normal_bounds(F.lit(1.0), F.lit(2.0))) == pytest.approx((1 - 3.2897072539, 1 + 3.2897072539))
    assert one(spark, *normal_bounds(F.lit(1.0), F.lit(float("nan")))) == (None, None)


def test_metrics_like_numpy(spark):
    rng = np.random.default_rng(3)
    a, p = rng.normal(10, 3, 50), rng.normal(10, 3, 50)
    df = spark.createDataFrame([("g", k, float(x), float(y)) for k, (x, y) in enumerate(zip(a, p))] + [("g", 99, None, 1.0), ("g", 98, float("nan"), 1.0), ("zero", 1, 1.0, 1.0), ("zero", 2, 2.0, 3.0)], "g string, t int, a double, p double")
    chosen = [*metrics.metrics(), "no_such_metric"]
    got = {r["g"]: r for r in metrics.evaluate(df, "a", "p", ["g"], ["t"], chosen).collect()}
    e, eps = a - p, metrics.EPSILON
    pe = e / (a + eps)
    naive = a[1:] - a[:-1]
    rel = e[1:] / (naive + eps)
    bnd = np.abs(e[1:]) / (np.abs(e[1:]) + np.abs(naive) + eps)
    want = {
        "mse": (e**2).mean(), "nrmse": math.sqrt((e**2).mean()) / np.ptp(a), "mae": np.abs(e).mean(), "gmae": np.exp(np.log(np.abs(e)).mean()), "mdae": np.median(np.abs(e)), "mape": np.abs(pe).mean(),
        "smape": (2 * np.abs(e) / (np.abs(a) + np.abs(p) + eps)).mean(), "maape": np.arctan(np.abs(pe)).mean(), "mase": np.abs(e).mean() / np.abs(naive).mean(), "std_ae": math.sqrt(((e - np.abs(e).mean()) ** 2).sum() / 49),
        "rmdspe": math.sqrt(np.median(pe**2)), "rmsse": math.sqrt(((np.abs(e) / np.abs(naive).mean()) ** 2).mean()), "rrse": math.sqrt((e**2).sum() / ((a - a.mean()) ** 2).sum()), "rae": np.abs(e).sum() / (np.abs(a - a.mean()).sum() + eps),
        "mre": rel.mean(), "gmrae": np.exp(np.log(np.abs(rel)).mean()), "mbrae": bnd.mean(), "umbrae": bnd.mean() / (1 - bnd.mean()), "mda": (np.sign(np.diff(a)) == np.sign(np.diff(p))).mean(),
    }
    for k, v in want.items():
        assert got["g"][k] == pytest.approx(v), k
    assert got["g"]["no_such_metric"] is None and got["zero"]["gmae"] == 0.0


# pixels


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(0, 0, 1.0, 10.0, 0), (0, 1, 2.0, 20.0, 4), (0, 2, 3.0, 30.0, 6), (1, 0, 4.0, 40.0, 9), (1, 1, 5.0, 50.0, 10), (1, 2, -999.0, 60.0, 11)]
    return spark.createDataFrame(rows, "x int, y int, var1 double, var2 double, SCL int")


def cells(df, mask):
    return {(r["x"], r["y"]) for r in df.where(mask).collect()}


def test_masks(cube, spark):
    assert cells(cube, raster.nodata_mask("var1", -999)) == {(1, 2)} and not cells(cube, raster.nodata_mask("var2"))
    assert cells(cube, raster.numeric_mask("var1", [5, 30, 60])) == {(1, 1)} and cells(cube, raster.numeric_mask("var2", [5, 30, 60])) == {(0, 2), (1, 2)}
    assert cells(cube, raster.scene_mask(["Vegetation", 11])) == {(0, 1), (1, 2)}
    got = {(r["x"], r["y"]): r["v"] for r in cube.select("x", "y", raster.masked("var1", raster.nodata_mask("var1", -999)).alias("v")).collect()}
    assert got[1, 2] is None and got[0, 0] == 1.0
    with pytest.raises(ValueError):
        raster.scene_code("fog")
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,)], "v double")
    assert odd.where(raster.nodata_mask("v")).count() == 3


def test_scaling(spark):
    df = spark.createDataFrame([(0.25,), (0.00005,), (None,), (9.0,)], "v double")
    assert [r[0] for r in df.select(raster.scaled("v", 10000, nodata=-1)).collect()] == [2500, 0, -1, -1]
    assert one(spark, raster.unscaled(F.lit(2500), 0.0001)) == pytest.approx(0.25)
    s = raster.band_statistics("nir")
    assert one(spark, raster.scaler("min_max", F.lit(99999), s), raster.scaler("robust_min_max", F.lit(3750), s)) == (1.0, 0.5)
    with pytest.raises(ValueError):
        raster.scaler("standard", "v", {"mean": 1.0})


def test_indices(spark):
    df = spark.createDataFrame([(1000.0, 3000.0), (0.0, 0.0), (None, 1.0)], "red double, nir double")
    assert [r["NDVI"] for r in raster.with_indices(df, "NDVI").collect()] == [pytest.approx(0.5), None, None]
    with pytest.raises(ValueError, match="missing bands"):
        raster.with_indices(df, "NDWI")
    with pytest.raises(ValueError, match="unknown"):
        raster.with_indices(df, "XYZ")
    assert len(raster.INDICES) == 29


def test_composites_combine_and_otsu(spark):
    nan = float("nan")
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, nan)], "y int, x int, b double")
    b = spark.createDataFrame([(0, 0, 5.0), (0, 1, 7.0), (0, 2, None)], "y int, x int, b double")
    got = {r["x"]: r["b"] for r in raster.combine_first([a, b], ["b"]).collect()}
    assert got == {0: 1.0, 1: 7.0, 2: None}
    both = a.unionByName(b)
    assert {r["x"]: r["b"] for r in raster.composite_median(both, ["b"]).collect()} == {0: 3.0, 1: 7.0, 2: None}
    assert {r["x"]: r["b"] for r in raster.composite_percentile(both, ["b"], 50).collect()} == {0: 3.0, 1: None, 2: None}
    with pytest.raises(ValueError):
        raster.combine_first([], ["b"])
    rng = np.random.default_rng(0)
    two = spark.createDataFrame([("a", float(v)) for v in np.r_[rng.normal(0, 0.1, 300), rng.normal(1, 0.1, 300)]] + [("flat", 2.0), ("flat", 2.0), ("flat", None)], "g string, v double")
    t = {r["g"]: r["threshold"] for r in raster.otsu(two, "v", ["g"]).collect()}
    assert 0.3 < t["a"] < 0.7 and t["flat"] == 2.0


# kernels


def test_wkb_round_trip_and_byte_order():
    import struct

    ring = np.array([[0, 0], [4, 0], [4, 4], [0, 0]], float)
    for kind, parts in ((wkb.POINT, [np.array([[1.0, 2.0]])]), (wkb.LINE, [ring]), (wkb.POLYGON, [ring, ring / 2]), (wkb.MULTI_LINE, [(wkb.LINE, [ring])])):
        k, p = wkb.decode(wkb.encode(kind, parts))
        assert k == kind and len(p) == len(parts)
    big = struct.pack(">BIdd", 0, 1, 3.0, 4.0)
    assert wkb.decode(big)[1][0].tolist() == [[3.0, 4.0]]


def test_predicates_and_clipping():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], float)
    hole = np.array([[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]], float)
    pts = np.array([[0.5, 0.5], [1.5, 1.5], [5, 5], [4, 2], [0, 0]], float)
    assert wkb.inside(pts, [square, hole]).tolist() == [True, False, False, True, True]
    assert wkb.meets(wkb.LINE, [np.array([[-1.0, 2], [5, 2]])], [square]) and not wkb.meets(wkb.LINE, [np.array([[5.0, 0], [6, 9]])], [square])
    assert wkb.meets(wkb.POLYGON, [square * 10 - 15], [square])
    parts = wkb.clip_line(np.array([[-1.0, 1], [5, 1], [5, 3], [-1, 3]]), square)
    assert [p.tolist() for p in parts] == [[[0, 1], [4, 1]], [[4, 3], [0, 3]]]
    assert wkb.crossings(np.array([[0.0, 0], [4, 4], [4, 0], [0, 4]])) == 1 and wkb.crossings(square) == 0
    assert wkb.simplify(np.array([[0.0, 0], [1, 0.01], [2, 0], [3, 5]]), 0.1).tolist() == [[0, 0], [2, 0], [3, 5]]
    chain = wkb.merge_lines([np.array([[0.0, 0], [1, 0]]), np.array([[2.0, 0], [1, 0]]), np.array([[5.0, 5], [6, 6]])])
    assert sorted(len(c) for c in chain) == [2, 3]


def test_chips():
    chip = np.arange(16.0).reshape(4, 4)
    assert np.array_equal(chips.rotate(chip, 0), chip) and np.allclose(chips.rotate(chip, 90), np.rot90(chip)) or np.allclose(chips.rotate(chip, 90), np.rot90(chip, -1))
    assert np.allclose(chips.resize(chip, 4, 4, "cubic"), chip) and np.allclose(chips.resize(chip, 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    mask = np.zeros((8, 8), bool)
    mask[1:4, 1:4] = True
    mask[6, 6] = True
    assert np.array_equal(chips.opened(mask, 3), mask & (np.arange(8) < 5)) and chips.without_small(mask, 4).sum() == 9
    (ring,) = chips.contours(np.pad(np.ones((2, 2)), 2), 0.5)
    assert np.array_equal(ring[0], ring[-1]) and len(ring) == 9
    assert np.isnan(chips.window_std(np.full((3, 3), np.nan))).sum() == 0
