"""The builder's query composites every chip."""

from collections import defaultdict
from statistics import median

from tidemark import plans
from tidemark.plans import fixtures as fx


def test_composite_of_every_chip(spark, data):
    red, nir = defaultdict(list), defaultdict(list)
    ids = set()
    for r in fx.pixels(spark, data).collect():
        ids.add(r["cube_id"])
        if r["SCL"] not in (8, 9):
            red[r["y"], r["x"]].append(r["red"])
            nir[r["y"], r["x"]].append(r["nir"])
    assert max(ids) >= 100
    got = {(r["y"], r["x"]): (r["red"], r["NDVI"]) for r in plans.load()[0]["cube_pipeline"](spark, data).collect()}
    assert got.keys() == red.keys()
    for k in red:
        a, b = median(red[k]), median(nir[k])
        assert abs(got[k][0] - a * 10000) <= 0.51 and abs(got[k][1] - (b - a) / (b + a) * 10000) <= 0.51
