"""Queries over tables whose ids go beyond those of the smallest scale."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.plans import fixtures as fx

QUERIES, _ = plans.load()


@pytest.fixture(scope="module")
def customers(spark, data, tmp_path_factory):
    """Folder with 900 customers, and the given nations and regions."""
    d = str(tmp_path_factory.mktemp("customers"))
    for name in ("nation", "region"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    c = spark.range(1, 901).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("A").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"))
    c.write.parquet(f"{d}/customer.parquet")
    return d


def test_lines_have_every_customer(spark, customers):
    names = {r["n_nationkey"]: r["n_name"] for r in spark.read.parquet(f"{customers}/nation.parquet").collect()}
    want = defaultdict(list)
    for k in range(1, 901):
        want[names[k % 25]].append(((k * 37) % 3600 / 10 - 180, (k * 53) % 1600 / 10 - 80))
    got = {r["country"]: [tuple(p) for p in r["line"]] for r in fx.lines(spark, customers).collect()}
    assert got == want
    lengths = {r["country"]: r["length"] for r in QUERIES["line_shapes"](spark, customers).collect()}
    assert lengths == {n: pytest.approx(sum(math.dist(a, b) for a, b in zip(v, v[1:])), abs=1e-5) for n, v in want.items()}
    assert QUERIES["clip_lines"](spark, customers).count() > 0
