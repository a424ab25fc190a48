
from __future__ import annotations

import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidemark.functions import tiles as tl  # noqa: E402
from tidemark.functions.planar import point  # noqa: E402
from tidemark.functions.wkb import intersects_polygon, line_wkb  # noqa: E402
from tidemark.operators.scan import Catalog  # noqa: E402
from tidemark.plans import fixtures as fx  # noqa: E402
from tidemark.session import session  # noqa: E402

BOX = (-3.4, 43.2, 8.0, 52.0)
RING = ((-3.4, 43.2), (8.0, 43.2), (8.0, 52.0), (-3.4, 52.0))


def main(runs: int = 20, parts: int = 16) -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("retrieval", f"local[{os.environ.get('BENCH_CPUS', '4')}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    t = fx.transects(spark, d).withColumns({"bbox": F.struct("xmin", "ymin", "xmax", "ymax"), "geometry": line_wkb(F.array(point("xmin", "ymin"), point("xmax", "ymax"))), "quadkey": tl.quadkey_of("lon", "lat", 12)})
    t = t.drop("xmin", "ymin", "xmax", "ymax")
    with tempfile.TemporaryDirectory() as folder:
        t.repartition(parts, F.xxhash64("id")).write.parquet(f"{folder}/unsorted")
        t.repartitionByRange(parts, "quadkey").sortWithinPartitions("quadkey").write.parquet(f"{folder}/sorted")
        files = spark.read.parquet(f"{folder}/sorted").groupBy(F.input_file_name().alias("href")).agg(*[f(f"bbox.{c}").alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))])
        catalog = Catalog(spark, spark.createDataFrame(files.collect(), files.schema))
        plain = Catalog(spark, catalog.items.withColumns({"xmin": F.lit(-180.0), "ymin": F.lit(-90.0), "xmax": F.lit(180.0), "ymax": F.lit(90.0)}))
        refine = intersects_polygon(RING)
        cases = {
            "full scan + refine, unsorted": lambda: spark.read.parquet(f"{folder}/unsorted").where(refine("geometry")),
            "full scan + refine, quadkey-sorted": lambda: spark.read.parquet(f"{folder}/sorted").where(refine("geometry")),
            "bbox pushdown, quadkey-sorted": lambda: plain.fetch(BOX),
            "bbox pushdown + file pruning, quadkey-sorted": lambda: catalog.fetch(BOX),
        }
        for name, case in cases.items():
            took = []
            for _ in range(runs + 1):
                start = time.time()
                n = len(case().collect())
                took.append(time.time() - start)
            print(f"| {name} | {statistics.mean(took[1:]):.3f} ± {statistics.stdev(took[1:]):.3f} s, {n} rows | N={runs}, {os.path.basename(d)} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
