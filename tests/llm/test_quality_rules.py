import math
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import oracles
from tidemark.llm import quality_rules as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics_like_brute_force(table, words):
    texts = [None, "", " \n", "a", "a a a a", "a b c a b c", "x y x y x y x", "# $ é ü <>", "l\nl\n \nl ", words(20000, 1), *[" ".join(words(40, k).split(" ")[: 5 + k] * (1 + k % 3)) for k in range(30)]]
    got = {r["doc_id"]: tuple(r)[2:] for r in Q.statistics(table(texts, extra=True)).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 5, 40, 700) for k in (0, 1, 3, 20) if k <= n for p in (0.0125, 0.05, 0.3)]
    for p in (0.0125, 0.05, 0.3):
        df = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long")
        for r in df.select("k", "n", Q.binomial_tail(F.col("k"), F.col("n"), p).alias("v")).collect():
            exact = sum(math.comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["k"] + 1))
            assert math.isclose(r["v"], 1.0 if r["k"] >= r["n"] * p else exact, rel_tol=1e-9)


def test_like_sql(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    rel = con.execute(oracles.oracle_sql()["op1_quality_rules"])
    names = [d[0] for d in rel.description]
    assert sorted(map(tuple, Q.judge(docs, labels).select(*names).collect())) == sorted(rel.fetchall())


def test_false_rejections_stay_within_alpha(spark, table, words):
    docs = table([words(80, k) + (" # # # # # # # # # #" if k % 97 == 0 else "") + ("\n" + words(80, -k).replace(" ", "$% ") if k % 4 == 1 else "") for k in range(1200)])
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 1, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    got = Q.judge(docs, labels).where("doc_id % 4 <> 1 and not base_failed")
    assert got.where("not kept").count() <= Q.ALPHA * got.count()
    bad = Q.judge(docs, labels).where("doc_id % 4 = 1 and not base_failed")
    assert bad.count() > 250 and bad.where("not kept").count() > 0.9 * bad.count()


def test_nulls_repeats_and_empty_tables(spark, table, words):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    docs = table([(1, words(60, 1)), (1, words(60, 1)), (None, None), (2, words(60, 2))]).withColumn("lang", F.when(F.col("doc_id") == 2, F.lit(None)).otherwise(F.col("lang")))
    got = Q.judge(docs, labels).collect()
    assert len(got) == 4 and sum(r["kept"] for r in got) == 3
    assert Q.judge(docs.limit(0), labels).count() == 0
    assert Q.judge(docs, labels.limit(0)).where("kept").count() == 3
