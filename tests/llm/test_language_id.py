import math
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm import language_id as L


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = L.identify(docs, L.train(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_neither_lang_nor_id_is_an_input(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = L.train(docs)
    other = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    a = {r["doc_id"] + 1000: r["lang_pred"] for r in L.identify(docs, model).collect()}
    assert a == {r["doc_id"]: r["lang_pred"] for r in L.identify(other, model).collect()}


def test_strange_texts_are_rejected_and_clean_ones_kept(spark, data, table):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = L.train(docs)
    assert L.accepted(docs, model).count() == docs.count()
    strange = table([None, "", "12 34 !!", "съешь же ещё этих мягких французских булок да выпей чаю " * 30, "日本語の文章をここに書きます。" * 60], extra=True)
    assert [tuple(r)[2:] for r in L.identify(strange, model).orderBy("doc_id").limit(3).collect()] == [("und", 0.0, True)] * 3
    out = L.accepted(strange, model)
    assert out.columns == strange.columns and out.count() == 0


def test_no_training_rows_repeats_nulls_and_an_empty_table(table, words):
    none = L.train(table([]))
    assert [r["lang_pred"] for r in L.identify(table(["some text"]), none).collect()] == ["und"]
    docs = table([(k // 2, words(50, k // 2)) for k in range(40)] + [(None, "some words"), (77, words(30000, 3))])
    model = L.train(docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("lang"))))
    got = L.identify(docs, model)
    assert {r["lang_pred"] for r in got.collect()} == {"en"}
    assert got.where("doc_id is null").first()["held_out"] is None
    assert L.identify(table([]), model).count() == 0


def test_predictions_like_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = L.train(docs)
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    for r in docs.limit(60).collect():
        b = (" " + " ".join(re.findall(r"[^\W\d_]+", (r["text"] or "").lower())) + " ").encode()
        n = {}
        for k in range(len(b) - 1):
            two = (b[k] * 257 + b[k + 1]) % 2**32
            slots = [(two * 2654435761 % 2**32) >> 20]
            if k + 2 < len(b):
                slots.append(((two * 65599 + b[k + 2]) * 2246822519 % 2**32) >> 20)
            for s in slots:
                n[s] = n.get(s, 0) + 1
        v = {s: math.log1p(c) * float(model.idf[s]) for s, c in n.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[s]) for s, x in v.items()) / size for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[r["doc_id"]]["lang_pred"] == model.languages[model.owner[best]] and abs(got[r["doc_id"]]["score"] - cosines[best]) < 1e-4


def test_numbers_are_no_letters(table):
    model = L.train(table(["some words here", "more words there"]))
    texts = ["½ ²", "①", "Ⅷ", "一", "ª", "_ 12"]
    got = [r["lang_pred"] for r in L.identify(table(texts), model).orderBy("doc_id").collect()]
    assert got == ["und", "und", "und", "en", "en", "und"]


def test_repeated_ids_train_once(table, words):
    docs = table([(1, words(40, k)) for k in range(5)] + [(k, words(40, 50 + k)) for k in range(2, 9)])
    a, b = L.train(docs.repartition(6)), L.train(docs.repartition(1))
    assert (a.centroids == b.centroids).all() and (a.bounds == b.bounds).all()
