import corpus_pipeline
from tidemark.llm import queries


def test_stages_keep_the_columns_and_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == names, name
        docs = out
    assert 0 < docs.count() < n
    assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_clean_documents_stay(spark, table, words):
    docs = table([words(120, k) for k in range(30)] + [words(120, 3), words(120, 4)])
    lang = corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert lang.count() == 32
    lines = corpus_pipeline.STAGES[1][1](spark, lang, "")
    near = corpus_pipeline.STAGES[2][1](spark, lines, "")
    rest = corpus_pipeline.STAGES[3][1](spark, near, "")
    got = {r["doc_id"]: r["text"] for r in rest.collect()}
    assert {k: got[k] for k in range(30)} == {k: words(120, k) for k in range(30)}


def test_planted_passages_go_and_clean_documents_stay(spark, table, words):
    passage = words(51, 99)
    texts = [words(120, k) for k in range(20)] + [f"{words(60, 100 + k)} {passage} {words(60, 200 + k)}" for k in range(6)]
    rest = corpus_pipeline.STAGES[3][1](spark, table(texts, extra=True), "")
    got = {r["doc_id"]: r["text"] for r in rest.collect()}
    assert {k: got[k] for k in range(20)} == dict(enumerate(texts[:20]))
    assert all(got[20 + k] == f"{words(60, 100 + k)}  {words(60, 200 + k)}" for k in range(6))


def test_empty_and_odd_tables(spark, table, words, tmp_path):
    """No document: no piece.  Texts without a letter are rejected; of equal lines the first stays, so a copy is left empty and goes as a near-duplicate of an empty text."""
    prose = words(80, 1)
    for k, (docs, ids) in enumerate(((table([]), set()), (table([None, "", "12 34"]), set()), (table([None, (1, prose), (2, prose), (1, prose), (4, prose + " x"), (None, prose)], extra=True), None))):
        d = str(tmp_path / str(k))
        docs.write.parquet(f"{d}/documents.parquet")
        rows = corpus_pipeline.run(spark, d).collect()
        found = {r["doc_id"] for r in rows}
        assert found == ids if ids is not None else 1 <= sum(r["length"] > 1 for r in rows) <= 2


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
