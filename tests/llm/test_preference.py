import duckdb
from tidemark.llm import oracles, preference as P

TURNS = "conv_id long, turn long, role string, text string"


def rows(spark, turns):
    return {r["pair_id"]: r.asDict(recursive=True) for r in P.preference_pairs(spark.createDataFrame(turns, TURNS)).collect()}


def test_prefix_prompt_and_masks(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "oh")]
    r = rows(spark, turns)[0]
    assert r["n_common"] == 1 and r["prompt"] == "<|user|>\nhi<|end|>\n" and r["usable"]
    for side, learned in (("chosen", "yes<|end|>\n"), ("rejected", "no<|end|>\n")):
        assert [r[side][s["start"] : s["end"]] for s in r[f"{side}_spans"]] == [learned]


def test_edge_cases(spark):
    turns = [
        (2, 0, None, None), (3, 0, "", ""), (3, 1, "assistant", "x"),  # prefix of the other; nulls are empty
        (4, 0, "user", "alone"),
        (7, 5, "user", "only the rejected one"),
        (None, 0, "user", "no conversation"),
        (8, 0, "user", "q"), (8, 0, "user", "q"), (8, 1, "assistant", "é" * 50000), (9, 0, "user", "q"), (9, None, "system", "first"),
    ]
    r = rows(spark, turns)
    assert set(r) == {1, 2, 3, 4}
    assert (r[1]["n_common"], r[1]["chosen"], r[1]["usable"]) == (1, "", False)
    assert (r[2]["prompt"], r[2]["rejected"], r[2]["rejected_spans"], r[2]["usable"]) == ("", None, None, False)
    assert r[3]["chosen"] is None and r[3]["rejected"].startswith("<|user|>")
    assert r[4]["n_common"] == 0 and r[4]["rejected"].startswith("<|system|>")
    assert len(r[4]["chosen"]) > 50000
    assert rows(spark, []) == {}


def test_like_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    rel = con.execute(oracles.oracle_sql()["op4_preference_format"])
    names = [d[0] for d in rel.description]
    df = P.preference_pairs(spark.read.parquet(f"{data}/conversations.parquet"))
    df = df.withColumns({c: P.as_text(c) for c in ("chosen_spans", "rejected_spans")})
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(rel.fetchall(), key=str)
