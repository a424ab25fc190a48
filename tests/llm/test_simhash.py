import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash, suffix_dedup
from tidemark.llm.components import connected


def plain_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, links):
    up = {x: x for x in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in ids}


def brute(prints, distance=4):
    ids = sorted(prints)
    return components(ids, [(a, b) for a, b in combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= distance])


def test_like_brute_force(table, words):
    rng = random.Random(2)
    texts = [None, "", "\n", "One", "one", "ÀÉ One two", "a b c", "A B C", " x\x1cy z"]
    for k in range(40):
        base = words(rng.choice((5, 40, 400)), k).split(" ")
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = "zz"
            texts.append(" ".join(base))
    texts.append(words(60000, 99))
    prints = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    of = brute(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(texts, extra=True)).collect()}
    assert got == {k: (f"{prints[k]:016x}", of[k]) for k in prints}
    assert len(set(of.values())) < len(of)


@pytest.mark.parametrize("block", [7, 8192])
@pytest.mark.parametrize("nodes", [300, 1 << 24, 1 << 30])
def test_no_link_is_lost(spark, block, nodes, monkeypatch):
    rng = random.Random(block + nodes)
    prints = {}
    for k in range(300):
        x = rng.getrandbits(64) if k % 3 == 0 or not prints else prints[rng.choice(list(prints))]
        for b in rng.sample(range(64), rng.randrange(6) if k % 3 else 0):
            x ^= 1 << b
        if x not in prints.values():
            prints[k] = x
    for k in range(400, 460):  # a crowd that shares its lowest segments
        prints[k] = (rng.getrandbits(16) << 48) | 0x1234
    prints = dict({v: k for k, v in reversed(prints.items())}.items())
    prints = {k: v for v, k in prints.items()}
    segments = simhash.layout(nodes, 4)
    monkeypatch.setattr(simhash, "layout", lambda *_: segments)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in prints.items()], "fp long, node long")
    found = {r["node"]: r["component"] for r in connected(simhash.near_links(df, 4, block)).collect()}
    assert {k: found.get(k, k) for k in prints} == brute(prints)


def test_layout_covers_the_distance():
    for nodes in (10, 10**6, 10**9, 10**12):
        for distance in (1, 3, 4, 6):
            tables = simhash.layout(nodes, distance)
            rng = random.Random(nodes)
            for _ in range(300):
                flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(distance + 1)))
                assert any((flips & mask).bit_count() <= radius for mask, radius in tables)


def test_rows_without_id_repeated_and_none(table):
    df = simhash.near_duplicates(table([(None, "a b"), (3, "a b"), (3, "a b"), (None, "quite another text of seven words here")]))
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in df.collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    assert simhash.near_duplicates(table([])).count() == 0


def test_representatives_keep_one_each(table):
    docs = table([(5, "a b c d e"), (2, "a b c d e"), (9, None), (4, ""), (None, "q w e r t y")], extra=True)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 4]


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").select("a", F.col("b"))
    got = {r["node"]: r["component"] for r in connected(df).collect()}
    assert got == {**{k: 100 for k in range(101, 161)}, **{k: 1 for k in range(2, 60)}}
    assert connected(df.limit(0)).count() == 0


def test_representatives_of_repeated_rows_and_null_ids(table, words):
    a, b, c, d, e = (words(90, k) for k in range(5))
    docs = table([(1, a), (1, a), (2, a), (None, a), (3, b), (4, b), (4, b), (None, c), (None, c), (None, c), (None, d), (7, d), (7, d), (8, e), (8, words(90, 9)), (None, None), (None, "")], extra=True)
    kept = simhash.representatives(docs.repartition(4))
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"] or "") for r in kept.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (3, b), (None, c), (7, d), (8, e), (8, words(90, 9)), (None, "")], key=str)
    rest = suffix_dedup.removed(kept)
    assert sorted([(r["doc_id"], r["text"] or "") for r in rest.select("doc_id", "text").collect()], key=str) == sorted(got, key=str)


def test_unsettled_components_raise(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected(df, rounds=1)
