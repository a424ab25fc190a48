import dataclasses
import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(words, length, seed):
    rng = random.Random(seed)
    shared = [words(60, 1000 + k)[: rng.randrange(length - 3, 4 * length)] for k in range(6)]
    texts = [None, "", "x" * (length - 1), "x" * (length + 5), "ab" * length, "é" * length]
    for k in range(40):
        t = words(rng.randrange(1, 80), k)
        for s in rng.sample(shared, rng.randrange(3)):
            a = rng.randrange(len(s) // 2)
            at = rng.randrange(len(t))
            t = t[:at] + s[a:] + t[at:]
        texts.append(t)
    texts += [texts[10], texts[11] + "!", texts[12][3:]]
    return texts


def got(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


def brute_words(texts, length):
    data = [(t or "").split() for t in texts]
    seen = {}
    for d in data:
        for p in range(len(d) - length + 1):
            seen[tuple(d[p : p + length])] = seen.get(tuple(d[p : p + length]), 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if seen[tuple(d[p : p + length])] > 1:
                gone[p : p + length] = True
        out.append((int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), int(gone.sum())))
    return out


@pytest.mark.parametrize("group", [1, 3, S.GROUP])
@pytest.mark.parametrize("length", [40, 97])
def test_like_brute_force(table, words, length, group):
    texts = corpus(words, length, length)
    n = length // 4
    want = [a + b for a, b in zip(brute(texts, length), brute_words(texts, n))]
    assert got(S.report(table(texts, extra=True).repartition(4), length, n, group)) == want


def test_many_copies_are_merged(table, words):
    texts = [words(20, k) + words(90, 777)[: 300 + k % 7] + words(10, -k) for k in range(70)]
    assert [r[:4] for r in got(S.report(table(texts).repartition(70), 100))] == brute(texts, 100)


def test_full_length_and_parts_of_a_long_text(table, words, monkeypatch):
    monkeypatch.setattr(S, "BYTES", dataclasses.replace(S.BYTES, chunk=5000))
    monkeypatch.setattr(S, "WORDS", dataclasses.replace(S.WORDS, chunk=900))
    long = words(9000, 1)
    texts = [long, long[20000:20700], words(200, 3), "-" * 1500]
    assert got(S.report(table(texts))) == [a + b for a, b in zip(brute(texts, 400), brute_words(texts, 50))]


def test_equal_rows_null_ids_and_an_empty_table(table, words):
    t = words(100, 5)
    df = S.report(table([(1, t), (1, t), (None, words(90, 6)), (None, None)]))
    assert sorted(r["n_removed"] for r in df.collect()) == [0, 0, len(t), len(t)]
    assert S.report(table([])).count() == 0


def test_removed_keeps_the_columns(table, words):
    s = words(100, 8)
    docs = table(["a " + s + " b", "c " + s + " d", None, words(50, 9)], extra=True)
    out = S.removed(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts == {0: "a b" if False else texts[0], 1: texts[1], 2: None, 3: words(50, 9)}
    assert texts[0].replace(" ", "") == "ab" and texts[1].replace(" ", "") == "cd"


def test_a_passage_of_over_fifty_words_goes_and_one_can_be_kept(table, words):
    passage = words(51, 70)
    texts = [f"{words(30, k)} {passage}\n{words(20, -k)}" for k in range(5)] + [words(200, 9)]
    docs = table(texts, extra=True)
    out = S.removed(docs, S.WORDS)
    assert out.columns == docs.columns
    found = {r["doc_id"]: r["text"] for r in out.collect()}
    assert found == {k: f"{words(30, k)} \n{words(20, -k)}" for k in range(5)} | {5: texts[5]}
    found = {r["doc_id"]: r["text"] for r in S.removed(docs, S.WORDS, keep_first=True).collect()}
    assert found == {k: t if k in (0, 5) else f"{words(30, k)} \n{words(20, -k)}" for k, t in enumerate(texts)}


def test_first_windows_stay(table, words):
    length = 60
    texts = corpus(words, length, 3)
    seen, want = set(), []
    for t in texts:
        d = (t or "").encode()
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if d[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(d[p : p + length])
        want.append(None if t is None else bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    for group in (2, S.GROUP):
        out = S.removed(table(texts).repartition(5), S.BYTES, length, True, group).collect()
        assert [r["text"] for r in sorted(out, key=lambda r: r["doc_id"])] == want


@pytest.mark.parametrize("shard", [1, 7, 64, 1000])
def test_merged_shards_give_the_order_of_all(shard):
    rng = random.Random(3)
    parts = [bytes(rng.choices(b"ab", k=24)) for _ in range(300)]
    heads = np.array([rng.randrange(3) for _ in parts], np.uint16)
    columns = np.ascontiguousarray(np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), 24).T)
    order, common = S.merged(columns, heads, shard)
    ranked = [(heads[k], parts[k]) for k in order]
    assert ranked == sorted(ranked)
    for k in range(1, len(parts)):
        (g, a), (h, b) = ranked[k - 1], ranked[k]
        assert common[k] == (-1 if g != h else next((i for i in range(24) if a[i] != b[i]), 24))


def test_many_records_without_any_repeat():
    rng = random.Random(8)
    n, length = 30, 40
    sides = [bytes(rng.choices(b"abcdefgh", k=20)) for _ in range(2 * n)]
    zero = np.zeros(n, np.int64)
    z, _, _ = S.repeated(zero, zero + 20, zero, zero + 20, zero + 21, sides[:n], sides[n:], S.BYTES)
    assert len(z) == 0


def test_words_of_texts(monkeypatch, words):
    monkeypatch.setattr(S, "_PIECE", 50)
    texts = ["", " ", "a", "a b\na  b ", words(200, 1), "x" * 70 + " " + "y" * 500 + " z", "é ü\t é"]
    found = S._word_hashes([t.encode() for t in texts])
    named = {}
    for t, h in zip(texts, found):
        parts = t.encode().split()
        assert len(h) == 8 * len(parts)
        for k, w in enumerate(parts):
            assert named.setdefault(w, h[8 * k : 8 * k + 8]) == h[8 * k : 8 * k + 8]
    assert len(set(named.values())) == len(named)
