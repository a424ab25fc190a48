import hashlib
import random
from collections import defaultdict
from itertools import combinations

import pytest

from tidemark.llm import line_dedup as D

SPACE = " \t\x0b\x0c\r"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def brute(texts, tau, min_chars):
    """Places (doc, pos) of dropped lines, and of each class."""
    where = defaultdict(list)
    for d, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            line = line.strip(SPACE)
            if len(line) >= min_chars:
                where[line].append((d, p))
    up = {x: x for x in where}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(where, 2):
        if abs(len(a) - len(b)) <= tau and distance(a, b) <= tau:
            up[root(a)] = root(b)
    classes = defaultdict(list)
    for x, places in where.items():
        classes[root(x)] += places
    return {frozenset(c) for c in classes.values() if len(c) > 1}


def lines(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcde ", k=rng.randrange(18, 34))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x))
            k = rng.randrange(3)
            x[at : at + (k != 1)] = [] if k == 0 else [rng.choice("abcdeé")]
        out.append("".join(x))
    return out


@pytest.mark.parametrize("tau,block", [(1, 512), (2, 512), (2, 3), (3, 5)])
def test_like_brute_force(table, tau, block, monkeypatch):
    pool = lines(tau)
    rng = random.Random(9)
    texts = [None, "", "\n\n", "short\nshort", *["\n".join(" " * rng.randrange(3) + x for x in rng.choices(pool, k=rng.randrange(1, 6))) for _ in range(25)]]
    whole = D.line_links
    monkeypatch.setattr(D, "line_links", lambda docs, t, m: whole(docs, t, m, block))
    found = defaultdict(set)
    for r in D.line_classes(table(texts, extra=True).repartition(3), tau, 20).collect():
        found[r["class_id"]].add((r["doc_id"], r["pos"], r["kept"]))
    want = brute(texts, tau, 20)
    assert {frozenset((d, p) for d, p, _ in c) for c in found.values()} == want
    for c in found.values():
        assert [x[:2] for x in c if x[2]] == [min(c)[:2]]


def test_within_is_the_edit_distance():
    rng = random.Random(1)
    for tau in (1, 2, 3, 5):
        for _ in range(1500):
            a = "".join(rng.choices("ab", k=rng.randrange(12)))
            b = list(a)
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randrange(2)] = rng.choices("abc", k=rng.randrange(2))
            b = "".join(b)
            assert D.within(a, b, tau) == (distance(a, b) <= tau), (a, b, tau)


def test_report_drops_all_but_the_first(table):
    a, near = "this line is long enough to count", "this line is long enough to c0unt"
    texts = [f"{a}\nown words that nobody else has at all", f"x\n  {near}\t\ny", a, "own words that nobody else has at all", None]
    got = {r["doc_id"]: r for r in D.report(table(texts, extra=True)).collect()}
    assert {k: (r["n_lines"], r["n_dropped"]) for k, r in got.items()} == {0: (2, 0), 1: (3, 1), 2: (1, 1), 3: (1, 1), 4: (1, 0)}
    assert got[1]["kept_sha256"] == hashlib.sha256(b"x\ny").hexdigest()
    assert got[0]["line_classes"].split(",")[0].startswith("0:")


def test_dedup_keeps_columns_equal_rows_and_nulls(table, words):
    t = words(30, 1)
    docs = table([(1, t), (1, t), (None, None), (7, words(25000, 2)), (None, t)], extra=True)
    out = D.dedup(docs)
    assert out.select(*docs.columns).columns == docs.columns
    rows = sorted(((r["doc_id"] or -1, r["text"]) for r in out.select("doc_id", "text").collect()), key=str)
    assert [r[0] for r in rows] == [-1, -1, 1, 1, 7]
    assert D.report(table([])).count() == 0


@pytest.mark.parametrize("near_chars", [8, 20])
def test_short_lines_by_equality(table, near_chars):
    rng = random.Random(near_chars)
    pool = [*lines(4, 40), *["".join(rng.choices("ab é", k=rng.randrange(24))) for _ in range(80)], "Les.", "Les", "x", "0123456789abcdefghi", "0123456789abcdefgh"]
    texts = [None, "", "\n \n\t\n", "Les.\n Les.\t\nLes", *["\n".join(" " * rng.randrange(3) + x for x in rng.choices(pool, k=rng.randrange(1, 9))) for _ in range(40)]]
    found = defaultdict(set)
    for r in D.line_classes(table(texts).repartition(3), near_chars=near_chars).collect():
        found[r["class_id"]].add((r["doc_id"], r["pos"], r["kept"]))
    # every pair of lines that are not blank, whatever their lengths
    where = defaultdict(list)
    for d, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(SPACE):
                where[line.strip(SPACE)].append((d, p))
    up = {x: x for x in where}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(where, 2):
        if min(len(a), len(b)) >= near_chars and distance(a, b) <= 2:
            up[root(a)] = root(b)
    classes = defaultdict(list)
    for x, places in where.items():
        classes[root(x)] += places
    want = {frozenset(c) for c in classes.values() if len(c) > 1}
    assert {frozenset((d, p) for d, p, _ in c) for c in found.values()} == want
    assert any(len(x) < near_chars and len(places) > 1 for x, places in where.items())
    for c in found.values():
        assert [x[:2] for x in c if x[2]] == [min(c)[:2]]


def test_report_drops_equal_short_lines(table):
    texts = ["Les.\n\nown words that nobody else has at all", "Les.\n\nLes", " Les. "]
    got = {r["doc_id"]: (r["n_dropped"], r["kept_sha256"]) for r in D.report(table(texts)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {0: (0, sha(texts[0].encode())), 1: (1, sha(b"\nLes")), 2: (1, sha(b""))}
