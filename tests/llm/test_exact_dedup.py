import hashlib
import re
import tempfile
from collections import defaultdict

from tidemark.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    out = []
    for d, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[n])[1]
        out.append((d, keep, len(groups[n]), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=lambda r: (r[0] is None, r))


def test_like_brute_force(table, words):
    texts = [None, "", " \n\t", "a b", "ab", "a  b", "a b", "é x", "éx", "a b", "a b", words(30000, 1), words(30000, 1) + " ", *[words(9, k % 7) for k in range(60)]]
    given = list(enumerate(texts))
    assert rows(exact_dedup.exact_dedup(table(given, extra=True).repartition(5))) == brute(given)


def test_ties_repeated_rows_and_null_ids(table):
    got = rows(exact_dedup.exact_dedup(table([(4, "x y"), (2, "xy "), (2, "xy "), (9, "q"), (9, "q")])))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(2, 2, 3, False), (2, 2, 3, True), (4, 2, 3, False), (9, 9, 2, False), (9, 9, 2, True)]
    assert sum(r[3] for r in rows(exact_dedup.exact_dedup(table([(None, None), (None, ""), (1, "a"), (1, " a"), (1, "a ")]).repartition(3)))) == 2
    assert [tuple(r)[:4] for r in exact_dedup.exact_dedup(table([(None, "a"), (7, "a")])).orderBy("doc_id").collect()] == [(None, 7, 2, False), (7, 7, 2, True)]
    assert exact_dedup.exact_dedup(table([])).count() == 0


def test_buckets_that_do_not_fit_are_dealt_again():
    contents = [b"%d" % (k % 500) * 20 for k in range(2000)]
    given = [(hashlib.sha256(c).digest(), c, len(c), k, 1, 1) for k, c in enumerate(contents)]
    with tempfile.TemporaryDirectory() as folder:
        found = [r for b in exact_dedup.grace(iter(given), 0, folder, memory=3000) for r in b.to_pylist()]
    assert len(found) == 500 and all(r["group_size"] == 4 and r["keep_id"] < 500 for r in found)
