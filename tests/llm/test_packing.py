import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, size):
    """Sequences are gapless, none is too long; returns their number."""
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(seqs)


def test_pieces_and_sequences(table, words):
    texts = [None, "", "a", "<|endoftext|> x", "日本 é    b", words(9000, 1), words(1500, 2), *[words(random.Random(k).randrange(1, 500), k) for k in range(120)]]
    docs = table(texts + [texts[7]], extra=True).repartition(6)
    rows = packing.pack(docs, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    total = 0
    for k, t in enumerate(texts + [texts[7]]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        parts = sorted(by[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == [sum(r["length"] for r in parts[:i]) for i in range(len(parts))]
        assert all(r["length"] == 2048 for r in parts[1:]) and sum(r["length"] for r in parts) == len(ids)
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert check(rows, 2048) <= -(-total // 2048) + 1


def test_empty_table_and_exact_lengths(table):
    assert packing.pack(table([]), PATH).count() == 0
    rows = packing.pack(table([" a" * 2047, " a" * 2048, " a" * 4095]), PATH).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in rows) == [(0, 0, 2048), (1, 0, 1), (1, 1, 2048), (2, 0, 2048), (2, 1, 2048)]


def place_all(histogram, size):
    p = packing.Placement(packing.plan(histogram, size))
    rows = [{"sequence_id": s, "offset": o, "length": x} for x, n in histogram.items() for s, o in (p.of(x, r) for r in range(n))]
    assert check(rows, size) == p.total
    return p.total


def test_plan_places_every_piece():
    rng = random.Random(4)
    for size in (1, 7, 50, 300):
        for _ in range(20):
            histogram = {x: rng.randrange(1, 40) for x in rng.sample(range(1, size + 1), min(size, rng.randrange(1, 40)))}
            n = place_all(histogram, size)
            total = sum(x * k for x, k in histogram.items())
            assert -(-total // size) <= n <= 11 / 9 * -(-total // size) + sum(k for x, k in histogram.items() if 2 * x > size) + 1


def test_two_smaller_ones_fill_a_gap_better():
    # 6 + 3 leaves 1; taking 3 out for 2 + 2 fills it
    assert (1, (6, 2, 2)) in packing.plan({6: 1, 3: 1, 2: 2}, 10)
