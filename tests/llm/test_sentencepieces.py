import dataclasses
import hashlib
import random
import struct
import zlib

import public_tokenizers
import sentencepiece

from tidemark.llm import sentencepieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", " a", "a ", "a  b", "▁", "▁a ▁", "<s>", "</s> x", "<unk>", "<0x41>", "⁇", "é", "日本語のテキスト", "🙂🙂", "a\x00b", "‍﻿", "ﬁ ½ Ⅳ", "é", " x", "tab\tline\r\nend", "a\n\nb", "x" * 3000, "ab" * 2000]


def texts():
    rng = random.Random(7)
    alphabet = " \n\t ▁ab'é中🙂́x0<>s\x00‍|"
    return ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]


def test_like_the_library(table, words):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    given = [None, *texts(), words(40000, 1)]
    rows = {r["doc_id"]: tuple(r)[1:] for r in S.digests(table(given, extra=True), PATH).collect()}
    for k, t in enumerate(given):
        ids = sp.encode(t or "")
        assert rows[k][:3] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()), repr(t)[:80]
        assert rows[k][3] == zlib.crc32(b"".join(struct.pack("<I", b) for _, _, b in S.loaded(PATH).encode(t))), repr(t)[:80]


def test_spans_are_bytes_of_the_source(table):
    m = S.loaded(PATH)
    for t in texts():
        pieces = m.encode(t)
        raw = t.encode()
        assert all(0 <= a <= b <= len(raw) for _, a, b in pieces)
        assert b"".join(raw[a:b] for _, a, b in pieces) == raw
    row = S.spans(table(["a b", None]), PATH).orderBy("doc_id").collect()
    assert [(p["start"], p["end"]) for p in row[0]["pieces"]] == [(0, 1), (1, 3)] and row[1]["pieces"] == []


def test_repeated_rows_null_ids_and_an_empty_table(table):
    assert S.digests(table([(None, "a"), (None, "a"), (1, "a")]), PATH).select("n_tokens").distinct().count() == 1
    assert S.digests(table([]), PATH).count() == 0
    assert S.spans(table([]), PATH).count() == 0


def _trie(mapping):
    """A compiled character map: a double array in the library's layout, and its strings."""
    values, texts = {}, b""
    for key, new in mapping.items():
        values[key] = len(texts)
        texts += new + b"\0"
    nodes = {b""}
    for key in mapping:
        nodes |= {key[:k] for k in range(len(key) + 1)}
    size, units, used, bases = 8192, {}, {0}, set()
    place = {b"": 0}
    for node in sorted(nodes, key=len):
        labels = sorted({n[len(node)] for n in nodes if len(n) == len(node) + 1 and n.startswith(node)}) + ([0] if node in values else [])
        base = next(b for b in range(1, size) if b not in bases and all((b ^ c) not in used for c in labels))
        bases.add(base)
        at = place[node]
        for c in labels:
            used.add(base ^ c)
            if c or node not in values:
                place[node + bytes([c])] = base ^ c
        offset = at ^ base
        units[at] = (units.get(at, 0) & 0x1FF) | (offset << 10) | ((1 << 8) if node in values else 0) | (node[-1] if node else 0)
        if node in values:
            units[base] = values[node] | (1 << 31)
    import struct

    blob = b"".join(struct.pack("<I", units.get(k, 0)) for k in range(size))
    return struct.pack("<I", len(blob)) + blob + texts


def test_longest_prefix_wins():
    m = S.CharacterMap(_trie({b"a": b"x", b"ab": b"yz", b"\xc2\xa0": b" "}))
    assert m.longest(b"abc", 0) == (2, b"yz")
    assert m.longest(b"ac", 0) == (1, b"x")
    assert m.longest(b"\xc2\xa0", 0) == (2, b" ")
    assert m.longest(b"b", 0) is None


def test_spans_through_a_map(monkeypatch):
    m = dataclasses.replace(S.loaded(PATH), charmap=S.CharacterMap(_trie({b"a": b"xy", b"ab": b"c", "é".encode(): b"e ", "\u00a0".encode(): b" ", b"q": b""})))
    for text, new, starts in (("zab", "▁zc", [0, 0, 0, 0, 1, 3]), ("éz", "▁e▁z", [0, 0, 0, 0, 0, 0, 0, 2, 3]), ("a", "▁xy", [0, 0, 0, 0, 0, 1]), ("q", "", [1]), ("zqz", "▁zz", [0, 0, 0, 0, 2, 3])):
        norm, source = m.normalise(text)
        assert (norm.decode(), source.tolist()) == (new, starts)
    for t in texts():
        spans = m.encode(t)
        assert all(a <= b for _, a, b in spans) and all(x[2] == y[1] for x, y in zip(spans, spans[1:]))
        encoder = S.Encoder(m)
        assert encoder.run(t)[0] == len(spans) == encoder.run(t)[0]
    folding = dataclasses.replace(m, fold_spaces=True)
    assert folding.normalise("  z  \u00a0z ")[0].decode() == "▁z▁z"
    assert folding.normalise("  z  \u00a0z ")[1].tolist() == [2, 2, 2, 2, 3, 3, 3, 7, 8]


def test_like_the_library_over_documents(data):
    import duckdb

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoder = S.Encoder(S.loaded(PATH), most=500)
    for (t,) in duckdb.sql(f"SELECT text FROM '{data}/documents.parquet'").fetchall():
        ids, raw = sp.encode(t or ""), (t or "").encode()
        assert encoder.run(t)[:3] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        assert b"".join(raw[a:b] for _, a, b in S.loaded(PATH).encode(t)) == raw
