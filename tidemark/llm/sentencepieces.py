"""SentencePiece BPE encoding with byte offsets, and decoding.

The normaliser replaces the longest prefixes in the compiled character map (a double-array trie stored in the model file),
and notes for each normalised byte the source byte that it comes from; pieces are then projected on original byte spans.
Every text goes through it, whatever the model's map.  Segmentation merges the pair of best score, leftmost first, as the library does; unknown
characters fall back to bytes.  Where no piece of the vocabulary holds a blank mark after another character, text splits
before each run of blanks, and between letters and signs that follow none in any piece, into units that merge independently; each worker keeps the ids of units that it has seen.

Edge cases: null and empty text have no ids; any code point is encoded (an unpaired surrogate as U+FFFD); white space is
kept or folded as the model says.  Texts of any length are processed whole: a unit costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, tidy

MARK = "▁"
_MARK = MARK.encode()


class CharacterMap:
    """Longest-prefix replacement through the compiled map: a little-endian size, a double-array trie of that size, and null-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units: array | list = []
        self.texts = b""
        if len(blob) > 4:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.texts = blob[4 + size :]
        #: Bytes with which keys begin.
        heads = bytes(c for c in range(256) if self._begins(c))
        self.starts = re.compile(b"[" + re.escape(heads) + b"]") if heads else None

    def _begins(self, c: int) -> bool:
        if not self.units:
            return False
        pos = ((self.units[0] >> 10) << ((self.units[0] & (1 << 9)) >> 6)) ^ c
        return pos < len(self.units) and self.units[pos] & ((1 << 31) | 0xFF) == c

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts there, and what replaces it."""
        if not self.units:
            return None
        unit, pos, best = self.units[0], 0, None
        pos ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for n in range(at, len(data)):
            pos ^= data[n]
            if pos >= len(self.units):
                break
            unit = self.units[pos]
            if unit & ((1 << 31) | 0xFF) != data[n]:
                break
            pos ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                value = self.units[pos] & ((1 << 31) - 1)
                best = (n + 1 - at, self.texts[value : self.texts.index(b"\0", value)])
        return best


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    charmap: CharacterMap
    dummy_prefix: bool
    fold_spaces: bool
    escape: bool
    byte_fallback: bool
    ids: dict[str, int] = field(default_factory=dict)
    #: Ids of pieces, and numbers of characters that are none; ranks and pieces of pairs of these, as first << 20 | second.
    symbols: dict[str, int] = field(default_factory=dict)
    ranks: dict[int, int] = field(default_factory=dict)
    merges: dict[int, int] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)
    #: What a piece is decoded to by itself; `loose`: pieces of bytes that make a character only with others.
    shown: list[str] = field(default_factory=list)
    loose: set[int] = field(default_factory=set)
    bytes_at: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    splits: bool = True
    cut: re.Pattern = field(default_factory=lambda: re.compile(".+", re.S))

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2:
            raise ValueError("only BPE models")
        self = cls(
            [p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], CharacterMap(n.precompiled_charsmap), n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces, m.trainer_spec.byte_fallback
        )
        if m.trainer_spec.treat_whitespace_as_suffix or any(k in (4, 5) for k in self.kinds) or not self.escape:
            raise ValueError("models with user-defined or unused pieces, blanks as suffix or unescaped blanks are not supported")
        for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if kind == 1:
                self.ids[p] = k
            elif kind == 2:
                self.unknown = k
            elif kind == 6:
                self.bytes_at[int(p[3:5], 16)] = k
        chars = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.symbols = self.ids | {c: len(self.pieces) + k for k, c in enumerate(chars)}
        order = {score: r for r, score in enumerate(sorted({self.scores[k] for k in self.ids.values()}, reverse=True))}
        for p, k in self.ids.items():
            for i in range(1, len(p)):
                a, b = self.symbols.get(p[:i]), self.symbols.get(p[i:])
                if a is not None and b is not None:
                    self.ranks[a << 20 | b], self.merges[a << 20 | b] = order[self.scores[k]], k
        self.sizes = [len(p.encode()) for p in self.pieces]
        single = {k: chr(b) for b, k in self.bytes_at.items() if b < 0x80}
        self.loose = {k for b, k in self.bytes_at.items() if b >= 0x80}
        self.shown = [single.get(k, {1: p.replace(MARK, " "), 2: " ⁇ "}.get(kind, "")) for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        end = "" if any("\n" in p for p in self.ids) else "\n"
        signs = re.escape("".join(self.apart()))
        run = f"[^{MARK}{end}{signs}]"
        # between them numbers that are no decimal digits count as signs
        odd = "".join(sorted({c for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
        runs = f"[{signs}]*{run}+(?:(?<![^\\W_{odd}])[{signs}]+{run}*)*|[{signs}]+" if signs else f"{run}+"
        self.cut = re.compile((end and "\n|") + f"{MARK}*(?:{runs})|{MARK}+")
        return self

    def apart(self) -> list[str]:
        """Signs that follow a letter or digit in no piece: between these two nothing is merged."""
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        joined = {b for a, b in pairs if a.isalpha() or a.isdecimal()}
        return [c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined]

    # normalisation

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) its byte in the source.

        Only at bytes that begin a key of the map is the longest prefix looked up; what lies between is copied.
        """
        data = text.encode("utf-8", "replace")
        parts: list[bytes] = []
        first: list[np.ndarray] = []  # of each byte, where its source begins and ends
        last: list[np.ndarray] = []
        at = copied = 0

        def copy(end: int) -> None:
            if end > copied:
                parts.append(data[copied:end])
                first.append(np.arange(copied, end))
                last.append(first[-1] + 1)

        starts = self.charmap.starts
        while starts and (m := starts.search(data, at)):
            at = m.start()
            hit = self.charmap.longest(data, at)
            if hit is None:
                at += 1
                continue
            copy(at)
            parts.append(hit[1])
            first.append(np.full(len(hit[1]), at))
            last.append(np.full(len(hit[1]), at + hit[0]))
            at = copied = at + hit[0]
        copy(len(data))
        joined = b"".join(parts)
        if not joined:
            return b"", np.array([len(data)])
        raw = np.frombuffer(joined, np.uint8)
        a, z = np.concatenate(first), np.concatenate(last)
        blank = raw == 0x20
        if self.fold_spaces:  # a run of blanks is one, at the ends none
            some = np.flatnonzero(~blank)
            if not len(some):
                return b"", np.array([len(data)])
            keep = ~(blank & np.r_[True, blank[:-1]])
            keep[some[-1] + 1 :] = False
            joined, a, z, blank = raw[keep].tobytes(), a[keep], z[keep], blank[keep]
        source = np.repeat(a, np.where(blank, len(_MARK), 1)) if blank.any() else a
        out = joined.replace(b" ", _MARK)
        if self.dummy_prefix:
            out, source = _MARK + out, np.r_[np.full(len(_MARK), a[0]), source]
        return out, np.r_[source, z[-1]]

    # segmentation

    def merge(self, unit: str) -> list[str]:
        """Symbols of a unit after all merges, best score first, leftmost first among equals."""
        s: list[str | None] = list(unit)
        n = len(s)
        if n < 2:
            return s
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        ids, scores, heap = self.ids, self.scores, []

        def push(a: int, b: int) -> None:
            both = s[a] + s[b]
            k = ids.get(both)
            if k is not None:
                heapq.heappush(heap, (-scores[k], a, b, len(both), both))

        for k in range(n - 1):
            push(k, k + 1)
        while heap:
            _, a, b, size, both = heapq.heappop(heap)
            if s[a] is None or s[b] is None or right[a] != b or len(s[a]) + len(s[b]) != size:
                continue
            s[a], s[b] = both, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            if left[a] >= 0:
                push(left[a], a)
            if right[a] >= 0:
                push(a, right[a])
        return [x for x in s if x is not None]

    def _merge_short(self, unit: str) -> list[tuple[int, int]]:
        """unit_ids() of few symbols: ranks of neighbouring pairs in a list, whose least entry is found by scanning."""
        number, rank, none = self.symbols.get, self.ranks.get, 1 << 30
        s = [number(c, -1) for c in unit]
        where = [*range(len(s))]
        pairs = [rank(a << 20 | b, none) for a, b in zip(s, s[1:])]
        while pairs and (least := min(pairs)) < none:
            k = pairs.index(least)
            new = s[k] = self.merges[s[k] << 20 | s.pop(k + 1)]
            del pairs[k], where[k + 1]
            if k:
                pairs[k - 1] = rank(s[k - 1] << 20 | new, none)
            if k < len(pairs):
                pairs[k] = rank(new << 20 | s[k + 1], none)
        if max(s) < len(self.pieces) and min(s) >= 0:
            return [(k, self.sizes[k]) for k in s]
        return self._pieced([unit[a:b] for a, b in zip(where, [*where[1:], len(unit)])])

    def unit_ids(self, unit: str) -> list[tuple[int, int]]:
        """(id, bytes covered) of a unit."""
        return self._merge_short(unit) if 0 < len(unit) <= 48 else self._pieced(self.merge(unit))

    def _pieced(self, parts: list[str]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in parts:
            k = self.ids.get(p)
            raw = p.encode()
            if k is not None:
                out.append((k, len(raw)))
            elif self.byte_fallback:
                out += [(self.bytes_at[b], 1) for b in raw]
            elif out and out[-1][0] == self.unknown:
                out[-1] = (self.unknown, out[-1][1] + len(raw))
            else:
                out.append((self.unknown, len(raw)))
        return out

    def units(self, text: str) -> list[str]:
        """Parts that no piece spans."""
        return self.cut.findall(text) if self.splits and self.byte_fallback else [text]

    def encode(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, first source byte, end source byte) of each piece."""
        norm, source = self.normalise(text or "")
        found = [x for unit in self.units(norm.decode("utf-8", "replace")) for x in self.unit_ids(unit)]
        ends = source[np.cumsum([0, *[size for _, size in found]])].tolist()
        return [(k, a, b) for (k, _), a, b in zip(found, ends, ends[1:])]

    def decode(self, ids: Sequence[int], started: bool = False) -> str:
        """Text of ids: marks are blanks, the blank put first is taken off (unless it has started before), byte pieces are read as UTF-8."""
        if started and self.loose.isdisjoint(ids):
            return "".join([self.shown[k] for k in ids])
        out: list[str] = []
        pending = bytearray()

        def flush() -> None:
            nonlocal started
            if pending:
                at = 0
                while at < len(pending):  # each byte that starts no valid character is one replacement character
                    for size in (1, 2, 3, 4):
                        try:
                            out.append(pending[at : at + size].decode())
                            at += size
                            break
                        except UnicodeDecodeError:
                            continue
                    else:
                        out.append("�")
                        at += 1
                pending.clear()
                started = True

        for k in ids:
            kind = self.kinds[k]
            if kind == 6:
                pending.append(int(self.pieces[k][3:5], 16))
                continue
            flush()
            if kind == 3:
                continue
            if kind == 2:
                out.append(" ⁇ ")
                started = True
                continue
            p = self.pieces[k]
            if not started and (self.dummy_prefix or self.fold_spaces) and p.startswith(MARK):
                p = p[1:]
                if self.fold_spaces:
                    p = p.lstrip(MARK)
            started = True
            out.append(p.replace(MARK, " "))
        flush()
        return "".join(out)


@lru_cache(2)
def loaded(path: str) -> Model:
    return Model.load(path)


class Encoder:
    """Whole documents through two tables of units already seen: when the young one holds `most`, it becomes the old one."""

    #: Longer units are not kept.
    KEPT = 64

    def __init__(self, model: Model, most: int = 450_000) -> None:
        self.model, self.most, self.young, self.old = model, most, {}, {}

    def _unit(self, unit: str) -> tuple[bytes, bytes, str]:
        """",id" of each piece of a unit, the bytes that each covers as unsigned 32-bit numbers, and the text that the ids decode to after others."""
        found = self.old.get(unit)
        if found is None:
            pieces = self.model.unit_ids(unit)
            ids = [k for k, _ in pieces]
            found = b"".join([b",%d" % k for k in ids]), array("I", [n for _, n in pieces]).tobytes(), self.model.decode(ids, started=True)
        if len(unit) <= self.KEPT:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[unit] = found
        return found

    def run(self, text: str | None) -> tuple[int, str, str, int]:
        """(number of ids, SHA-256 of their list, SHA-256 of the text they decode to, CRC-32 of the source bytes where pieces end, as unsigned 32-bit numbers).

        Pieces of bytes that make one character are of one unit, so the decoded text is that of the units one after another, but for a blank put first.
        """
        norm, source = self.model.normalise(text or "")
        units, unit = self.model.units(norm.decode("utf-8", "replace")) if norm else [], self._unit
        found = [g or unit(u) for g, u in zip(map(self.young.get, units), units)]
        listed, covers, shown = (list(x) for x in zip(*found)) if found else ([], [], [])
        if shown:
            ids = listed[0].decode().split(",")[1:]
            shown[0] = self.model.decode([int(k) for k in ids])
        sizes = np.frombuffer(b"".join(covers), "<u4")
        ends = source[np.cumsum(sizes)].astype("<u4")
        return len(sizes), hashlib.sha256(b"".join(listed)[1:]).hexdigest(), hashlib.sha256("".join(shown).encode()).hexdigest(), zlib.crc32(ends.tobytes())


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(loaded(path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ends_crc32 of each row of docs (doc_id, text); path: the model file, present on every machine."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            found = [e.run(t) for t in batch.column(1).to_pylist()]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_crc32 long")


def spans(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, and pieces: array of (id, piece, start, end), the last two bytes of the original text."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(path)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("piece", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"id": k, "piece": m.pieces[k], "start": a, "end": b} for k, a, b in m.encode(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "pieces"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, pieces array<struct<id:int,piece:string,start:bigint,end:bigint>>")
