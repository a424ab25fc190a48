"""Removal of long repeated strings by merging Burrows-Wheeler transforms of shards of anchored suffixes.

A symbol (a byte, or a word) goes if a string of `length` symbols that covers it also starts anywhere else, in the same
document or another.

Suffixes matter only if their first `length` symbols occur twice, so the suffix array is a sampled one.  Every window of
`length` symbols has an anchor: the position whose hash of `gram` symbols is least in it (the first of equals).  Equal
windows have their anchors at the same offset.
1. Anchor hashes are counted over all documents; what is met once is done with.
2. The context of an anchor is all windows that have it.  Contexts are counted by their 128-bit digests: equal ones repeat
   as they are, and only one of each kind goes on, and only if its anchor has other kinds too.
3. A record is a core (the symbols that all its windows share, as a 128-bit digest), a suffix to the right of the core and
   a reversed prefix to the left.  Records of one core meet in a task.  An anchor of k kinds of context is dealt out by
   classes of W * GROUP / k window offsets (W at most, 1 at least), whose longer cores are the finer keys; so no core
   brings more than about W * GROUP windows together, whatever k is.  With classes of one window, sides are empty and
   equal records of a task are sent twice at most.
4. A task cuts its records into shards of SHARD rows and makes the positional Burrows-Wheeler transform of each: symbols of
   column j in the order of what follows them.  Shards are merged by refining their interleave column by column: the next
   symbol of each shard's transform is read in the order of the interleave, which is then dealt stably by these symbols.
   Suffixes are not sorted anew.  Common prefixes of neighbours in the merged order give the intervals at every depth; a
   window repeats if another record is in its interval of suffixes and in its interval of reversed prefixes.

Words are what white space separates; they are compared by 64-bit hashes, strings of them by the above.

Edge cases: null text counts as empty; texts shorter than `length` lose nothing; overlapping repeats within a text count;
equal rows are copies of each other; null and repeated ids are fine; any bytes and lengths are taken; other columns pass
through removed() untouched.  Removal of bytes may cut a character; removed() then drops the loose bytes of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, fresh, small, small_batches, stored, tidy

#: Records of an anchor up to which it is not split, and rows of a shard.
GROUP, SHARD = 4096, 2048
_POS = (1 << 21) - 1
_RNG = np.random.Generator(np.random.PCG64(20240501))
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD, _GAP = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of text whose words are hashed at once; words longer than LONG go by XXH3.
_PIECE, _LONG = 1 << 17, 64


@dataclass(frozen=True)
class Unit:
    """What symbols are: dtype, symbols of a buffer (a longer text is cut in overlapping parts), default length and gram."""

    dtype: str
    chunk: int
    length: int
    gram: int

    @property
    def size(self) -> int:
        return np.dtype(self.dtype).itemsize

    def symbols(self, column: pa.Array) -> list[bytes]:
        """The texts as bytes of symbols."""
        texts = _bytes(column)
        return texts if self.size == 1 else _word_hashes(texts)


BYTES = Unit("u1", 1 << 15, 400, 64)
#: Fifty words: what the corpus pipeline calls a passage.
WORDS = Unit("<u8", 1 << 15, 50, 8)


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


# anchors


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def _totals(data: np.ndarray) -> np.ndarray:
    """Sums of data times rising powers, from which hashes of all its parts follow."""
    global _UP, _DOWN
    if _UP is None or len(_UP) <= len(data):
        n = max(len(data) + 1, _PIECE + 4096)
        _UP, _DOWN = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLE[data] if data.itemsize == 1 else data) * _UP[: len(data)], out=total[1:])
    return total


def _stirred(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram symbols from each position."""
    total = _totals(data)
    return _stirred((total[gram:] - total[:-gram]) * _DOWN[: len(data) - gram + 1])


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(number of the text, part of it) of lists of about _PIECE bytes; no word is cut."""
    rows: list[tuple[int, bytes]] = []
    held = 0
    for k, t in enumerate(texts):
        at = 0
        while at < len(t):
            gap = _GAP.search(t, at + _PIECE) if len(t) - at > _PIECE else None
            end = gap.start() if gap else len(t)
            rows.append((k, t[at:end]))
            held += end - at
            at = end
            if held >= _PIECE:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _word_hashes(texts: list[bytes]) -> list[bytes]:
    out: list[list[bytes]] = [[] for _ in texts]
    for rows in _pieces(texts):
        joined = b" ".join([t for _, t in rows]) + b" "
        if len(joined) > 8 * _PIECE:  # a word as long as that
            for k, t in rows:
                out[k].append(np.array([xxhash.xxh3_64_intdigest(w) for w in t.split()], np.uint64).tobytes())
            continue
        data = np.frombuffer(joined, np.uint8)
        gap = _SPACE[data]
        turn = np.flatnonzero(np.diff(np.r_[True, gap]))
        start, end = turn[::2], turn[1::2]
        total = _totals(data)
        h = _stirred((total[end] - total[start]) * _DOWN[start])
        for i in np.flatnonzero(end - start > _LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(joined[start[i] : end[i]])
        sizes = np.array([len(t) + 1 for _, t in rows])
        cut = np.searchsorted(start, np.cumsum(sizes)).tolist()
        for (k, _), a, b in zip(rows, [0, *cut], cut):
            out[k].append(h[a:b].tobytes())
    return [b"".join(x) for x in out]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, hash, anchor, first window, last window) of each anchor; texts are data[starts[k]:ends[k]], windows are the positions where they start."""
    windows = np.maximum(0, ends - starts - length + 1)
    if not windows.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = _grams(data, gram)
    m = (h & ~np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
    span, w = 1, length - gram + 1
    while 2 * span <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    text = np.repeat(np.arange(len(starts)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)
    b = (m[at] & np.uint64(_POS)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[edge[1:], len(at)] - 1
    b, text = b[edge], text[edge]
    return text, h[b].view(np.int64), b, at[edge], at[last]


def _buffers(texts: list[bytes], unit: Unit, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, starts, ends, number of the text, its position in the text) of buffers; parts of a long text overlap by length - 1."""
    rows: list[tuple[bytes, int, int]] = []
    held, size, chunk = 0, unit.size, unit.chunk

    def full():
        sizes = np.array([len(r[0]) // size for r in rows], np.int64)
        ends = np.cumsum(sizes)
        return np.frombuffer(b"".join([r[0] for r in rows]), unit.dtype), ends - sizes, ends, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    for k, t in enumerate(texts):
        n = len(t) // size
        if n < length:
            continue
        for s in range(0, n - length + 1, chunk):
            part = t[s * size : (s + chunk + length - 1) * size] if n > chunk + length - 1 else t
            if held + len(part) > chunk * size and rows:
                yield full()
                rows, held = [], 0
            rows.append((part, k, s))
            held += len(part)
            if part is t:
                break
    if rows:
        yield full()


def _count(unit: Unit, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, ends, _, _ in _buffers(unit.symbols(batch.column(0)), unit, length):
                _, h, _, _, _ = anchors(data, starts, ends, length, gram)
                if len(h):
                    one, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


_PLACES = "doc_id long, uid long, h long, c1 long, c2 long, b int, p0 int, p1 int"


def _locate(unit: Unit, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, uid = batch.column(0), batch.column(1)
            for data, starts, ends, number, offset in _buffers(unit.symbols(batch.column(2)), unit, length):
                text, h, b, p0, p1 = anchors(data, starts, ends, length, gram)
                if len(h):
                    # the first window's offset tells contexts of the same symbols apart
                    seeds = (b - p0).tolist()
                    kinds = [xxhash.xxh3_128_digest(data[s:e], o) for s, e, o in zip(p0.tolist(), (p1 + length).tolist(), seeds, strict=True)]
                    c = np.frombuffer(b"".join(kinds), "<i8").reshape(-1, 2)
                    shift = (offset - starts)[text]
                    which = pa.array(number[text])
                    yield pa.RecordBatch.from_arrays(
                        [doc.take(which), uid.take(which), pa.array(h), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), *[pa.array((x + shift).astype(np.int32)) for x in (b, p0, p1)]],
                        names=["doc_id", "uid", "h", "c1", "c2", "b", "p0", "p1"],
                    )

    return run


# records


RECORD = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("base", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("width", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])
RECORD_DDL = "key long, check long, doc_id long, uid long, base int, first int, last int, width int, left binary, right binary"


def class_width(kinds: int, w: int, group: int) -> int:
    """Window offsets of a class, for an anchor of so many kinds of context."""
    return w if kinds <= group else max(1, w * group // kinds)


def _records(unit: Unit, length: int, gram: int, group: int, once: bool, remembered: int = 1 << 19):
    w, size = length - gram + 1, unit.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        rows: list[tuple] = []
        held = 0

        def again(digest: int) -> bool:
            """Whether two records like this one have been sent."""
            if once:
                return False
            if len(seen) >= remembered:
                seen.clear()
            n = seen[digest] = seen.get(digest, 0) + 1
            return n > 2

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)

        for batch in batches:
            docs, uids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), unit.symbols(batch.column(2))
            for doc, uid, text, found in zip(docs, uids, texts, batch.column(3).to_pylist(), strict=True):
                known: list[tuple[int, int]] = []
                for a in found:
                    b, p0, p1 = a["b"], a["p0"], a["p1"]
                    step = class_width(a["kinds"], w, group)
                    for k in range((b - p1) // step, (b - p0) // step + 1):
                        width = min(step, w - k * step)
                        base = b - k * step
                        low = base - width + 1
                        first, last = max(p0, low), min(p1, base)
                        core = xxhash.xxh3_128_intdigest(text[base * size : (low + length) * size], k)
                        left, right = text[first * size : base * size], text[(low + length) * size : (last + length) * size]
                        if again(hash((core, left, right))):
                            known.append((first, last))
                        else:
                            rows.append(((core & ((1 << 64) - 1)) - (1 << 63), (core >> 64) - (1 << 63), doc, uid, base, first, last, width, left, right))
                            held += len(left) + len(right) + 60
                for first, last in _joined(known):
                    rows.append(((xxhash.xxh64_intdigest(f"{doc} {uid} {first}") >> 1), 0, doc, uid, first, first, last, 0, None, None))
                if held > 8 << 20 or len(rows) > 20_000:
                    yield full()
                    rows, held = [], 0
        if rows:
            yield full()

    return run


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# merging


def transform(columns: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positional Burrows-Wheeler transform of the strings columns[:, i]: (their order under heads, the symbols of each column in the order of what follows it, heads in the order of the strings)."""
    order = np.arange(columns.shape[1])
    out = np.empty_like(columns)
    for j in range(len(columns) - 1, -1, -1):
        out[j] = columns[j][order]
        order = order[np.argsort(out[j], kind="stable")]
    last = heads[order]
    return order[np.argsort(last, kind="stable")], out, last


def merge(parts: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Interleave of shards, from their transforms: the shard of each string in the merged order.

    It starts as the shards one after another.  Each step reads the next symbol of every shard's column in the order of
    the interleave so far, and deals the interleave stably by these symbols.
    """
    sizes = [len(p[0]) for p in parts]
    mixed = np.repeat(np.arange(len(parts), dtype=np.uint16), sizes)
    for column in (*[[p[1][j] for p in parts] for j in range(len(parts[0][1]) - 1, -1, -1)], [p[2] for p in parts]):
        symbols = np.concatenate(column)
        read = np.empty_like(symbols)
        read[np.argsort(mixed, kind="stable")] = symbols
        mixed = mixed[np.argsort(read, kind="stable")]
    return mixed


def merged(columns: np.ndarray, heads: np.ndarray, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings columns[:, i] by (head, string), and the prefix that each has in common with the one before (-1: another head)."""
    n = columns.shape[1]
    parts = [transform(columns[:, s : s + shard], heads[s : s + shard]) for s in range(0, n, shard)]
    if len(parts) == 1:
        order = parts[0][0]
    else:
        order = np.empty(n, np.int64)
        order[np.argsort(merge(parts), kind="stable")] = np.concatenate([p[0] + k * shard for k, p in enumerate(parts)])
    common = np.full(n, -1)
    common[1:] = len(columns)
    if len(columns):
        ranked = columns[:, order]
        apart = ranked[:, 1:] != ranked[:, :-1]
        common[1:] = np.where(apart.any(axis=0), apart.argmax(axis=0), len(columns))
    h = heads[order]
    common[1:][h[1:] != h[:-1]] = -1
    return order, common


def _columns(sides: list[bytes], unit: Unit, reverse: bool) -> np.ndarray:
    n = max(map(len, sides))
    if not n:
        return np.empty((0, len(sides)), unit.dtype)
    m = np.frombuffer(b"".join([s.rjust(n, b"\0") if reverse else s.ljust(n, b"\0") for s in sides]), unit.dtype).reshape(len(sides), -1)
    return np.ascontiguousarray((m[:, ::-1] if reverse else m).T)


def repeated(core: np.ndarray, base: np.ndarray, first: np.ndarray, last: np.ndarray, width: np.ndarray, left: list[bytes], right: list[bytes], unit: Unit, rank: np.ndarray | None = None, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, first, last) of repeated windows among records of numbered cores; with ranks, of repeated windows that are not those of least rank."""
    n = len(core)
    heads = core.astype(np.uint16) if n < 1 << 16 else core
    order_r, common_r = merged(_columns(right, unit, False), heads, shard)
    order_l, common_l = merged(_columns(left, unit, True), heads, shard)
    least, most = base - last, base - first
    who, at = [], []
    block_r, block_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(int(least.min()), int(most.max()) + 1):
        live = np.flatnonzero((least <= t) & (t <= most))
        if len(live) < 2:
            continue
        block_r[order_r] = np.cumsum(common_r < (width - 1 - t)[order_r])
        block_l[order_l] = np.cumsum(common_l < t)
        both = block_r[live] * (n + 1) + block_l[live]
        order = np.argsort(both) if rank is None else np.lexsort((rank[live], both))
        both = both[order]
        same = both[1:] == both[:-1]
        hit = np.r_[False, same] if rank is not None else np.r_[False, same] | np.r_[same, False]
        hit = live[order[hit]]
        if len(hit):
            who.append(hit)
            at.append(np.full(len(hit), t))
    if not who:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    z, t = np.concatenate(who), np.concatenate(at)
    order = np.lexsort((t, z))
    z, t = z[order], t[order]
    edge = np.flatnonzero(np.r_[True, (z[1:] != z[:-1]) | (t[1:] != t[:-1] + 1)])
    end = np.r_[edge[1:], len(z)] - 1
    z = z[edge]
    return z, base[z] - t[end], base[z] - t[edge]


SPAN = "doc_id long, uid long, first int, last int"


def _spans(unit: Unit, once: bool, rows_held: int = 12_000):
    def solve(held: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, uid = held["doc_id"].combine_chunks(), held["uid"].combine_chunks()

        def out(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
            which = pa.array(rows)
            return pa.RecordBatch.from_arrays([doc.take(which), uid.take(which), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["doc_id", "uid", "first", "last"])

        key, check, base, first, last, width = (held[c].to_numpy().astype(np.int64) for c in ("key", "check", "base", "first", "last", "width"))
        known = np.flatnonzero(width == 0)
        if len(known):
            yield out(known, first[known], last[known])
        start = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (width[1:] == 0) | (width[:-1] == 0)]
        core = np.cumsum(start) - 1
        rows = np.flatnonzero(np.bincount(core)[core] > 1)
        if not len(rows):
            return
        _, core = np.unique(core[rows], return_inverse=True)
        rank = None
        if once:
            ids, uids = doc.fill_null(-(1 << 63)).to_numpy(), uid.to_numpy()
            rank = np.empty(len(key), np.int64)
            rank[np.lexsort((base, uids, ids))] = np.arange(len(key))
            rank = rank[rows]
        which = pa.array(rows)
        left, right = held["left"].take(which).to_pylist(), held["right"].take(which).to_pylist()
        z, a, b = repeated(core, base[rows], first[rows], last[rows], width[rows], left, right, unit, rank)
        if len(z):
            yield out(rows[z], a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= rows_held:
                t = pa.Table.from_batches(held)
                key = t["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from solve(t.slice(0, cut))
                    held, n = t.slice(cut).combine_chunks().to_batches(), n - cut
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("uid"), "text")


def repeated_spans(docs: DataFrame, unit: Unit = BYTES, length: int | None = None, keep_first: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, uid, spans: the first and last positions (in units) of runs of windows that start elsewhere too, of each document that has some.  keep_first: but for the window of the smallest doc_id, then position."""
    small_batches(docs.sparkSession)
    length = length or unit.length
    gram = min(unit.gram, length)
    base = _keyed(docs)
    seen = base.select("text").mapInArrow(tidy(_count(unit, length, gram)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    seen = stored(seen, "suffix-anchors")
    places = stored(base.mapInArrow(tidy(_locate(unit, length, gram)), _PLACES).join(small(seen, 8), "h"), "suffix-places")
    forget(seen)
    # Which of equal contexts goes on: the first, or with less work any.
    place = F.struct("doc_id", "uid", "b") if keep_first else F.xxhash64("uid", "b")
    kinds = stored(places.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("lead")), "suffix-kinds")
    per = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    told = kinds.join(per, "h").where("n > 1 or kinds > 1")
    found = stored(places.join(told, ["h", "c1", "c2"]).select("doc_id", "uid", "b", "p0", "p1", "n", "kinds", (place == F.col("lead") if not keep_first else place.eqNullSafe(F.col("lead"))).alias("leads")), "suffix-found")
    forget(places), forget(kinds)
    alike = found.where("n > 1 and not leads" if keep_first else "n > 1").select("doc_id", "uid", F.col("p0").alias("first"), F.col("p1").alias("last"))
    asks = found.where("leads and kinds > 1").groupBy(F.col("doc_id").alias("d"), F.col("uid").alias("u")).agg(F.collect_set(F.struct("b", "p0", "p1", "kinds")).alias("found"))
    with_text = base.join(asks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("uid") == F.col("u"))).select("doc_id", "uid", "text", "found")
    records = with_text.mapInArrow(tidy(_records(unit, length, gram, group, keep_first)), RECORD_DDL)
    spans = records.repartition("key").sortWithinPartitions("key", "check").mapInArrow(tidy(_spans(unit, keep_first)), SPAN)
    out = stored(spans.unionByName(alike).groupBy("doc_id", "uid").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "suffix-spans")
    forget(found)
    return out


def holes(spans: Sequence[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end), from spans of window starts."""
    return [(a, b + 1) for a, b in _joined([(s["first"], s["last"] + length - 1) for s in (() if spans is None else spans)])]


def _kept(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in gone:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def _with_spans(rows: DataFrame, docs: DataFrame, name: str, *how, **more) -> DataFrame:
    """rows (doc_id, uid, ...) with the spans of docs in column `name`."""
    spans = repeated_spans(docs, *how, **more).select(F.col("doc_id").alias("d"), F.col("uid").alias("u"), F.col("spans").alias(name))
    return rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("uid") == F.col("u")), "left").drop("d", "u")


def report(docs: DataFrame, length: int = BYTES.length, words: int = WORDS.length, group: int = GROUP) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 by strings of `length` bytes; n_passages, n_passage_words: runs of words that strings of `words` words cover which also start elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, spans, passages in zip(_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone, runs = holes(spans, length), holes(passages, words)
                rows.append((len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(data, gone)).hexdigest(), len(runs), sum(b - a for a, b in runs)))
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names, cols, strict=True)]], names=["doc_id", *names])

    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words")
    docs = docs.select("doc_id", "text")
    df = _with_spans(_keyed(docs), docs, "spans", BYTES, length, group=group)
    df = _with_spans(df, docs, "passages", WORDS, words, group=group)
    return df.select("doc_id", "text", "spans", "passages").mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{n} {'string' if n == 'kept_sha256' else 'long'}" for n in names))


def removed(docs: DataFrame, unit: Unit = BYTES, length: int | None = None, keep_first: bool = False, group: int = GROUP) -> DataFrame:
    """docs with repeated strings taken out of text: all of them, or (keep_first) all but the first (by doc_id, then position; equal rows are one document)."""
    length = length or unit.length
    names = docs.columns
    at, extra = names.index("text"), fresh(docs, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(len(names)).to_pylist()):
                if spans and texts[k]:
                    data = texts[k].encode("utf-8", "surrogatepass")
                    gone = holes(spans, length)
                    if unit is not BYTES:
                        places = [m.span() for m in _WORD.finditer(data)]
                        gone = [(places[a][0], places[b - 1][1]) for a, b in gone]
                    texts[k] = _kept(data, gone).decode("utf-8", "ignore")
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(names)])

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("uid"))
    rows = _with_spans(rows, docs, "spans", unit, length, keep_first, group)
    return rows.select(*[F.col("row")[c].alias(c) for c in names], F.col("spans").alias(extra)).mapInArrow(tidy(run), docs.schema)
