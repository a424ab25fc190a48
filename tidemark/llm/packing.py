"""Best-two-fit packing of tokenised documents.

Documents are tokenised, closed by an end id and cut into pieces of at most `size` ids; only the first piece of a
document may be shorter.  What packing decides depends on lengths alone, so it is planned on the histogram of piece
lengths, at most `size` numbers whatever the input: fill a bin greedily with the longest piece that fits, then take out
its smallest piece and put in the two unpacked pieces that fill the gap most tightly, if they fill it better.  The
finished bin is a pattern, repeated as often as the histogram allows.  Each piece then finds its place from its rank
among the pieces of its length: ranks are (rank within a block of rows) + (sum over the earlier blocks), both found
without ordering the table or gathering a length in one task.

Edge cases: null and empty texts are one piece of the end id; repeated rows and ids are packed separately; any length
is cut, so nothing is too long; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import small_batches, stored, tidy

SIZE, END = 2048, 0


# plan


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths from the longest) of each kind of bin."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    bins: list[tuple[int, tuple[int, ...]]] = []
    top = size
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return bins
        used: dict[int, int] = defaultdict(int)
        gap, picked = size, []
        have = np.flatnonzero(left)
        while gap:
            # the longest that fits and is not used up
            k = int(np.searchsorted(have, gap, side="right")) - 1
            while k >= 0 and left[have[k]] - used[int(have[k])] <= 0:
                k -= 1
            if k < 0:
                break
            one = int(have[k])
            many = min(gap // one, int(left[one]) - used[one])
            picked += [one] * many
            used[one] += many
            gap -= one * many
        if gap and picked:
            small = picked[-1]
            used[small] -= 1
            two = _best_two(left, used, gap + small, have)
            if two and gap + small - sum(two) < gap:
                picked[-1:] = two
                for x in two:
                    used[x] += 1
            else:
                used[small] += 1
        times = min(int(left[x]) // n for x, n in used.items() if n)
        for x, n in used.items():
            left[x] -= times * n
        bins.append((times, tuple(sorted(picked, reverse=True))))


def _best_two(left: np.ndarray, used: dict[int, int], gap: int, have: np.ndarray) -> list[int] | None:
    """Two lengths that together fill gap most tightly: a pointer goes down as the other goes up."""
    free = [(int(x), int(left[x]) - used.get(int(x), 0)) for x in have[: int(np.searchsorted(have, gap, side="right"))]]
    free = [f for f in free if f[1] > 0]
    best, found = 0, None
    i, j = 0, len(free) - 1
    while i <= j:
        total = free[i][0] + free[j][0]
        if total > gap or (i == j and free[i][1] < 2):
            j -= 1
            continue
        if total > best:
            best, found = total, [free[j][0], free[i][0]]
            if total == gap:
                break
        i += 1
    return found


class Placement:
    """Sequence and offset of the r-th piece of a length."""

    def __init__(self, bins: list[tuple[int, tuple[int, ...]]]) -> None:
        starts: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        seen: dict[int, int] = defaultdict(int)
        base = 0
        for times, lengths in bins:
            at = 0
            for x in lengths:
                starts[x].append((seen[x], base, at, times))
                seen[x] += times
                at += x
            base += times
        self.first = {x: [s[0] for s in v] for x, v in starts.items()}
        self.rows, self.total = dict(starts), base

    def of(self, length: int, rank: int) -> tuple[int, int]:
        first, base, at, _ = self.rows[length][bisect_right(self.first[length], rank) - 1]
        return base + rank - first, at


# tokens


@lru_cache(2)
def encoder(path: str):
    """Token ids as little-endian unsigned 32-bit bytes.

    The byte-level BPE of the tokenizers library is computed by tiktoken from the file's own vocabulary, which gives the
    same ids several times as fast; a text with a special token's string, a character above U+024F, or a file that is of
    another kind goes through tokenizers itself.
    """
    import json

    from tokenizers import Tokenizer

    slow = lru_cache(1)(lambda: Tokenizer.from_file(path))
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}

    def plain(text: str) -> np.ndarray:
        return np.array(slow().encode(text, add_special_tokens=False).ids, "<u4")

    if not (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"] and not model.get("ignore_merges")):
        return plain
    import re

    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    special = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(table[c] for c in t): k for t, k in model["vocab"].items() if t not in special}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding(f"own-{zlib.crc32(path.encode())}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile("|".join(["[^\x00-ɏ]", *map(re.escape, special)]))

    def run(text: str) -> np.ndarray:
        return plain(text) if odd.search(text) else np.array(fast.encode_ordinary(text), "<u4")

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, rank long"


def _cut(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        block = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.array([end], "<u4"))
                n = len(ids)
                first = n % size or min(n, size)
                edges = [0, *range(first, n + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), block, seen[b - a]))
                    seen[b - a] += 1
            if rows:
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank"])

    return run


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of each row of docs (doc_id, text), with rank: the number of earlier pieces of that length in the same block of rows."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_cut(path, size, end)), PIECES)


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # Written, so that ranks within blocks are fixed before anything is counted from them.
    cut = stored(pieces(docs, path, size, end), "packing-pieces")
    counts = stored(cut.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    before = counts.select("block", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    held = docs.sparkSession.sparkContext.broadcast(Placement(plan(histogram, size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for batch in batches:
            length, rank = batch.column("length").to_pylist(), batch.column("rank").to_pylist()
            found = [p.of(a, r) for a, r in zip(length, rank, strict=True)]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before, ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
