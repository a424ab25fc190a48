"""Line deduplication by a segment-partition edit join.

Lines are what \\n separates, trimmed of [\\x20\\x09-\\x0D].  Lines are linked when equal, and lines of at least `NEAR_CHARS`
code points also when within `TAU` edits: in shorter ones two edits leave too little of a line to call it the same.
Classes are the components of links.  Of each class the first line (by doc_id, then its place) stays, and the others are
taken out of their documents.  Blank lines are left alone.

1. Every line that a task has not met before is cut into TAU + 1 segments (its index entries), and asks, for each length
   that it may be matched with, for the substrings that multi-match-aware selection leaves.  Only 64-bit keys travel.
2. Keys that an index entry shares with another line leave candidates; their lines are read again, once each.
3. Candidates meet under their key, cut into cells of blocks where a key has very many; a banded bit-parallel edit
   distance decides, lines already connected are not compared, and a spanning star leaves the task.
4. Lines without links, the short ones among them, are classed by equality of their hashes in one aggregate.
   Components, the first line of each class, and its other lines follow by joins on line hashes (128 bits).

Edge cases: null text has one empty line; equal rows (same id and text) are one document, and each gets its result; an
id with several texts counts as several documents in the order of a hash; a null id comes first; an empty table gives an
empty result; other columns pass through dedup() untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.common import release, small, small_batches, stored, tidy
from tidemark.llm.components import connected

TAU, MIN_CHARS, NEAR_CHARS = 2, 1, 20
_TRIM = " \t\x0b\x0c\r"
#: Lines that a task remembers as already cut.
REMEMBERED = 1_000_000


# segments


def parts(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, size) of the tau + 1 segments of a line."""
    k, more = divmod(length, tau + 1)
    sizes = [k + (i > tau - more) for i in range(tau + 1)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


@lru_cache(1 << 15)
def cuts(length: int, tau: int) -> tuple[tuple[int, int, int, bool], ...]:
    """(start, end, seed, index entry) of the substrings of a line of that length; the seed holds the indexed length and segment."""
    out = []
    for other in range(max(tau + 1, length - tau), length + 1):
        more = length - other
        for i, (p, size) in enumerate(parts(other, tau)):
            low = max(0, p - i, p + more - (tau - i))
            high = min(length - size, p + i, p + more + (tau - i))
            out += [(a, a + size, other * (tau + 1) + i, not more and a == p) for a in range(low, high + 1)]
    return tuple(out)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _keys(tau: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        h = xxhash.xxh64_intdigest
        keys: list[int] = []
        ids: list[int] = []
        index: list[bool] = []

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(index, pa.bool_())], names=["key", "h1", "indexed"])
            keys.clear(), ids.clear(), index.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    line = line.strip(_TRIM)
                    n = len(line)
                    if n < min_chars:
                        continue
                    one = h(line, 42)
                    if one in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(one)
                    plan = cuts(n, tau)
                    keys += [h(line[a:b], seed) for a, b, seed, _ in plan]
                    index += [x[3] for x in plan]
                    ids += [one] * len(plan)
                if len(keys) > 200_000:
                    yield full()
        if keys:
            yield full()

    return run


def _whole_runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut where the first `by` columns change."""
    held: list[np.ndarray] | None = None
    for batch in (*batches, None):
        if batch is not None:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            same = np.logical_and.reduce([held[k] == held[k][-1] for k in range(by)])
            cut = int(np.argmax(same))
        else:
            cut = 0 if held is None else len(held[0])
        if cut:
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, h1, indexed in _whole_runs(batches, 1):
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        some = (np.maximum.reduceat(h1, edge) != np.minimum.reduceat(h1, edge)) & np.logical_or.reduceat(indexed, edge)
        keep = np.repeat(some, np.diff(np.r_[edge, len(key)]))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(h1[keep]), pa.array(indexed[keep])], names=["key", "h1", "indexed"])


# verification


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance is at most tau: the common ends go, then a bit-parallel band of 2 * tau + 1 diagonals moves along (Hyyro 2003)."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > tau:
        return False
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not b:
        return len(a) <= tau
    # Rows are a (longer), columns b.  Bit k of the band at column j stands for row j - tau + k.
    width = 2 * tau + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    m, n = len(a), len(b)
    for i in range(min(tau, m)):
        where[a[i]] = where.get(a[i], 0) | 1 << i
    # cells above row 1 count down to it, so that the band starts as column 0 of the table
    vp, vn = mask & ~((1 << tau) - 1), 0
    score = tau  # at the band's lowest row
    # `where` holds rows as bits of an integer that is shifted to the band's first row
    for j in range(n):
        low = j + tau
        if low < m:
            where[a[low]] = where.get(a[low], 0) | 1 << low
        pm = where.get(b[j], 0)
        shift = j - tau
        pm = (pm >> shift if shift >= 0 else pm << -shift) & mask
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn) & mask
        hp = vn | (mask & ~(d0 | vp))
        hn = d0 & vp
        x = d0 >> 1
        if not d0 & top:
            score += 1
        vp = hn | (mask & ~(x | hp))
        vn = x & hp
    # walk from the lowest row of the band at the last column (row n + tau) up to row m
    at = tau + n
    bit = width - 2  # the deltas already stand for the next column
    while at > m:
        bit_value = 1 << bit
        score -= bool(vp & bit_value) - bool(vn & bit_value)
        bit -= 1
        at -= 1
    return score <= tau


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _verify(tau: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for key, cell, h1, indexed, line in _whole_runs(batches, 2):
            edge = [*np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]).tolist(), len(key)]
            for s, e in zip(edge, edge[1:]):
                if e - s < 2:
                    continue
                rows: dict[int, tuple[str, bool]] = {}
                for k in range(s, e):
                    one = int(h1[k])
                    rows[one] = line[k], bool(indexed[k]) or (one in rows and rows[one][1])
                listed = [(one, t) for one, (t, ix) in rows.items() if ix]
                for one, (text, _) in rows.items():
                    for other, t in listed:
                        if one != other and (a := root(one)) != (b := root(other)) and within(text, t, tau):
                            up[max(a, b)] = min(a, b)
            if len(up) > 500_000:
                yield _star(up, root)
                up.clear()
        if up:
            yield _star(up, root)

    return run


def _star(up: dict[int, int], root) -> pa.RecordBatch:
    nodes = [x for x in list(up) if root(x) != x]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])


# classes


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, uid, pos, line of each line, trimmed."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("uid"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(_TRIM)))


def _hashes() -> tuple[Column, Column]:
    return F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")


def line_links(docs: DataFrame, tau: int = TAU, min_chars: int = NEAR_CHARS, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between hashes of different lines that connect what links within tau connect, and the lines' (h1, h2)."""
    small_batches(docs.sparkSession)
    keys = docs.select("text").mapInArrow(tidy(_keys(tau, max(min_chars, tau + 1))), "key long, h1 long, indexed boolean")
    near = stored(keys.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_candidates), "key long, h1 long, indexed boolean").distinct(), "lines-candidates")
    ids = stored(near.select("h1").distinct(), "lines-ids")
    lines = _lines(docs).where(F.length("line") >= min_chars).select(*_hashes(), "line")
    text = stored(lines.join(small(ids, 8), "h1", "left_semi").distinct(), "lines-texts")
    large = stored(near.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "lines-large")
    rows = near.join(text.select("h1", "line"), "h1")
    blocks = F.ceil(F.col("n") / block).cast("long")
    own = F.pmod("h1", blocks)
    cells = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(own, j) * (1 << 20) + F.greatest(own, j)))
    rows = rows.join(small(large, 16), "key", "left").select("key", F.explode(cells).alias("cell"), "h1", "indexed", "line")
    edges = rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(tidy(_verify(tau)), "a long, b long")
    return edges, text.select("h1", "h2")


def line_classes(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, uid, pos, class_id, kept of each line of min_chars in a class of two lines or more; kept: it is the first of its class.  Lines under near_chars are classed by equality alone."""
    edges, known = line_links(docs, tau, max(min_chars, near_chars))
    named = connected(edges)
    named = named.unionByName(named.select(F.col("component").alias("node"), "component")).distinct().withColumnRenamed("node", "h1")
    named = stored(known.join(named, "h1"), "lines-classes")
    occurs = _lines(docs).where(F.length("line") >= min_chars).select("doc_id", "uid", "pos", *_hashes())
    # A line linked to others goes by its class, another by both its hashes.
    occurs = occurs.join(small(named, 24), ["h1", "h2"], "left").select("doc_id", "uid", "pos", F.coalesce("component", "h1").alias("class_id"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("k2"))
    occurs = stored(occurs, "lines-occurrences")
    place = F.struct("doc_id", "uid", "pos")
    # Equal rows are one document, so places are counted as first and last.
    first = occurs.groupBy("class_id", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("class_id", "k2", "first")
    first = stored(first, "lines-first")
    found = occurs.join(first, ["class_id", "k2"])
    return found.select("doc_id", "uid", "pos", "class_id", (place == F.col("first")).alias("kept"))


def dedup(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """The columns of docs with the lines taken out of text, and line_classes (pos, class_id, kept of its lines that have others; left out where docs has a column of that name)."""
    classes = stored(line_classes(docs, tau, min_chars), "lines-found")
    per = classes.groupBy("doc_id", "uid").agg(F.array_sort(F.collect_set(F.struct("pos", "class_id", "kept"))).alias("line_classes"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("uid"))
    per = per.withColumnRenamed("doc_id", "per_id").withColumnRenamed("uid", "per_uid")
    # the arrays hold a row of classes each
    joined = rows.join(small(per, 24, classes.count()), F.col("doc_id").eqNullSafe(F.col("per_id")) & (F.col("uid") == F.col("per_uid")), "left")
    drop = F.transform(F.filter("line_classes", lambda c: ~c["kept"]), lambda c: c["pos"])
    some = F.coalesce(F.size(drop) > 0, F.lit(False))
    text = F.when(some, without_lines(F.col("row.text"), drop)).otherwise(F.col("row.text"))
    names = docs.columns
    listed = F.coalesce("line_classes", F.array().cast("array<struct<pos:int,class_id:bigint,kept:boolean>>"))
    return joined.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names], *([] if "line_classes" in names else [listed.alias("line_classes")]))


@F.pandas_udf(StringType())
def without_lines(texts, drops):
    import pandas as pd

    out = []
    for text, drop in zip(texts, drops, strict=True):
        if text is None or drop is None:
            out.append(text)
            continue
        gone = set(drop)
        out.append("\n".join([x for k, x in enumerate(text.split("\n")) if k not in gone]))
    release()
    return pd.Series(out, dtype=object)


def report(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, line_classes ("pos:class:kept" joined by commas), kept_sha256."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = dedup(plain.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")), tau, min_chars)
    classes = F.array_join(F.transform("line_classes", lambda c: F.concat_ws(":", c["pos"].cast("string"), c["class_id"].cast("string"), F.when(c["kept"], "1").otherwise("0"))), ",")
    return df.select("doc_id", "n_lines", F.size(F.filter("line_classes", lambda c: ~c["kept"])).cast("long").alias("n_dropped"), classes.alias("line_classes"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))
