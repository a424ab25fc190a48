"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made in one scan.  Equal ones are one node from there.  With 64 bits in m segments, two fingerprints
that differ in at most r bits differ, for r = m * q + s, in at most q bits of one of the first s + 1 segments or in at
most q - 1 of another.  So each node is filed under the value of each segment, and asks for the values in the small
Hamming ball around it; of a ball only flips that set at least as many bits as they clear are asked for, as the other
side asks for the rest.  Rows of a segment value are brought together, complete distances are verified there, and only
a spanning star of the links found leaves the task: connectivity is all that components need, so no group is written as
pairs.  A value with more than `block` rows is spread over cells, one for each two of its blocks.  With very many
nodes the tables are choices of several segments at once, so that the rows of one value stay few; the links are the same.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows and ids are
fine; rows with a null doc_id are linked, but do not name a component (it is null if it has no other id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, small_batches, stored, tidy
from tidemark.llm.components import connected, stars

#: counts[byte, bit] of a byte value
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)
#: Ids of nodes without any doc_id start here.
NO_ID = 1 << 62


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        return h(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    table = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (table @ _BITS) > len(hashes)).ravel()
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])


def layout(nodes: int, distance: int) -> list[tuple[int, int]]:
    """(mask, radius) of each table: fingerprints within `distance` are within radius under one of the masks at least.

    Up to 2**23 nodes, three segments with balls; beyond, all choices of j of distance + j segments, of which j are equal
    at least: with j of 3 and more the masks have over 27 bits, and a node has 35 rows, then 70.
    """
    if nodes <= 1 << 23:
        m = 3
        q, s = divmod(distance, m)
        widths = [64 // m + (k < 64 % m) for k in range(m)]
        return [(((1 << w) - 1) << sum(widths[:k]), q if k <= s else q - 1) for k, w in enumerate(widths)]
    j = 3 if nodes <= 1 << 29 else 4
    m = distance + j
    ends = [64 * k // m for k in range(m + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:])]
    return [(sum(chosen), 0) for chosen in combinations(parts, j)]


def _file(tables: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for k, (mask, radius) in enumerate(tables):
                value = fp & np.uint64(mask)
                bits = [b for b in range(64) if mask >> b & 1]
                for size in range(radius + 1):
                    for flips in combinations(bits, size):
                        flip = np.uint64(sum(1 << f for f in flips))
                        asks = 2 * np.bitwise_count(value & flip) <= size if size else np.ones(len(fp), bool)
                        # the table's number is stirred in; rows that only share a key are told apart by their distance
                        key = ((value ^ flip) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1)).view(np.int64)[asks]
                        if len(key):
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[asks]), pa.array(fp.view(np.int64)[asks]), pa.array(np.full(len(key), size > 0))], names=["key", "node", "fp", "ask"])

    return run


def _pairs_of_run(fp: np.ndarray, node: np.ndarray, ask: np.ndarray, distance: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of the links in one large run."""
    a = b = np.zeros(0, np.int64)
    for start in range(0, len(fp), rows):
        part = slice(start, start + rows)
        near = np.bitwise_count(fp[part, None] ^ fp[None, :]) <= distance
        near &= ~(ask[part, None] & ask[None, :])
        i, j = np.nonzero(near)
        a, b = stars(np.concatenate([a, node[part][i]]), np.concatenate([b, node[j]]))
    return a, b


def _verify(distance: int):
    def links(key, node, fp, ask) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        length = np.diff(np.r_[edge, len(key)])
        run = np.repeat(np.arange(len(edge)), length)
        found_a, found_b = [], []
        at = np.flatnonzero((length[run] > 1) & (length[run] <= 64))
        shift = 1
        while len(at):
            at = at[at + shift < len(run)]
            at = at[run[at] == run[at + shift]]
            other = at + shift
            hit = (np.bitwise_count(fp[at] ^ fp[other]) <= distance) & ~(ask[at] & ask[other]) & (node[at] != node[other])
            found_a.append(node[at[hit]])
            found_b.append(node[other[hit]])
            shift += 1
        for k in np.flatnonzero(length > 64):
            part = slice(edge[k], edge[k] + length[k])
            a, b = _pairs_of_run(fp[part], node[part], ask[part], distance)
            found_a.append(a)
            found_b.append(b)
        a, b = np.concatenate(found_a or [np.zeros(0, np.int64)]), np.concatenate(found_b or [np.zeros(0, np.int64)])
        return stars(a, b) if len(a) else (a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in (*batches, None):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                cols = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1), batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64), batch.column(4).to_numpy(zero_copy_only=False)]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
                # the last run may go on in the next batch
                same = (held[0] == held[0][-1]).all(axis=1)
                cut = int(np.argmax(same))
            else:
                cut = 0 if held is None else len(held[0])
            if held is None or not cut:
                continue
            a, b = links(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_links(nodes: DataFrame, distance: int = 4, block: int = 8192) -> DataFrame:
    """Edges (a, b) that connect what links of at most `distance` bits connect, over nodes (fp, node) of different fp."""
    segments = layout(nodes.count(), distance)
    rows = nodes.select("fp", "node").mapInArrow(tidy(_file(segments)), "key long, node long, fp long, ask boolean")
    large = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "simhash-large")
    n_large = large.count()
    if n_large:
        large = F.broadcast(large) if n_large <= 10_000 else large
        blocks = F.ceil(F.col("n") / block).cast("long")
        own = F.pmod(F.xxhash64("node"), F.coalesce(blocks, F.lit(1).cast("long")))
        rows = rows.join(large, "key", "left").select(
            "key",
            F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(own, j) * (1 << 20) + F.greatest(own, j)))).alias("cell"),
            "node", "fp", "ask",
        )
    else:
        rows = rows.select("key", F.lit(0).cast("long").alias("cell"), "node", "fp", "ask")
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(tidy(_verify(distance)), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, block: int = 8192) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    prints = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_fingerprints), "doc_id long, fp long"), "simhash-prints")
    none = F.lit(NO_ID) + F.pmod("fp", F.lit(1 << 61))
    nodes = stored(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), none).alias("node")), "simhash-nodes")
    of_node = connected(near_links(nodes, distance, block))
    named = nodes.join(of_node, "node", "left").select("fp", F.coalesce("component", "node").alias("c"))
    named = stored(named, "simhash-components")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("c") < NO_ID, F.col("c")).alias("component_id")
    )


def representatives(docs: DataFrame, distance: int = 4, block: int = 8192) -> DataFrame:
    """One row of docs for each component of fingerprints: one that has its smallest doc_id (of several texts with that id, the least by hash; ids before null), whether or not the component has ids."""
    small_batches(docs.sparkSession)
    ident = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    prints = docs.select(ident[0], "text", *ident[1:]).mapInArrow(tidy(_fingerprints), "doc_id long, fp long, h1 long, h2 long")
    # Rows of one id and text are counted as one.
    prints = stored(prints.groupBy("doc_id", "fp", "h1", "h2").agg(F.count(F.lit(1)).alias("n")), "simhash-rows")
    # A fingerprint is its own node here: ids may be missing, or shared by different texts.
    nodes = stored(prints.select("fp", F.col("fp").alias("node")).distinct(), "simhash-nodes")
    of_node = stored(connected(near_links(nodes, distance, block)), "simhash-components")
    rows = prints.join(of_node.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("component", "fp").alias("c"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "n").alias("row"))
    names = [fresh(docs, k) for k in ("keep_id", "keep_h1", "keep_h2")]
    keep = rows.groupBy("c").agg(F.min("row").alias("row")).select(*[F.col(f"row.{k}").alias(v) for k, v in zip(("doc_id", "h1", "h2"), names, strict=True)], "row.n")
    keep = stored(keep, "simhash-keep")
    of_row = [F.col("doc_id").cast("long"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    same = of_row[0].eqNullSafe(F.col(names[0])) & (of_row[1] == F.col(names[1])) & (of_row[2] == F.col(names[2]))
    kept = docs.join(keep.where("n = 1").drop("n"), same, "left_semi")
    repeated = keep.where("n > 1").drop("n")
    if not repeated.limit(1).count():
        return kept
    one = docs.join(repeated, same).groupBy(*names).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return kept.unionByName(one.select("row.*"))
