"""Exact deduplication by Grace hashing.

1. Each scan task normalises texts and folds equal ones into an open-addressing table that compares complete content.
   When the table is full it is emptied downstream, so a text that has millions of copies leaves a task a few times.
2. What is left is dealt by digest (the first level of partitioning; Spark's shuffle writes those files).  A task that
   holds more than `memory` bytes deals its records on to spill files by other bits of the digest, and those again,
   until a bucket fits the table.  Spill files live in the task's own temporary folder and go when it ends; a lost
   executor's task is simply run again.
3. Every document is joined to the row of its digest; a hot digest is one small row on the right side, so the adaptive
   skew join can split the left side.

4. Where rows repeat the id and the length of the row that stays, one of them is taken by the number of its row.

Edge cases: null text counts as empty, and all empty texts are equal; repeated rows each count in group_size, and one
of them is kept; a null doc_id stays only in a group without any other id of that length; other columns are ignored.  Two different texts of one SHA-256 raise an error.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, stored, tidy

_SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of distinct content that one table holds before it is emptied (scan) or dealt on to spill files (final).
SCAN_BYTES, TABLE_BYTES, FAN_OUT = 24 << 20, 96 << 20, 16
_LAST = 1 << 62


def _rank(chars: int, doc: int | None) -> tuple[int, int]:
    return -chars, _LAST if doc is None else doc


class ContentTable:
    """Open addressing with linear probing over (digest, content); equal means equal content."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.rows: list[list] = []
        self.bytes = 0

    def _place(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little") & (len(self.slots) - 1)

    def add(self, digest: bytes, content: bytes, chars: int, doc: int | None, n: int, ties: int) -> None:
        """n rows of a content, of which `ties` have this best rank."""
        mask, at = len(self.slots) - 1, self._place(digest)
        while (k := self.slots[at]) >= 0:
            row = self.rows[k]
            if row[0] == digest:
                if row[1] != content:
                    raise ValueError("two texts share a SHA-256 digest")
                row[4] += n
                new, old = _rank(chars, doc), _rank(row[2], row[3])
                if new < old:
                    row[2], row[3], row[5] = chars, doc, ties
                elif new == old:
                    row[5] += ties
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.rows)
        self.rows.append([digest, content, chars, doc, n, ties])
        self.bytes += len(content) + 200
        if 2 * len(self.rows) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for k, row in enumerate(self.rows):
                at = self._place(row[0])
                while self.slots[at] >= 0:
                    at = (at + 1) & (len(self.slots) - 1)
                self.slots[at] = k


PARTIAL = pa.schema([("sha", pa.binary()), ("content", pa.binary()), ("chars", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("ties", pa.int64())])


def _batches(rows: list[list], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    start, held = 0, 0
    for k, row in enumerate(rows):
        held += len(row[1] or b"")
        if held > size or k + 1 == len(rows):
            part = rows[start : k + 1]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            start, held = k + 1, 0


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _SPACES)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = ContentTable()
    for batch in batches:
        docs = batch.column(0).to_pylist()
        for doc, text in zip(docs, batch.column(1), strict=True):
            t = text.as_py() or ""
            content = normalised(t)
            table.add(hashlib.sha256(content).digest(), content, len(t), doc, 1, 1)
            if table.bytes > SCAN_BYTES:
                yield from _batches(table.rows, PARTIAL)
                table = ContentTable()
    yield from _batches(table.rows, PARTIAL)


GROUPS = "sha binary, keep_id long, keep_chars long, group_size long, ties long"


def _groups(table: ContentTable) -> Iterator[pa.RecordBatch]:
    if table.rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in table.rows], pa.binary()), *[pa.array([r[k] for r in table.rows], pa.int64()) for k in (3, 2, 4, 5)]],
            names=["sha", "keep_id", "keep_chars", "group_size", "ties"],
        )


def grace(records: Iterator[tuple], level: int, folder: str, memory: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """Groups of records (digest, content, chars, doc, n, ties).  Level k deals by bits 64+4k of the digest, which neither Spark's partitioning nor the table's slots use."""
    table, files = ContentTable(), None
    for r in records:
        if files is None:
            table.add(*r)
            if table.bytes <= memory or level >= 40:
                continue
            files = [open(os.path.join(folder, f"{level}-{os.urandom(4).hex()}"), "w+b") for _ in range(FAN_OUT)]
            held, table = table.rows, ContentTable()
        else:
            held = [r]
        for row in held:
            b = (row[0][8 + level // 2] >> (4 * (level % 2))) & (FAN_OUT - 1)
            pickle.dump(tuple(row), files[b], pickle.HIGHEST_PROTOCOL)
    if files is None:
        yield from _groups(table)
        return
    for f in files:
        f.seek(0)
        yield from grace(_read(f), level + 1, folder, memory)
        f.close()
        os.unlink(f.name)


def _read(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield tuple(batch.column(c)[k].as_py() for c in range(len(PARTIAL)))

    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        yield from grace(records(), 0, folder)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([hashlib.sha256(normalised(t)).digest() for t in texts], pa.binary())], names=["doc_id", "chars", "sha"]
        )


def groups(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: sha, keep_id, keep_chars, group_size, ties (rows of that id and length)."""
    partial = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(fold), "sha binary, content binary, chars long, doc long, n long, ties long")
    return partial.repartition("sha").mapInArrow(tidy(settle), GROUPS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_digests), "doc_id long, chars long, sha binary")
    # The groups come out dealt by digest; a written table lets the join deal both sides itself, so that it can split a hot digest.
    found = stored(groups(docs), "exact-groups")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    shown = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")]
    if not found.where("ties > 1").limit(1).count():
        return rows.join(found, "sha").withColumn("kept", best).select(*shown)
    # Rows that repeat the one that stays: a written table numbers them, as numbers change when a task runs again.
    numbered = stored(rows.join(found, "sha").withColumns({"best": best, "row": F.monotonically_increasing_id()}), "exact-rows")
    least = numbered.where("best and ties > 1").groupBy(F.col("sha").alias("of")).agg(F.min("row").alias("least"))
    joined = numbered.join(least, F.col("sha") == F.col("of"), "left")
    return joined.withColumn("kept", F.col("best") & (F.col("least").isNull() | (F.col("row") == F.col("least")))).select(*shown)
