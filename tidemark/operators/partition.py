"""Partitions of equal size in quadkey order.

The exact rule closes a partition with the row whose running size first exceeds the limit.  That is a fold over the
order, so it runs within groups (quadkeys of a coarse zoom): each group is one task's work, sorted and streamed, never
held.  The approximate rule has no group: range partitions of about the limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.planar import ColumnOrName, col


def row_bytes(geometry: Sequence[str], other: float) -> Column:
    """Bytes of a row: those of its geometries (33 more each, as an object has) and the mean of the rest."""
    total = F.lit(float(other))
    for g in geometry:
        total = total + F.coalesce(F.octet_length(g), F.lit(0)) + 33
    return F.floor(total)


def fold(sizes: np.ndarray, limit: int, held: int, part: int) -> tuple[np.ndarray, int, int]:
    """Partition of each row, what the open one holds and its number."""
    out = np.empty(len(sizes), np.int64)
    start = 0
    while start < len(sizes):
        total = held + np.cumsum(sizes[start:])
        over = int(np.searchsorted(total, limit, side="right"))
        if over == len(total):
            out[start:] = part
            return out, int(total[-1]), part
        out[start : start + over + 1] = part
        start, held, part = start + over + 1, 0, part + 1
    return out, held, part


def equal_size(df: DataFrame, size: ColumnOrName, limit: int, order: Sequence[str], group: ColumnOrName | None = None) -> DataFrame:
    """df with part: the number of its partition within its group.

    Without a group the whole order is one group and one task; give one (a coarse quadkey) for large tables.
    """
    g = F.lit("") if group is None else col(group).cast("string")
    df = df.withColumn("__g", g).withColumn("__s", col(size).cast("long"))
    schema = f"{df.schema.simpleString()[7:-1]},part:bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, part = object(), 0, 0
        for batch in batches:
            groups, sizes = batch.column("__g").to_pylist(), batch.column("__s").fill_null(0).to_numpy(zero_copy_only=False)
            parts = np.empty(len(groups), np.int64)
            edges = [0, *[k for k in range(1, len(groups)) if groups[k] != groups[k - 1]], len(groups)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if groups[a] != last:
                    last, held, part = groups[a], 0, 0
                parts[a:b], held, part = fold(sizes[a:b], limit, held, part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts)], names=[*batch.schema.names, "part"])

    # One partition per group at least, each sorted by group and order, streamed in batches.
    dealt = df.repartition("__g").sortWithinPartitions("__g", *order)
    return dealt.mapInArrow(run, schema).drop("__g", "__s")


def write_equal_size(df: DataFrame, path: str, size: str, limit: int, order: Sequence[str], group: str) -> None:
    """Parquet folders by group and part, each of about the limit."""
    parts = equal_size(df, size, limit, order, group)
    parts.repartition(group, "part").sortWithinPartitions(*order).write.mode("overwrite").partitionBy(group, "part").parquet(path)


def write_ranges(df: DataFrame, path: str, order: str, bytes_per_row: float, limit: int) -> None:
    """Files of about the limit in the order of one column; the number of ranges follows the size of the table."""
    n = max(1, int(df.count() * bytes_per_row // limit) + 1)
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.mode("overwrite").option("maxRecordsPerFile", max(1, int(limit // bytes_per_row))).parquet(path)
