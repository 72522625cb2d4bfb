"""Arrays of a fixed size that tasks fill and Spark adds up; and groups of sorted streams."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 64
#: Tasks whose arrays are added first: a group holds as many parts, or one for each such set of tasks.
TASKS = 512


def emit(x: np.ndarray) -> list[tuple[int, int, bytes]]:
    """An int array in PARTS rows (part, number of the task, data); parts of zeros are left out, the rest are packed."""
    task = TaskContext.get().partitionId()
    return [(k, task, zlib.compress(p.tobytes(), 1)) for k, p in enumerate(np.array_split(x, PARTS)) if p.any()]


def total(rows: DataFrame, size: int, kind: type = np.int64) -> np.ndarray:
    """The sum of emitted arrays, from rows (part int, task int, data binary), in two rounds. Its size is the same for any input."""

    def add(table: pa.Table) -> pa.Table:
        out = None
        for d in table.column("data").to_pylist():
            x = np.frombuffer(zlib.decompress(d), kind)
            out = x.copy() if out is None else out + x
        return pa.table({"part": table.column("part").slice(0, 1), "data": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    schema = "part int, data binary"
    some = rows.select("part", "data", F.floor(rows["task"] / TASKS).alias("set")).groupBy("part", "set").applyInArrow(add, schema)
    out = np.array_split(np.zeros(size, kind), PARTS)
    for r in some.groupBy("part").applyInArrow(add, schema).collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(r["data"]), kind)
    return np.concatenate(out)


def runs(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order that brings equal keys together, and the (first, end) of each run in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))[: len(k)]
    return order, list(zip(at.tolist(), [*at[1:].tolist(), len(k)], strict=True)) if len(k) else []


def packed(kind: int, keys: np.ndarray, parts: tuple[np.ndarray, ...]) -> list[tuple[int, int, bytes]]:
    """(key, kind, bytes of the parts one after another) for each key."""
    order, spans = runs(keys)
    parts = tuple(x[order] for x in parts)
    return [(int(keys[order[a]]), kind, b"".join(x[a:b].tobytes() for x in parts)) for a, b in spans]


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal first `n_keys` columns, of a stream sorted by them."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        at = [*np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            this = tuple(k[lo] for k in keys)
            if this != key and held:
                yield key, held
                held = []
            key = this
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, held


def by_key(df: DataFrame, keys: list[str], run: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`run` on each group of `keys`, from sorted partitions: one stream for many small groups."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in groups(batches, len(keys)):
            yield from run(key, pa.Table.from_batches(held))

    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*map(F.col, keys)).sortWithinPartitions(*keys).mapInArrow(each, schema)
