"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of word shingles (classes up to 16, 32, 64
and so on). For a class, every stretch of a document a little longer than the
class's largest item is a set of its own: at each eighth shingle starts a window,
so a passage lies whole in one, and a window is near enough to the item in size
for MinHash however long the document is. Where an item and a window have the same
minimum under one of HASHES hash functions, the item is a candidate; its exact
containment, shared shingles by the item's shingles, is then counted over the
whole document. With the least containment of 0.8 in one stretch a class's
Jaccard similarity is at least 0.28, so a passage is missed with a chance of
about 0.72**HASHES, 3 in 100,000. Items of up to 8 shingles are looked up by each
of their shingles, without loss.

Items are taken in blocks of about ITEM_BLOCK items or ITEM_BYTES bytes, whichever
makes more, so that what is sent to tasks is bounded (a word and a blank have two
bytes at least, so hashes take four times the text at most); each block is one pass
over the documents. Counting items and hashing those of each block are jobs that run
while the plan is built.

Null ids of documents are passed through, items with null ids left out. Null and empty texts contain nothing, and null or empty items are contained in
nothing. A text or item of fewer words than a shingle is one shingle of all its
words. Repeated rows of documents give repeated rows of results, repeated items
one for each distinct id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import BLANK, LOWER, Texts, column, mix, pieces, shingle_sequence, shingles

HASHES = 32
ITEM_BLOCK, ITEM_BYTES = 10_000, 8 << 20
#: Shingles in a block of minima; windows start at each.
STEP = 8
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_TABLE = 1 << 20
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


@dataclass
class SizeClass:
    """Items of up to `most` shingles (`most` 0: looked up by shingle). values: sorted minima, owners: their items."""

    most: int
    values: np.ndarray
    owners: np.ndarray
    table: np.ndarray = field(repr=False)


def _lookup(values: np.ndarray, owners: np.ndarray, most: int) -> SizeClass:
    order = np.argsort(values, kind="stable")
    table = np.zeros(_TABLE, bool)
    table[values & np.uint64(_TABLE - 1)] = True
    return SizeClass(most, values[order], owners[order], table)


def size_classes(sets: list[np.ndarray]) -> list[SizeClass]:
    size = np.array([len(s) for s in sets])
    out, most = [], 2 * STEP
    tiny = np.flatnonzero((size > 0) & (size <= STEP))
    if len(tiny):
        out.append(_lookup(np.concatenate([sets[i] for i in tiny]), np.repeat(tiny, size[tiny]), 0))
    low = STEP
    while (size > low).any():
        these = np.flatnonzero((size > low) & (size <= most))
        if len(these):
            minima = np.array([[(sets[i] * f).min() for f in _FACTORS] for i in these], np.uint64)
            out.append(_lookup(minima.ravel(), np.repeat(these, HASHES), most))
        low, most = most, 2 * most
    return out


def _hits(c: SizeClass, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(row, item) of values that are an item's."""
    at = np.flatnonzero(c.table[values & np.uint64(_TABLE - 1)])
    v, r = values[at], rows[at]
    lo, hi = np.searchsorted(c.values, v, "left"), np.searchsorted(c.values, v, "right")
    n = hi - lo
    which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.stack([np.repeat(r, n), c.owners[which]], 1)


def candidates(seq: np.ndarray, off: np.ndarray, classes: list[SizeClass]) -> np.ndarray:
    """Distinct (row, item) that share a minimum."""
    rows = len(off) - 1
    found = [np.zeros((0, 2), np.int64)]
    large = [c for c in classes if c.most]
    for c in classes:
        if not c.most:
            found.append(_hits(c, seq, np.repeat(np.arange(rows), np.diff(off))))
    some = np.flatnonzero(np.diff(off))
    if large and len(some):
        n_blocks = -(-np.diff(off)[some] // STEP)
        pad = large[-1].most // STEP + 1
        at = np.concatenate([[0], np.cumsum(n_blocks + pad)])
        of = np.repeat(np.arange(len(some)), n_blocks)
        nth = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start, place = off[some][of] + STEP * nth, at[of] + nth
        row = some[of]
        for f in _FACTORS:
            m = np.full(at[-1], _MAX)
            m[place] = np.minimum.reduceat(seq * f, start)
            span, doubled = 1, m
            for c in large:
                wide = c.most // STEP + 1
                while 2 * span <= wide:
                    doubled = np.minimum(doubled[: len(doubled) - span], doubled[span:])
                    span *= 2
                last = len(doubled) - 1
                window = np.minimum(doubled[np.minimum(place, last)], doubled[np.minimum(place + wide - span, last)])
                found.append(_hits(c, window, row))
    return np.unique(np.concatenate(found), axis=0)


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of items with at least `percent` of their shingles in the document."""
    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    q = items.select(items[item_col].cast("long").alias("item_id"), items[item_text_col].cast("string").alias("text")).dropna().distinct()

    def item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = column(b.column(1))
            for lo, hi in pieces(off):
                sets = shingles(Texts(LOWER[buf[off[lo] : off[hi]]], off[lo : hi + 1]), BLANK, words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["item_id", "data"])

    n, size = q.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n_blocks = max(1, -(-n // ITEM_BLOCK), -(-(size or 0) // ITEM_BYTES))
    parts = []
    for k in range(n_blocks):
        block = q.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k) if n_blocks > 1 else q
        rows = sorted((r["item_id"], bytes(r["data"])) for r in block.mapInArrow(item_sets, "item_id long, data binary").collect())
        ids, sets = [r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows]
        parts.append(d.mapInArrow(_search(spark.sparkContext.broadcast((ids, sets)), words, percent), SCHEMA))
    return reduce(DataFrame.union, parts)


def _search(shared, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets = shared.value
        classes = size_classes(sets)
        for batch in batches:
            buf, off = column(batch.column(1))
            for lo, hi in pieces(off):
                seq, at = shingle_sequence(Texts(LOWER[buf[off[lo] : off[hi]]], off[lo : hi + 1]), BLANK, words)
                out: list[tuple[int, int, int, int]] = []
                own, mine = -1, None
                for r, i in candidates(seq, at, classes).tolist():
                    if r != own:
                        own, mine = r, np.unique(seq[at[r] : at[r + 1]])
                    place = np.minimum(np.searchsorted(mine, sets[i]), len(mine) - 1)
                    n = int((mine[place] == sets[i]).sum())
                    if 100 * n >= percent * len(sets[i]):
                        out.append((r, ids[i], len(sets[i]), n))
                if out:
                    r, item, size, n = (np.array(x, np.int64) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(r)), pa.array(item), pa.array(size), pa.array(n), pa.array(n / size)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run
