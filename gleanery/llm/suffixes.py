"""Suffix-array dedup: long byte strings that repeat anywhere in the corpus.

A byte goes if a string of `length` bytes that covers it also starts earlier, in a
document with a smaller doc_id or earlier in the same one. All strings are judged
on the input.

Suffix arrays are built where repeats can be. The least hash of the GRAM-byte
strings inside a window of `length` bytes (its anchor) is the same for equal
windows, so
1. a pass emits every text's anchors, dealt by hash; those of two texts, or of two
   places of one, come back to the texts that have them. A task sends two texts at
   most for an anchor and answers for those it holds itself, so a very common
   anchor grows with the tasks and not with the texts;
2. stretches of windows with one such anchor go, as packed bytes, to the anchor's
   bucket. Of equal stretches in one task only the first is sent, the rest is known
   to go, and only its place is sent;
3. a bucket sorts the suffixes of its stretches in two stages: those smaller than
   their successors are sorted directly, the others induced by scans over the
   buckets of first bytes. Neighbours with a common prefix of `length` bytes are
   equal windows, of which the first place stays;
4. windows that go make each text's removed runs.
Later copies of a whole text go as a whole without being compared. Buckets are as
many as the bytes of all texts need at BUCKET bytes each, which one job counts while
the plan is built.

Null texts are empty. Null ids are compared with nothing and lose nothing. Rows
with equal doc_id and different texts are ordered by a hash of the text; equal
rows are one document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import by_key, packed, runs
from .textbytes import Texts, column, mix, pieces

GRAM = 16
#: Bytes of texts for each bucket; a bucket gets anchors of a third of that, and stretches of what repeats.
BUCKET = 8 << 20
_HELD = 8 << 20
#: Suffixes that are copied out at once to be sorted.
_SLICE = 1 << 16
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding(x: np.ndarray, w: int, best: np.ufunc, fill) -> np.ndarray:
    """best over x[i:i+w] for each i that has w values."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = np.full(-(-n // w) * w, fill, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - w + 1], ahead[w - 1 : n])


class Anchors:
    """Of a piece: the anchor of each window (`hash`; windows start at each byte), and the places of anchors."""

    def __init__(self, t: Texts, length: int):
        n, w = len(t.buf), length - GRAM + 1
        self.row_end = np.repeat(t.off[1:], np.diff(t.off))
        place = np.arange(n)
        if n < length:
            self.valid, self.hash = np.zeros(0, bool), np.zeros(0, np.uint64)
            self.at, self.at_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        gram = t.hashes(place[: n - GRAM + 1], place[GRAM - 1 :] + 1)
        self.hash = sliding(gram, w, np.minimum, _MAX)
        self.valid = place[: len(self.hash)] + length <= self.row_end[: len(self.hash)]
        m = np.where(self.valid, self.hash, np.uint64(0))
        padded = np.zeros(len(m) + 2 * (w - 1), np.uint64)
        padded[w - 1 : w - 1 + len(m)] = m
        most = sliding(padded, w, np.maximum, np.uint64(0))[: len(gram)]
        self.at = np.flatnonzero((most == gram) & (gram > 0))
        self.at_hash = gram[self.at]

    def stretches(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows of one row with one anchor: first window, windows, anchor."""
        n = len(self.hash)
        first = self.valid.copy()
        first[1:] &= (self.hash[1:] != self.hash[:-1]) | ~self.valid[:-1]
        start = t.off[:-1]
        start = start[start < n]
        first[start] = self.valid[start]
        at = np.flatnonzero(first)
        stop = np.flatnonzero(~self.valid)
        end = np.minimum(np.append(at[1:], n), np.append(stop, n)[np.searchsorted(stop, at)])
        return at, end - at, self.hash[at]


def first_places(text: np.ndarray, off: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the strings text[off[k]:off[k+1]] by a suffix array: places of all windows, and whether an equal one has a smaller key.

    key: an order number of each byte's place.
    """
    n, begin, end = len(text), off[:-1], off[1:]
    place = np.arange(n, dtype=np.int32)  # places fit in 32 bits; a bucket's arrays are what a task's memory is made of
    last = np.zeros(n, bool)
    last[end - 1] = True
    # types: B, smaller than the successor; A, greater (an end is smaller than all)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[last] = -1
    smaller = step[np.minimum.accumulate(np.where(step != 0, place, n)[::-1])[::-1]] > 0
    del step
    final = end - length  # last windows
    upto = np.minimum(np.minimum.accumulate(np.where(smaller, place, n)[::-1])[::-1][final], end - 1)
    del place

    def between(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        edge = np.zeros(n + 1, np.int8)
        np.add.at(edge, first, 1)
        np.add.at(edge, stop, -1)
        return np.cumsum(edge, dtype=np.int8)[:n] > 0

    needed = between(begin, upto + 1)
    # first stage: B suffixes sorted directly by their bytes
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(length, np.uint8)]), length)
    b = np.flatnonzero(needed & smaller).astype(np.int32)
    # slices of equal first two bytes, so few suffixes are copied out at a time
    pair = (text[b].astype(np.uint16) << 8) | np.where(last[b], 0, text[np.minimum(b + 1, n - 1)])
    order = np.argsort(pair, kind="stable")
    b, pair = b[order], pair[order]
    cut = np.append(np.flatnonzero(np.append(True, pair[1:] != pair[:-1])), len(b)) if len(b) else np.zeros(1, np.int64)
    del order, pair
    lo = 0
    while lo < len(b):
        hi = int(cut[max(np.searchsorted(cut, lo + _SLICE, "right") - 1, np.searchsorted(cut, lo, "right"))])
        mine = b[lo:hi]
        rows = views[mine]
        own_end = end[np.searchsorted(end, mine, "right")]
        for i in np.flatnonzero(mine + length > own_end).tolist():
            rows[i, own_end[i] - mine[i] :] = 0
        b[lo:hi] = mine[np.argsort(np.ascontiguousarray(rows).view(f"S{length}").ravel(), kind="stable")]
        lo = hi
    b_at = np.searchsorted(text[b], np.arange(257))
    # second stage: A suffixes, bucket by bucket of the first byte, in the order of their successors
    a = np.flatnonzero(needed & ~smaller).astype(np.int32)
    a = a[np.argsort(text[a], kind="stable")]
    a_at = np.searchsorted(text[a], np.arange(257))
    del smaller
    rank = np.full(n + 1, -1, np.int32)
    order: list[np.ndarray] = []
    done = 0
    for c in range(256):
        mine = a[a_at[c] : a_at[c + 1]]
        if len(mine):
            ready = mine[last[mine] | (text[np.minimum(mine + 1, n - 1)] < c)]
            ready = ready[np.argsort(np.where(last[ready], -1, rank[ready + 1]), kind="stable")]
            while len(ready):
                rank[ready] = np.arange(done, done + len(ready))
                done += len(ready)
                order.append(ready)
                ready = ready[ready > 0] - 1
                ready = ready[needed[ready] & (text[ready] == c) & ~last[ready]]
        mine = b[b_at[c] : b_at[c + 1]]
        rank[mine] = np.arange(done, done + len(mine))
        done += len(mine)
        order.append(mine)
    del rank, a, b
    order = np.concatenate(order)
    order = order[between(begin, np.maximum(final + 1, begin))[order]]
    # common prefixes of neighbours, as far as they count
    same = np.zeros(len(order), bool)
    for lo in range(1, len(order), _SLICE):
        hi = min(len(order), lo + _SLICE)
        same[lo:hi] = (views[order[lo:hi]] == views[order[lo - 1 : hi - 1]]).all(1)
    group = np.flatnonzero(~same)
    own = key[order]
    least = np.minimum.reduceat(own, group) if len(group) else own
    return order, own > np.repeat(least, np.diff(np.append(group, len(order))))


def _merge(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of spans, sorted by (doc, a)."""
    if not len(doc):
        return doc, a, b
    reach = np.maximum.accumulate(b + doc * (np.int64(1) << 40)) - doc * (np.int64(1) << 40)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], a[at], np.maximum.reduceat(b, at)


_SPANS = "doc_id long, mark long, a long, b long"


def _span_batch(doc_id: np.ndarray, mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_id, mark, a, b)], names=["doc_id", "mark", "a", "b"])


def _sort_bucket(key: tuple, table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Spans that go: those known before, and from a bucket's stretches."""
    head, text = [], []
    unpack = zstandard.ZstdDecompressor()
    for h, d in zip(table.column("head").to_pylist(), table.column("data").to_pylist(), strict=True):
        places = np.frombuffer(h, np.int64).reshape(4, -1)
        if d is None:
            yield _span_batch(*places)
        else:
            head.append(places)
            text.append(np.frombuffer(unpack.decompress(d), np.uint8))
    if not head:
        return
    head, text = np.concatenate(head, 1), np.concatenate(text)
    doc_id, mark, start, size = head
    off = np.concatenate([[0], np.cumsum(size)])
    by = np.lexsort((mark, doc_id))
    new = np.ones(len(by), bool)
    new[1:] = (doc_id[by][1:] != doc_id[by][:-1]) | (mark[by][1:] != mark[by][:-1])
    doc = np.empty(len(by), np.int64)
    doc[by] = np.cumsum(new) - 1
    ids = by[new]
    order_no = np.repeat((doc << 40) + start - off[:-1], size)
    order_no += np.arange(len(text), dtype=np.int32)
    place, gone = first_places(text, off, order_no, length)
    k = np.sort(order_no[place[gone]])
    d, a = k >> 40, k & ((1 << 40) - 1)
    d, a, b = _merge(d, a, a + length)
    yield _span_batch(doc_id[ids[d]], mark[ids[d]], a, b)


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, mark, a, b): bytes [a, b) of first copies that go. docs: doc_id, text, mark; ids not null."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) + n_bytes // BUCKET
    bucket_of = lambda h: (h >> np.uint64(32)) % np.uint64(buckets)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0

        def flush():
            h, mark = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((mark, h))
            h, mark = h[order], mark[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (mark[1:] != mark[:-1])
            h, mark = h[fresh], mark[fresh]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))[: len(h)]
            run = np.diff(np.append(start, len(h)))
            # anchors that several texts of this task have are answered here; two of the texts speak for all of them
            send = np.arange(len(h)) - np.repeat(start, run) < 2
            known = np.repeat(run > 1, run)
            rows = packed(0, bucket_of(h[send]), (h[send].astype(np.uint32), mark[send]))
            rows += packed(1, mark[known].view(np.uint64) % np.uint64(buckets), ((bucket_of(h[known]) << np.uint64(32)) | (h[known] & np.uint64(0xFFFFFFFF)), mark[known]))
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "data"])

        for batch in batches:
            buf, off = column(batch.column(0))
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in pieces(off):
                t = Texts(buf[off[lo] : off[hi]], off[lo : hi + 1])
                x = Anchors(t, length)
                row = np.searchsorted(t.off, x.at, "right") - 1
                order = np.lexsort((x.at_hash, row))
                h, row = x.at_hash[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                twice = np.zeros(len(h), bool)
                twice[:-1] = new[:-1] & ~new[1:]
                mark = marks[lo:hi][row]
                # an anchor at two places of a text speaks as a second text would
                held.append((np.concatenate([h[new], h[twice]]), np.concatenate([mark[new], mark[twice] ^ 1])))
                n += len(held[-1][0])
                if n > 1_000_000:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def shared(key, table):
        tok, mark, whole, told = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [], []
        for kind, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            if kind:
                m = len(d) // 16
                whole.append(np.frombuffer(d, np.uint64, m))
                told.append(np.frombuffer(d, np.int64, m, 8 * m))
            else:
                m = len(d) // 12
                tok.append(np.frombuffer(d, np.uint32, m))
                mark.append(np.frombuffer(d, np.uint8, 8 * m, 4 * m).copy().view(np.int64))
        tok, mark = np.concatenate(tok), np.concatenate(mark)
        order = np.lexsort((mark, tok))
        tok, mark = tok[order], mark[order]
        fresh = np.ones(len(tok), bool)
        fresh[1:] = (tok[1:] != tok[:-1]) | (mark[1:] != mark[:-1])
        tok, mark = tok[fresh], mark[fresh]
        start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))[: len(tok)]
        run = np.diff(np.append(start, len(tok)))
        keep = np.repeat(run > 1, run)
        whole.append((np.uint64(key[0]) << np.uint64(32)) | tok[keep].astype(np.uint64))
        told.append(mark[keep])
        whole, mark = np.concatenate(whole), np.concatenate(told)
        order = np.argsort(mark, kind="stable")
        mark, whole = mark[order], whole[order]
        at = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])) if len(mark) else np.zeros(0, np.int64)
        stop = np.append(at[1:], len(mark))
        for i in range(0, len(at), 10_000):
            part = list(zip(at[i : i + 10_000].tolist(), stop[i : i + 10_000].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(mark[at[i : i + 10_000]]), pa.array([whole[a:b].tobytes() for a, b in part], pa.binary())], names=["mark", "anchors"])

    found = by_key(docs.select("text", "mark").mapInArrow(anchors, "bucket int, kind int, data binary"), ["bucket"], shared, "mark long, anchors binary")
    found = found.groupBy("mark").agg(F.collect_list("anchors").alias("anchors"))
    first = docs.groupBy("mark").agg(F.min("doc_id").alias("doc_id"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0
        packer = zstandard.ZstdCompressor(level=1)

        def flush():
            bucket, doc_id, mark, start, size, h, data = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            off = np.concatenate([[0], np.cumsum(size)])
            # of equal stretches the first goes on
            order = np.lexsort((start, mark, doc_id, h))
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            first = np.empty(len(h), np.int64)
            first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            again = (doc_id != doc_id[first]) | (mark != mark[first]) | (start != start[first])
            rows = []
            for known in (True, False):
                these = np.flatnonzero(again == known)
                order, spans = runs(bucket[these])
                for lo, hi in spans:
                    mine = these[order[lo:hi]]
                    places = [doc_id[mine], mark[mine], start[mine]]
                    if known:
                        rows.append((int(bucket[mine[0]]), np.stack([*places, start[mine] + size[mine]]).tobytes(), None))
                        continue
                    total = np.concatenate([[0], np.cumsum(size[mine])])
                    text = data[np.repeat(off[mine] - total[:-1], size[mine]) + np.arange(total[-1])]
                    rows.append((int(bucket[mine[0]]), np.stack([*places, size[mine]]).tobytes(), packer.compress(text.tobytes())))
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "head", "data"])

        for batch in batches:
            buf, off = column(batch.column(1))
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            lists = batch.column(3)
            for lo, hi in pieces(off):
                t = Texts(buf[off[lo] : off[hi]], off[lo : hi + 1])
                x = Anchors(t, length)
                at, windows, h = x.stretches(t)
                row = np.searchsorted(t.off, at, "right") - 1
                bucket = bucket_of(h)
                whole = (bucket << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                keep = np.zeros(len(at), bool)
                for k in range(hi - lo):
                    mine = np.frombuffer(b"".join(lists[lo + k].as_py()), np.uint64)
                    keep[edge[k] : edge[k + 1]] = np.isin(whole[edge[k] : edge[k + 1]], mine)
                at, size, row, bucket = at[keep], windows[keep] + length - 1, row[keep], bucket[keep]
                total = np.concatenate([[0], np.cumsum(size)])
                data = t.buf[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
                held.append((bucket.astype(np.int64), ids[lo:hi][row], marks[lo:hi][row], at - t.off[row], size, t.hashes(at, at + size), data))
                n += len(data)
                if n > _HELD:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    chosen = found.join(first, "mark")
    sent = docs.join(chosen, ["doc_id", "mark"]).select("doc_id", "text", "mark", "anchors").mapInArrow(send, "bucket int, head binary, data binary")
    return by_key(sent, ["bucket"], lambda k, t: _sort_bucket(k, t, length), _SPANS)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of `df`; `kept` is the remaining bytes."""
    if length < 2 * GRAM:
        raise ValueError(f"length is {2 * GRAM} at least")
    # with metadata the name is kept in all copies of this plan, so that equal shuffles are seen to be equal
    docs = df.select(df[id_col].cast("long").alias("doc_id", metadata={"role": "id"}), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    known = docs.where("doc_id is not null")
    spans = repeated_spans(known, length).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    first = known.groupBy("mark").agg(F.min("doc_id").alias("first_id"))
    lost = known.select("doc_id", "mark").distinct().join(first, "mark").where("doc_id != first_id").select("doc_id", "mark", F.lit(True).alias("copy"))
    todo = spans.join(lost, ["doc_id", "mark"], "full")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column(batch.column(1))
            raw = buf.tobytes()
            out: list = []
            for k, (copy, spans) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2), strict=True)):
                text = raw[off[k] : off[k + 1]]
                n = len(text)
                runs: list[tuple[int, int]] = []
                if copy:
                    runs = [(0, n)] if n >= length else []
                elif spans.is_valid and len(spans):
                    x = np.array([(s["a"], s["b"]) for s in spans.as_py()], np.int64)
                    x = x[np.lexsort((x[:, 1], x[:, 0]))]
                    _, a, b = _merge(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])
                    runs = list(zip(a.tolist(), b.tolist(), strict=True))
                at, kept = 0, []
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append((n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            if out:
                n, removed, spans, sha, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    # the texts are dealt by (doc_id, mark) as for their stretches, so one shuffle serves both; rows without an id need none
    dealt = known.join(todo, ["doc_id", "mark"], "left").select("doc_id", "text", "spans", "copy")
    rest = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<a:long,b:long>>").alias("spans"), F.lit(None).cast("boolean").alias("copy"))
    return dealt.union(rest).mapInArrow(finish, f"{SCHEMA}, kept binary")
