"""License scan: ordered signature rules behind a keyword prefilter.

Words of the whole lower-cased text are hashed; base phrases are found by equal
hashes of consecutive words. Rules run only around words that are a keyword of
theirs, over the neighbouring words joined by one space. A detection is dropped
when one of higher rank (priority, then length, start, order of the rules) holds
its whole interval.

Null ids are passed through. Null and empty texts give no words, no places and empty label lists. Repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import BASE, MOST_WORDS, Rule, rules
from .textbytes import LOWER, NOT_ALNUM, Texts, column, pieces

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<label:string,first:int,last:int,priority:int>>"
)


def _hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.cumsum([0, *map(len, raw)])
    return Texts(np.frombuffer(b"".join(raw), np.uint8), off).hashes(off[:-1], off[1:])


def suppress(found: list[tuple[int, int, int, str, float, int]]) -> list[tuple[int, int, int, str, float, int]]:
    """Of (first, last, priority, label, score, order of the rule), those not inside one of higher rank.

    One sweep in order of rank; of what was seen only intervals that lie in no other are remembered, in order of both ends.
    """
    kept: list = []
    firsts: list[int] = []
    lasts: list[int] = []
    for x in sorted(found, key=lambda x: (-x[2], x[0] - x[1], x[0], x[5])):
        i = bisect_right(firsts, x[0])
        if i and lasts[i - 1] >= x[1]:
            continue
        kept.append(x)
        lo = hi = bisect_left(firsts, x[0])
        while hi < len(lasts) and lasts[hi] <= x[1]:
            hi += 1
        firsts[lo:hi], lasts[lo:hi] = [x[0]], [x[1]]
    return sorted(kept)


class Scanner:
    def __init__(self, all_rules: tuple[Rule, ...] = ()):
        self.rules = all_rules or rules()
        keywords = sorted({k for r in self.rules for k in r.keyword.split("|")})
        h = _hash(keywords)
        self.by_hash = {int(x): k for x, k in zip(h, keywords, strict=True)}
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[h & np.uint64(0xFFFF)] = True
        self.of: dict[str, list[tuple[int, Rule, re.Pattern]]] = {}
        for n, r in enumerate(self.rules):
            for k in r.keyword.split("|"):
                self.of.setdefault(k, []).append((n, r, re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])")))
        self.base = [(_hash(p.split()), label) for p, label in BASE.items()]

    def keywords(self, h: np.ndarray) -> list[tuple[int, str]]:
        at = np.flatnonzero(self.maybe[h & np.uint64(0xFFFF)])
        return [(int(i), self.by_hash[x]) for i, x in zip(at, h[at].tolist(), strict=True) if x in self.by_hash]

    def detect(self, words: list[str], hits: list[tuple[int, str]]) -> list[tuple[int, int, int, str, float, int]]:
        """Detections in a text's words, given the places of keywords."""
        found: set = set()
        zones: list[list] = []
        for i, k in hits:
            lo, hi = max(0, i - MOST_WORDS), min(len(words), i + MOST_WORDS + 1)
            while k == "copyright" and hi < len(words) and words[hi].isdigit():
                hi += 1
            if zones and lo <= zones[-1][1]:
                zones[-1][1] = max(hi, zones[-1][1])
                zones[-1][2].add(k)
            else:
                zones.append([lo, hi, {k}])
        for lo, hi, keys in zones:
            text = " ".join(words[lo:hi])
            begin = list(accumulate((len(w) + 1 for w in words[lo : hi - 1]), initial=0))
            for k in keys:
                for n, r, pattern in self.of[k]:
                    for m in pattern.finditer(text):
                        named = "at" in pattern.groupindex
                        start, end = m.span("at" if named else 0)
                        first, last = (lo + bisect_right(begin, at) - 1 for at in (start, end - 1))
                        version = None if named else next((g for g in m.groups() if g), None)
                        found.add((first, last, r.priority, f"{r.label}-{version.replace(' ', '.')}" if version else r.label, r.score, n))
        return suppress(list(found))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`; `spans` has the detections that stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner()
        for batch in batches:
            buf, off = column(batch.column(1))
            for lo, hi in pieces(off):
                yield _scan(s, batch.column(0).slice(lo, hi - lo), Texts(LOWER[buf[off[lo] : off[hi]]], off[lo : hi + 1]))

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _scan(s: Scanner, ids: pa.Array, t: Texts) -> pa.RecordBatch:
    start, end, off = t.words(NOT_ALNUM)
    h, rows = t.hashes(start, end), len(t.off) - 1
    base, n_base = np.zeros(len(h), bool), np.zeros(rows, np.int64)
    labels: list[set[str]] = [set() for _ in range(rows)]
    row_of = lambda at: np.searchsorted(off, at, "right") - 1
    for phrase, label in s.base:
        n = max(0, len(h) - len(phrase) + 1)
        at = np.flatnonzero(h[:n] == phrase[0])
        for j in range(1, len(phrase)):
            at = at[h[at + j] == phrase[j]]
        row = row_of(at)
        inside = at + len(phrase) <= off[row + 1]
        at, row = at[inside], row[inside]
        base[at] = True
        n_base += np.bincount(row, minlength=rows)
        for r in np.unique(row).tolist():
            labels[r].add(label)
    at = np.flatnonzero(base)
    first, last = [None] * rows, [None] * rows
    for i, r in zip(at.tolist(), row_of(at).tolist(), strict=True):
        first[r] = int(i - off[r]) if first[r] is None else first[r]
        last[r] = int(i - off[r])
    of_row: dict[int, list[tuple[int, str]]] = {}
    hits = s.keywords(h)
    for (i, k), r in zip(hits, row_of(np.array([i for i, _ in hits], np.int64)).tolist(), strict=True):
        of_row.setdefault(r, []).append((int(i - off[r]), k))
    spans: list[list[dict]] = [[] for _ in range(rows)]
    score = [0.6 if x else 0.0 for x in labels]
    all_labels = [set(x) for x in labels]
    raw = t.buf.tobytes() if of_row else b""
    for r, found in of_row.items():
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[off[r] : off[r + 1]].tolist(), end[off[r] : off[r + 1]].tolist(), strict=True)]
        for f, e, priority, label, x, _ in s.detect(words, found):
            spans[r].append({"label": label, "first": f, "last": e, "priority": priority})
            all_labels[r].add(label)
            score[r] = max(score[r], x)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    join = lambda x: [",".join(sorted(y)) for y in x]
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("priority", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(off)), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(join(labels), pa.string()), pa.array(join(all_labels), pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)], names=names
    )
