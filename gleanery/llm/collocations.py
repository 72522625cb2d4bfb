"""Phrase collocations by Toivonen's sampling: a sample proposes, full passes count, until the border holds.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into
words `[^\\x20\\x09]+`. A phrase is some words in a row of one piece; everything is by
language. A phrase of `least` occurrences or more is frequent.

1. A sample of the texts (a share of the hashes of text and language) is counted, and
   what is frequent in it by a lowered threshold is proposed: one bit for each phrase in
   a bitmap of SLOTS bits for each length, the only thing that is sent to all tasks. Two
   phrases may share a bit; then more is counted than needed.
2. A full pass counts each phrase whose shorter parts (without its first, without its
   last word) are all proposed. These are the proposed phrases and their negative border;
   words are all in it. Tasks count a piece of text and send hashes with their numbers,
   by ranges of hashes; a range is added up in one place. A phrase of the border that turns
   out frequent is a failure of the sample: it joins the bitmaps, and a further pass counts
   what only now has all its parts there. That ends when no bit is added, or so few (one in
   FEW) that step 3 counts what is left, after as many passes as a phrase has words at most.
   Whether a phrase is counted in a pass depends on the phrase alone, so each one is
   counted in one pass, over all texts.
3. A last pass spells out and counts by their text the phrases that bitmaps of what was
   frequent pick, and those that no pass counted though their parts may be frequent, so
   neither shared bits nor shared hashes of different tasks change a number.
4. Each cut of a candidate is joined to the counts of its two sides (salted, as common
   words are a side of many); the cut of least score counts. Candidates that lie inside a
   longer one that is nearly as frequent go. Ranks are taken in slices first, so no task
   sorts all phrases of a language.

The sample only saves work: results are the same for any share, 0 and 1 too. Null texts
are empty, null languages `und`. Repeated rows count as often as they are there. Other
columns are ignored. An empty table gives an empty result. Phrases that differ but share
a 60-bit hash among the HELD bytes that a task counts at once would be counted as one. Jobs run while the result is
built; it reads a table in the shared folder that holds the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Scratch
from .textbytes import LOWER, Texts, column, mix, pieces

#: Bits of a bitmap of proposed phrases; 4 MB each.
BITS = 25
SLOTS = 1 << BITS
#: Bytes of text that are hashed at once, hashes and bytes of spelled phrases that a task holds before it sends them.
TEXT, HASHES, HELD = 1 << 20, 1 << 20, 3 << 23
#: Bytes of text for each range of hashes, which one task adds up at once.
RANGE = 1 << 22
#: Sample failures of one bit in so many are left to the last pass.
FEW = 8
#: The low bits of a hash are the number of words.
LENGTH = 15
#: Parts of a common word's joins, and slices of a language's ranking.
SALTS, SLICES = 8, 64

_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATOR = _STOP.copy()
_SEPARATOR[[0x20, 0x09]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def phrases(t: Texts, lang: np.ndarray, most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Starts and ends of words, row of each, and for each length the hash (with the row's language) and first word of every phrase."""
    start, end, off = t.words(_SEPARATOR)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    stops = np.concatenate([[0], np.cumsum(_STOP[t.buf])])
    piece = row * (stops[-1] + 1) + stops[start]
    h = t.hashes(start, end)
    found, g, at = [], h, np.arange(len(h))
    for k in range(1, most_words + 1):
        if k > 1:
            fits = at + k - 1 < len(h)
            fits[fits] = piece[at[fits]] == piece[at[fits] + k - 1]
            at = at[fits]
            g = g[fits] * _STEP + h[at + k - 1]
        found.append((mix(g ^ mix(lang[row[at]] + np.uint64(k))) & ~np.uint64(LENGTH) | np.uint64(k), at))
    return start, end, row, found


def spelled(buf: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    """The k words from each word of `at` on, joined by blanks."""
    blank = len(buf)
    first = np.full((len(at), 2 * k - 1), blank)
    size = np.ones((len(at), 2 * k - 1), np.int64)
    words = at[:, None] + np.arange(k)
    first[:, ::2], size[:, ::2] = start[words], end[words] - start[words]
    first, size = first.ravel(), size.ravel()
    stop = np.cumsum(size)
    where = np.repeat(first - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
    off = np.concatenate([[0], stop[2 * k - 2 :: 2 * k - 1]]).astype(np.int64)
    data = np.append(buf, np.uint8(0x20))[where]
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def proposed(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key >> np.uint64(64 - BITS)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _both(good: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Which phrases of k words have both shorter parts among the good ones of k - 1 words."""
    begins = np.zeros(len(found[0][1]) + 1, bool)
    begins[found[k - 2][1]] = good
    at = found[k - 1][1]
    return begins[at] & begins[at + 1]


def _wanted(bitmaps: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Which phrases of k words have both shorter parts in the bitmaps; all words."""
    return np.ones(len(found[0][1]), bool) if k == 1 else _both(proposed(bitmaps[k - 2], found[k - 2][0]), found, k)


def _possible(frequent: list[np.ndarray], counted: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """For each length which phrases may be frequent: they were, or passes up to the bitmaps `counted` left them out and both shorter parts may be."""
    good = None
    for k in range(1, len(found) + 1):
        was = proposed(frequent[k - 1], found[k - 1][0])
        good = was if good is None else np.where(_wanted(counted, found, k), was, _both(good, found, k))
        yield good


def counts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, numbers."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    return key[first], order[first], np.diff(first, append=len(key))


def _batches(batch: pa.RecordBatch, most_words: int):
    """(buf, rows of the language column, words and phrases) of each piece of a batch (lang, text)."""
    buf, off = column(batch.column(1))
    lang_buf, lang_off = column(batch.column(0))
    lang = Texts(lang_buf, lang_off).hashes(lang_off[:-1], lang_off[1:])
    for lo, hi in pieces(off, TEXT):
        low = LOWER[buf[off[lo] : off[hi]]]
        yield low, batch.column(0).slice(lo, hi - lo), phrases(Texts(low, off[lo : hi + 1]), lang[lo:hi], most_words)


def _by_range(key: np.ndarray, parts: int, least: int) -> Iterator[pa.RecordBatch]:
    """(part, h, n) of keys: for each range of hashes the sorted distinct ones and their numbers, from `least` on all alike."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    for lo in range(0, len(key), HASHES):
        h, n = np.unique(key[lo : lo + HASHES], return_counts=True)
        n = np.minimum(n, least).astype(np.min_scalar_type(least))
        edge = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
        part = np.flatnonzero(np.diff(edge))
        off = np.append(edge[part], len(h))
        packed = [pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((off * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())]) for x in (h, n)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *packed], names=["part", "h", "n"])


def _frequent(texts: DataFrame, most_words: int, want: Callable | None, least: int, parts: int) -> DataFrame:
    """(h) of phrases of (lang, text) of up to most_words words that occur `least` times; `want` tells which are counted, of the phrases found and a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, (_, _, _, found) in _batches(batch, most_words):
                held += [key if want is None else key[want(found, k)] for k, (key, _) in enumerate(found, 1)]
                size += sum(len(x) for x in held[-most_words:])
                if size >= HASHES:
                    yield from _by_range(np.concatenate(held), parts, least)
                    held, size = [], 0
        if size:
            yield from _by_range(np.concatenate(held), parts, least)

    def add(rows: pa.Table) -> pa.Table:
        h, n = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("h", np.uint64), ("n", np.min_scalar_type(least))))
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        often = np.add.reduceat(n[order], first, dtype=np.int64) >= least
        return pa.table({"h": h[first[often]].view(np.int64)})

    return texts.mapInArrow(run, "part int, h binary, n binary").groupBy("part").applyInArrow(add, "h long")


def bitmaps_of(rows: DataFrame, most_words: int) -> list[np.ndarray]:
    """Bitmaps by length, of rows (h); their size is the same for any input."""
    slot = F.shiftrightunsigned("h", 64 - BITS)
    bits = rows.select((F.col("h").bitwiseAND(LENGTH)).cast("int").alias("k"), F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int))").alias("bit"))
    found = bits.groupBy("k", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    k, word, value = (found.column(c).to_numpy() for c in ("k", "word", "bits"))
    out = [np.zeros(SLOTS // 64, np.uint64) for _ in range(most_words)]
    for j, bitmap in enumerate(out, 1):
        bitmap[word[k == j]] = value[k == j].astype(np.int64).view(np.uint64)
    return out


def proposals(texts: DataFrame, most_words: int, least: int, share: float, parts: int) -> list[np.ndarray]:
    """Bitmaps of the phrases of fewer than most_words words that are frequent in a sample, by a lowered threshold."""
    part = F.xxhash64("text", "lang").bitwiseAND((1 << 30) - 1) < int(share * (1 << 30))
    lowered = max(2, int(0.8 * least * share))
    return bitmaps_of(_frequent(texts.where(part), most_words - 1, None, lowered, parts), most_words - 1)


def _few(before: list[np.ndarray], now: list[np.ndarray]) -> bool:
    """Whether at each length at most one bit in FEW is new."""
    return all(FEW * int(np.bitwise_count(b & ~a).sum()) <= int(np.bitwise_count(a).sum()) for a, b in zip(before, now, strict=True))


def closed(texts: DataFrame, most_words: int, least: int, share: float) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Bitmaps by length of what full passes over (lang, text) found frequent, those whose phrases and border they counted, and their number."""
    context = texts.sparkSession.sparkContext
    parts = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE + 1
    now, before, passes = proposals(texts, most_words, least, share, parts), None, 0
    frequent = [np.zeros(SLOTS // 64, np.uint64) for _ in range(most_words)]
    while True:
        shared = context.broadcast((now, before))

        def want(found: list, k: int, shared=shared) -> np.ndarray:
            now, before = shared.value
            return _wanted(now, found, k) & ~_wanted(before, found, k) if before is not None else _wanted(now, found, k)

        more = bitmaps_of(_frequent(texts, most_words, want, least, parts), most_words)
        passes += 1
        frequent = [a | b for a, b in zip(frequent, more, strict=True)]
        before, now = now, [a | b for a, b in zip(now, more[:-1], strict=True)]
        # few border phrases were frequent that the sample or an earlier pass had not proposed
        if _few(before, now):
            return frequent, before, passes


def frequent_phrases(texts: DataFrame, most_words: int = 3, least: int = 10, share: float = 0.25) -> tuple[DataFrame, int]:
    """(lang, k, phrase, n) of (lang, text), k = 0 for the number of all words; and the number of full passes before. A table in the shared folder."""
    frequent, counted, passes = closed(texts, most_words, least, share)
    shared = texts.sparkSession.sparkContext.broadcast((frequent, counted))
    names = ["lang", "k", "phrase", "n"]

    def merged(held: list) -> pa.RecordBatch:
        h, at, _ = counts(np.concatenate([x[0] for x in held]))
        n = np.bincount(np.searchsorted(h, np.concatenate([x[0] for x in held])), np.concatenate([x[1] for x in held])).astype(np.int64)
        lang, phrase = (pa.concat_arrays([x[c] for x in held]).take(pa.array(at)) for c in (2, 3))
        return pa.RecordBatch.from_arrays([lang, pa.array((h & np.uint64(LENGTH)).astype(np.int32)), phrase, pa.array(n)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for buf, langs, (start, end, row, found) in _batches(batch, most_words):
                n = np.bincount(row, minlength=len(langs))
                yield pa.RecordBatch.from_arrays([langs, pa.array(np.zeros(len(n), np.int32)), pa.array([""] * len(n), pa.string()), pa.array(n.astype(np.int64))], names=names)
                for k, good in enumerate(_possible(*shared.value, found), 1):
                    key, at = found[k - 1]
                    h, place, n = counts(key[good])
                    first = at[good][place]
                    if len(h):
                        held.append((h, n, langs.take(pa.array(row[first])), spelled(buf, start, end, first, k)))
                        size += sum(x.nbytes for x in held[-1])
                if size >= HELD:
                    yield merged(held)
                    held, size = [], 0
        if held:
            yield merged(held)

    rows = texts.mapInArrow(run, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return Scratch(texts.sparkSession).write(rows.where((F.col("k") == 0) | (F.col("n") >= least))), passes


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _words(x: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(x, first, n), " ")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 3, least: int = 10, inside: int = 50, top: int | None = 2000, share: float = 0.25) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of phrases of 2 to most_words words; `inside`: per cent of a phrase's occurrences that a longer candidate has at least for it to go; `top` of each language, None for all."""
    if not 2 <= most_words <= LENGTH:
        raise ValueError(f"a phrase has 2 to {LENGTH} words")
    texts = df.select(F.coalesce(df[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    found, _ = frequent_phrases(texts, most_words, least, share)
    words = found.where("k = 0").select("lang", F.col("n").alias("n_words"))
    # the longest phrases are no side of any
    parts = found.where((F.col("k") > 0) & (F.col("k") < most_words)).select("lang", F.col("phrase").alias("side"), F.col("n").alias("f"))
    candidates = found.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    w, k = F.col("w"), F.col("k")
    side = lambda cut, first, n, left: F.struct(cut.alias("cut"), F.lit(left).alias("left"), _words(w, first, n).alias("side"))
    sides = F.flatten(F.transform(F.sequence(F.lit(1), k - 1), lambda c: F.array(side(c, F.lit(1), c, True), side(c, c + 1, k - c, False))))
    cut = candidates.select("lang", "phrase", "a", F.explode(sides).alias("s")).select("lang", "phrase", "a", "s.*").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    cut = cut.join(_salted(parts), ["lang", "side", "salt"])
    f_of = lambda c, left: F.max(F.when((F.col("cut") == c) & (F.col("left") == left), F.col("f")))
    cut = cut.groupBy("lang", "phrase", "a").agg(*(f_of(c, left).alias(f"{side}{c}") for c in range(1, most_words) for side, left in (("l", True), ("r", False))))
    # decimals of 38 digits: exact up to some 10^15 occurrences
    score = lambda c: F.expr(f"(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000BD) div (cast(l{c} as decimal(19,0)) * cast(r{c} as decimal(19,0)))").cast("long")
    scored = F.array(*(F.when(F.col(f"l{c}").isNotNull(), F.struct(score(c).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))) for c in range(1, most_words)))
    best = cut.select("lang", "phrase", "a", F.array_min(scored).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    # the most frequent longer candidate around each shorter one
    spans = F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda n: F.transform(F.sequence(F.lit(1), k - n + 1), lambda i: _words(w, i, n))))
    around = candidates.where("k > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        kept = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
        kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
