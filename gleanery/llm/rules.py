"""Quality rules: counts of words, symbols and repetition, and compression bands.

`quality_rules` judges every text by itself. Base rules fail a text with fewer
than 50 words or with more than half of its words in repeated 3-word windows.
Texts are compressed with zstandard, as a whole and, from one full chunk on, in
fixed chunks; a ratio (compressed bytes by bytes) below or above the band for its
length marks repetitive or incompressible text. Chunks have the band of their own
length. What is left after the last full chunk is a chunk, or part of the last one
if short. Limits are points, with straight lines in the logarithm of the length
between them; outside the points the nearest one holds.

Null ids are passed through. Null and empty texts have no words and fail the base
rules; their ratios are null. The share of odd chunks is null where no chunk is full.
Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import BLANK, Texts, column, grams, mix, pieces, sums

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """Limits of compressed bytes by bytes: (bytes, least ratio, greatest ratio).

    A frame has some fixed bytes, and long texts offer more to refer back to, so both limits fall with the length. The
    least ratios lie 0.01 to 0.03 below those of the texts of label 1 that pass the base rules in the sf0.1 corpus: 0.549 at
    512 bytes, 0.504 at 1024, 0.466 at 2048, 0.447 at 4096, 0.424 at 8192, 0.410 at 16384 (texts of about that length; their
    medians are 0.614, 0.535, 0.493, 0.464, 0.445, 0.427). The greatest leave 0.08 and more above the greatest there; text
    of random letters, base64 or packed data is above them.
    """

    limits: tuple[tuple[int, float, float], ...] = ((128, 0.580, 1.05), (256, 0.540, 0.95), (512, 0.515, 0.83), (1024, 0.485, 0.72), (2048, 0.457, 0.64), (4096, 0.435, 0.58), (8192, 0.414, 0.55), (16384, 0.400, 0.53), (65536, 0.380, 0.51))
    chunk_bytes: int = 4096
    #: A shorter rest is part of the last chunk: the fixed bytes of a frame would weigh too much.
    least_rest: int = 512
    #: A text goes if more than this share of its bytes is in chunks outside their band.
    chunk_share: float = 0.5
    level: int = 3
    least_words: int = 50
    most_repeated: float = 0.5


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, ratio double, odd_chunk_share double"
)


def _repeats(key: np.ndarray) -> np.ndarray:
    """True where a key stands twice or more."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def counts(t: Texts) -> dict[str, np.ndarray]:
    rows = len(t.off) - 1
    blank = BLANK[t.buf]
    start, end, off = t.runs(~blank)
    owner = np.repeat(np.arange(rows), np.diff(off))
    h = t.hashes(start, end)
    tri, at, tri_off = grams(h, off, 3)
    salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    twice = _repeats(tri + salt[np.repeat(np.arange(rows), np.diff(tri_off))])
    covered = np.zeros(len(h), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    l_start, l_end, l_off = t.lines()
    full = np.concatenate([[0], np.cumsum(~blank)])
    some = full[l_end] > full[l_start]
    l_row = np.repeat(np.arange(rows), np.diff(l_off))[some]
    key = t.hashes(l_start, l_end)[some] + salt[l_row]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return {
        "n_words": np.bincount(owner, minlength=rows),
        "word_chars": t.per_row(~blank & ((t.buf & 0xC0) != 0x80)),
        "n_symbols": t.per_row(_SYMBOL[t.buf]),
        "n_dup_lines": np.bincount(l_row[again], minlength=rows),
        "n_repeat_words": sums(covered, off),
    }


def odd(size: np.ndarray, ratio: np.ndarray, b: Bands) -> np.ndarray:
    """Whether ratios lie outside the band of their lengths."""
    at, low, high = (np.array(x, np.float64) for x in zip(*b.limits, strict=True))
    x = np.log2(np.maximum(size, 1))
    return (ratio < np.interp(x, np.log2(at), low)) | (ratio > np.interp(x, np.log2(at), high))


def _bands(raw: memoryview, packer, b: Bands) -> tuple[bool, float, float | None]:
    n = len(raw)
    ratio = len(packer.compress(raw)) / n
    ok = not odd(np.array([n]), np.array([ratio]), b)[0]
    if n < b.chunk_bytes:
        return ok, ratio, None
    cuts = list(range(0, n, b.chunk_bytes))
    if n - cuts[-1] < min(b.least_rest, b.chunk_bytes):
        cuts.pop()
    size = np.diff([*cuts, n])
    share = float(size[odd(size, np.array([len(packer.compress(raw[i : i + k])) for i, k in zip(cuts, size.tolist(), strict=True)]) / size, b)].sum() / n)
    return ok and share <= b.chunk_share, ratio, share


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row for each row of `df`: the counts, base_failed, kept, and the ratios behind the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=bands.level, write_checksum=False)
        for batch in batches:
            buf, off = column(batch.column(1))
            for lo, hi in pieces(off):
                t = Texts(buf[off[lo] : off[hi]], off[lo : hi + 1])
                c = counts(t)
                failed = (c["n_words"] < bands.least_words) | (c["n_repeat_words"] > bands.most_repeated * c["n_words"])
                raw = memoryview(t.buf)
                kept, ratio, share = np.zeros(hi - lo, bool), [None] * (hi - lo), [None] * (hi - lo)
                for k in range(hi - lo):
                    a, b = int(t.off[k]), int(t.off[k + 1])
                    if b > a:
                        ok, ratio[k], share[k] = _bands(raw[a:b], packer, bands)
                        kept[k] = ok and not failed[k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(c[n].astype(np.int64)) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(ratio, pa.float64()), pa.array(share, pa.float64())],
                    names=[x.split()[0] for x in SCHEMA.split(",")],
                )

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
