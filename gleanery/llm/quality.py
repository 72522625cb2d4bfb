"""Quality classifier: random-indexing word vectors, pooled by document, and a small network.

1. Word vectors. A token is a run of letters and digits or a run of other signs.
   Its lower-cased form falls in one of BUCKETS, its shape (case, digits, kind of
   sign, length) in one of SHAPES. Every bucket adds up the sparse random index
   vectors of its neighbours over the whole corpus; the sums are an array of
   fixed size that tasks fill and Spark adds.
2. A document is the mean and spread of its tokens' vectors, forms and shapes
   apart, how much neighbours resemble each other, and its length.
3. A network of two layers, in numpy, learns the labels of at most MOST_LABELLED
   documents (those with the least hash of the id; the only bound on rows here);
   a fifth of them is set aside to fit the temperature of its probabilities.

Ids, languages, sources and labels are no inputs of a score. Null and empty texts
get a score like others, from zero vectors. Null ids are scored, never learned
from; a doc_id labelled twice counts with its smaller label, null labels not at
all. Without labelled rows of both kinds every score is the labels' mean, or 0.5.
Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch
from .arrays import emit, total
from .textbytes import BLANK, LOWER, Texts, column, forget, mix, pieces

BUCKETS, SHAPES, DIM = 1 << 13, 64, 32
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, SEED = 32, 30, 17

_KIND = np.full(256, 2, np.uint8)  # 0 blank, 1 letter or digit, 2 other
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[BLANK] = 0
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the form and of the shape of each token, a hash of the token, offsets by row."""
    n = len(buf)
    kind = _KIND[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    first = first[:n]
    first[1:] |= kind[1:] != kind[:-1]
    edge = np.flatnonzero(first)
    end = np.append(edge[1:], n)
    full = kind[edge] > 0
    start, end = edge[full], end[full]
    h = Texts(LOWER[buf], off).hashes(start, end)
    size = end - start
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    upper, digit = upper[end] - upper[start], digit[end] - digit[start]
    case = np.select([kind[start] == 2, digit == size, digit > 0, (upper == size) & (size > 1), _UPPER[buf[start]], upper > 0], [6, 5, 4, 3, 2, 1], 0)
    length = np.minimum(np.select([size <= 1, size <= 3, size <= 6, size <= 12, size <= 24], [0, 1, 2, 3, 4], 5), 5)
    sign = 42 + (buf[start].astype(np.int64) * 37 >> 2) % 22
    shape = np.where(case == 6, sign, case * 6 + length)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), shape, h, np.searchsorted(start, off)


def _index(x: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """One entry of a token's index vector: dimension and sign."""
    y = mix(x + np.uint64(salt))
    return (y >> np.uint64(8)).astype(np.int64) % DIM, 1 - 2 * (y & np.uint64(1)).astype(np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Vectors by bucket, forms first and shapes after them; unit length, or zero."""
    rows = BUCKETS + SHAPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        acc = np.zeros(rows * DIM, np.int64)
        for batch in batches:
            buf, off = column(batch.column(0))
            for lo, hi in pieces(off):
                form, shape, h, at = tokens(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                if len(form) < 2:
                    continue
                joined = np.ones(len(form) - 1, bool)
                cut = at - 1
                joined[cut[(cut >= 0) & (cut < len(joined))]] = False
                left = np.flatnonzero(joined)
                for me, other in ((left, left + 1), (left + 1, left)):
                    for ids, salt, base in ((form, 0, 0), (shape, 10, BUCKETS)):
                        key = h[other] if base == 0 else shape[other].astype(np.uint64)
                        for j in range(2):
                            dim, sign = _index(key, salt + j)
                            acc += np.bincount((base + ids[me]) * DIM + dim, weights=sign, minlength=len(acc)).astype(np.int64)
        parts = emit(acc)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in parts], k) for c, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["part", "task", "data"])

    sums = total(docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "part int, task int, data binary"), rows * DIM).reshape(rows, DIM).astype(np.float64)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.where(norm > 0, norm, 1.0)).astype(np.float32)


def pool(vectors: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    form, shape, _, at = tokens(buf, off)
    n = np.diff(at)
    out = np.zeros((len(n), 4 * DIM + 3), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        count = n[some, None].astype(np.float32)
        for k, ids in enumerate((form, BUCKETS + shape)):
            v = vectors[ids]
            mean = np.add.reduceat(v, at[some], axis=0) / count
            out[some, 2 * k * DIM : (2 * k + 1) * DIM] = mean
            out[some, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, at[some], axis=0) / count - mean * mean, 0))
            near = np.zeros(len(ids), np.float32)
            near[:-1] = np.einsum("ij,ij->i", v[1:], v[:-1])
            near[at[some] + n[some] - 1] = 0
            out[some, 4 * DIM + k] = np.add.reduceat(near, at[some]) / np.maximum(count[:, 0] - 1, 1)
        out[some, 4 * DIM + 2] = np.log1p(count[:, 0])
    return out


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features binary of 32-bit floats) for each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column(batch.column(1))
            for lo, hi in pieces(off):
                x = pool(shared.value, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "features"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, features binary")


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float
    #: Used for all where there was nothing to learn.
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(((x - self.mean) * self.scale) @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Cross entropy by Adam over small batches; the temperature then minimises it on rows set aside."""
    none = np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Network(none, none, [], 1.0, float(y.mean()) if len(y) else 0.5)
    x, y = x.astype(np.float64), y.astype(np.float64)
    r = np.random.default_rng(seed)
    order = r.permutation(len(y))
    aside, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, spread = x[fit].mean(0), x[fit].std(0)
    net = Network(mean, 1 / np.where(spread > 1e-6, spread, 1.0), [r.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)], 1.0)
    z = (x - net.mean) * net.scale
    m, s, step = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    for epoch in range(EPOCHS):
        for batch in np.array_split(r.permutation(fit), max(1, len(fit) // 128)):
            w1, b1, w2, b2 = net.weights
            hidden = np.maximum(z[batch] @ w1 + b1, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -40, 40)))
            d = (p - y[batch]) / len(batch)
            back = np.outer(d, w2) * (hidden > 0)
            grads = [z[batch].T @ back + 1e-4 * w1, back.sum(0), hidden.T @ d + 1e-4 * w2, np.array([d.sum()])]
            step += 1
            rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    if len(aside):
        logit = net.logits(x[aside])
        loss = lambda t: np.logaddexp(0, np.where(y[aside] > 0, -logit, logit) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_labelled: int) -> tuple[np.ndarray, DataFrame, Network]:
    vectors = word_vectors(docs, text_col)
    features = Scratch(docs.sparkSession).write(pooled(docs, vectors, id_col, text_col))
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).dropna().where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    # the labelled rows of least hash: a bound on the hash leaves few more than are wanted, whatever their number
    n = features.select("doc_id").join(known, "doc_id").count()
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1))
    bound = int(min(1.0, (most_labelled + 8 * most_labelled**0.5 + 16) / max(n, 1)) * (1 << 62))
    rows = features.join(known.where(place < bound), "doc_id").orderBy(place, "doc_id", "features").limit(most_labelled).select("features", "label").collect()
    x = np.frombuffer(b"".join(bytes(r["features"]) for r in rows), np.float32).reshape(len(rows), -1) if rows else np.zeros((0, 1))
    return vectors, features, train(x, np.array([r["label"] for r in rows], np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`; labels are joined by doc_id."""
    _, features, network = _fit(docs, labels, id_col, text_col, label_col, most_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw, _ = column(batch.column(1))
                score = shared.value.score(raw.view(np.float32).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """The rows of `docs` whose text scores 0.5 or more, with all their columns."""
    vectors, _, network = _fit(docs, labels, id_col, text_col, label_col, most_labelled)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            buf, off = column(batch.column(at))
            for lo, hi in pieces(off):
                score = network.score(pool(vectors, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
                yield batch.slice(lo, hi - lo).filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)
