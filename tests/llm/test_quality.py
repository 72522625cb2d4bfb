import random
import re
import zlib

import numpy as np
import pytest

from gleanery.llm import quality
from gleanery.llm.textbytes import Texts, mix


def make(n=500, seed=2):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(20, 150))]
        bad = r.random() < 0.4
        if bad:
            kind = r.randrange(3)
            w = [x + "$$$" for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [w[0]] * len(w)
        docs.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = make()
    d = spark.createDataFrame([*docs, (9000, None), (9001, ""), (None, "some words"), docs[0]], "doc_id long, text string").selectExpr("*", "1 as score", "'x' as features")
    lab = spark.createDataFrame([*labels, (9000, None), (None, 1), (3, labels[3][1])], "doc_id long, quality int")
    got = quality.quality_scores(d, lab).collect()
    assert len(got) == len(docs) + 4
    truth = dict(labels)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark):
    docs, labels = make(150)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    score = lambda lab: {r["doc_id"]: r["score"] for r in quality.quality_scores(d, spark.createDataFrame(lab, "doc_id long, quality int")).collect()}
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    assert score(labels) == score(turned)


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(d, none).collect()} == {0.5}
    assert quality.quality_scores(d.limit(0), none).count() == 0


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 6)).astype(np.float32)
    y = (r.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = quality.train(x[:3000], y[:3000]).score(x[3000:])
    for lo in (0.0, 0.25, 0.5, 0.75):
        part = (p >= lo) & (p < lo + 0.25)
        assert abs(p[part].mean() - y[3000:][part].mean()) < 0.12


def plain_tokens(text):
    """(hash of the lower-cased form, bucket, shape) of each token, one by one."""
    out = []
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xFF]+|[^0-9A-Za-z\x80-\xFF\x20\x09-\x0D]+", (text or "").encode()):
        raw, n = m[0], len(m[0])
        low = raw.lower()
        h = int(Texts(np.frombuffer(low, np.uint8), np.array([0, n])).hashes(np.array([0]), np.array([n]))[0])
        upper, digit = sum(0x41 <= c <= 0x5A for c in raw), sum(0x30 <= c <= 0x39 for c in raw)
        length = next(k for k, most in enumerate((1, 3, 6, 12, 24, 10**9)) if n <= most)
        if re.match(rb"[^0-9A-Za-z\x80-\xFF]", raw):
            shape = 42 + (raw[0] * 37 >> 2) % 22
        else:
            case = 5 if digit == n else 4 if digit else 3 if upper == n > 1 else 2 if 0x41 <= raw[0] <= 0x5A else 1 if upper else 0
            shape = case * 6 + length
        out.append((h, h % quality.BUCKETS, shape))
    return out


def plain_vectors(texts):
    """Sums of the neighbours' sparse index vectors, unit length."""
    sums = np.zeros((quality.BUCKETS + quality.SHAPES, quality.DIM))

    def index(x, salt):
        y = int(mix(np.array([(x + salt) % 2**64], np.uint64))[0])
        return (y >> 8) % quality.DIM, 1 - 2 * (y & 1)

    for t in texts:
        found = plain_tokens(t)
        for a, b in zip(found[:-1], found[1:], strict=True):
            for me, other in ((a, b), (b, a)):
                for j in range(2):
                    dim, sign = index(other[0], j)
                    sums[me[1], dim] += sign
                    dim, sign = index(other[2], 10 + j)
                    sums[quality.BUCKETS + me[2], dim] += sign
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(norm > 0, norm, 1)


def plain_pool(vectors, text):
    found = plain_tokens(text)
    parts, near = [], []
    for rows in ([f[1] for f in found], [quality.BUCKETS + f[2] for f in found]):
        v = vectors[rows] if found else np.zeros((1, quality.DIM))
        parts += [v.mean(0), v.std(0)]
        near.append(sum(a @ b for a, b in zip(v[:-1], v[1:], strict=True)) / max(len(found) - 1, 1))
    return np.concatenate([*parts, near, [np.log1p(len(found))]])


def test_vectors_and_pooling_like_plain_versions(spark):
    docs, _ = make(40)
    texts = [t for _, t in docs] + [None, "", "one", "É1 é2\tX-y!? 12 ABC\n中文 #!", "word " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    vectors = quality.word_vectors(df)
    want = plain_vectors(texts)
    assert np.abs(vectors - want).max() < 1e-6 and (np.abs(want).sum(1) > 0).sum() > 100
    got = {r["doc_id"]: np.frombuffer(r["features"], np.float32) for r in quality.pooled(df, vectors).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_pool(want, t), abs=2e-3), i


def test_very_long_text(spark):
    """A text of several MB is one row like others."""
    docs, labels = make(200)
    long = " ".join(t for _, t in docs if "$$$" not in t and "!!" not in t) * 30
    got = quality.quality_scores(spark.createDataFrame([*docs, (5000, long)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(long) > 1_500_000 and got.count() == len(docs) + 1 and 0 <= got.where("doc_id = 5000").first()["score"] <= 1
