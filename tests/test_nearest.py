"""Near pairs and nearest neighbours against the comparison of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import nearest as N
from gleanery.operators import neardup as D


def vectors(n_groups=40, copies=25, loners=150, dim=24, seed=3, noise=0.48):
    """Groups of near copies, single vectors, exact copies and zeros, over two jobs."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n_groups):
        base = r.normal(size=dim)
        out += [base + r.normal(size=dim) * noise * np.linalg.norm(base) / dim**0.5 * r.random() for _ in range(copies)]
    out += list(r.normal(size=(loners, dim)))
    rows = [("ab"[int(r.random() < 0.2)], int(k), v.tolist()) for k, v in enumerate(out)]
    rows += [("a", 10_000 + k, rows[k * 7][2]) for k in range(30)] + [("b", 20_000, [0.0] * dim), ("b", 20_001, [0.0] * dim), ("c", 30_000, rows[0][2])]
    return rows


def plainly(rows, threshold):
    """Pairs and maxima of all pairs; thresholds by job."""
    pairs, best = {}, {}
    for job in {x[0] for x in rows}:
        ids = np.array([x[1] for x in rows if x[0] == job])
        v = np.array([x[2] for x in rows if x[0] == job])
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(size > 0, size, 1)
        sim = v @ v.T
        np.fill_diagonal(sim, 0)
        best |= {(job, int(i)): max(0.0, float(s)) for i, s in zip(ids, sim.max(1), strict=True)}
        for i, j in zip(*np.nonzero(np.triu(sim, 1) >= threshold[job]), strict=True):
            a, b = sorted((int(ids[i]), int(ids[j])))
            pairs[job, a, b] = float(sim[i, j])
    return pairs, best


def reps(rows):
    """The smallest id of equal vectors, by (job, id)."""
    first = {}
    for job, i, v in sorted(rows, key=lambda x: x[1]):
        first.setdefault((job, tuple(v)), i)
    return {(job, i): first[job, tuple(v)] for job, i, v in rows}


@pytest.mark.parametrize("plain", [0, 10_000])
def test_pruned_search_is_exact(spark, monkeypatch, plain):
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "LEADERS", 64)
    rows = vectors()
    cut = {"a": 0.9, "b": 0.7, "c": 0.5}
    df = spark.createDataFrame(rows, "job_ref string, id long, features array<double>").withColumn("t", F.create_map(*(F.lit(x) for kv in cut.items() for x in kv))[F.col("job_ref")])
    pairs, best = D.similar(df, F.col("t"), plain)
    want, top = plainly(rows, cut)
    got = {(x["job_ref"], x["id"]): x["max_sim"] for x in best.collect()}
    assert got.keys() == top.keys() and all(abs(got[k] - top[k]) < 1e-9 for k in top)
    first = reps(rows)
    # between different vectors all pairs of first ids; copies with their first
    between = {(j, a, b) for j, a, b in want if first[j, a] == a and first[j, b] == b}
    stars = {(j, f, i) for (j, i), f in first.items() if f != i and j != "b"}
    assert {(x["job_ref"], x["a"], x["b"]) for x in pairs.collect()} == between | stars


def test_near_copies_are_pruned_to_about_their_own_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "LEADERS", 256)
    df = spark.createDataFrame(vectors(60, 40, 0, noise=0.2)[:2400], "job_ref string, id long, features array<double>").where("job_ref = 'a'").select("job_ref", "id", D.unit(F.col("features")).alias("features"))
    _, _, pruned = N.compare(df, F.lit(0.9), 0)
    _, _, whole = N.compare(df, F.lit(0.9), 10_000)
    assert pruned.count() < 0.2 * whole.count()


def test_empty_and_single(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0])], "job_ref string, id long, features array<double>")
    for x in (df, df.limit(0)):
        for plain in (0, 10):
            pairs, best = D.similar(x, 0.9, plain)
            assert pairs.count() == 0 and [tuple(r) for r in best.collect()] == [("a", 1, 0.0)] * x.count()
    with pytest.raises(ValueError):
        D.similar(df, 0.0)


def test_hamming_pairs_with_a_band_of_a_third_of_all(spark, monkeypatch):
    """A third of the hashes share a band: it is split by further bits, and what is common still meets in parts."""
    monkeypatch.setattr(D, "HOT", 30)
    r = random.Random(4)
    base = [r.getrandbits(62) for _ in range(200)]
    rows = [x ^ sum(1 << r.randrange(62) for _ in range(r.randint(0, 4))) for x in base for _ in range(3)]
    rows += [(r.getrandbits(49) << 13) | 0b1011001110001 for _ in range(250)]
    hot = [(r.getrandbits(49) << 13) | 0b1011001110001 for _ in range(30)]
    rows += [x ^ (1 << r.randrange(13, 62)) ^ (1 << r.randrange(13, 62)) for x in hot for _ in range(4)] + hot + hot[:5]
    data = [("ab"[k % 5 == 0], k, [x, x >> 3]) for k, x in enumerate(rows)]
    df = spark.createDataFrame(data, "job_ref string, id long, hash array<long>").cache()
    for words, most in ((1, 4), (2, 6), (1, 0), (1, 20)):
        sub = df.withColumn("hash", F.slice("hash", 1, words))
        got = {(x["a"], x["b"], x["distance"]) for x in D.hamming_pairs(sub, words, most).collect()}
        first, want = {}, set()
        for job, i, h in data:
            first.setdefault((job, tuple(h[:words])), i)
        for (job, h), i in first.items():
            for (other, g), j in first.items():
                d = sum((x ^ y).bit_count() for x, y in zip(h, g, strict=True))
                if job == other and i < j and d <= most:
                    want.add((i, j, d))
        want |= {(first[job, tuple(h[:words])], i, 0) for job, i, h in data if first[job, tuple(h[:words])] != i}
        assert got == want


def test_distance_by_job(spark):
    df = spark.createDataFrame([("a", 1, [0], 1), ("a", 2, [3], 1), ("a", 3, [1], 1), ("b", 4, [0], 2), ("b", 5, [3], 2), ("c", 6, [7], None), ("c", 7, [7], None)], "job_ref string, id long, hash array<long>, most int")
    assert {tuple(x) for x in D.hamming_pairs(df, 1, F.col("most")).collect()} == {("a", 1, 3, 1), ("a", 2, 3, 1), ("b", 4, 5, 2)}


def test_candidates_of_hyperplanes_grow_with_the_size_not_its_square(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([("a", k, v.tolist()) for k, v in enumerate(r.normal(size=(4000, 48)))], "job_ref string, id long, features array<double>").select("job_ref", "id", D.unit(F.col("features")).alias("features")).cache()
    few, many = D.lsh_candidates(df.where("id < 1000"), 0.9, 0.9).count(), D.lsh_candidates(df, 0.9, 0.9).count()
    assert many < 8 * few  # all pairs would be sixteen times as many
