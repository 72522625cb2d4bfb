"""Pairs are whole: none is left to chance, and copies count in links."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_nearest import plainly, reps, vectors
from test_queries import rows, tidy

from gleanery.operators import nearest as N
from gleanery.operators import neardup as D
from gleanery.plans.oracle import ORACLE
from gleanery.plans.queries import QUERIES

SCHEMA = "job_ref string, id long, features array<double>"


@pytest.mark.parametrize("plain", [0, 10_000])
def test_hyperplane_pairs_are_all_pairs(spark, monkeypatch, plain):
    """Also those that no table brings together, with tables for a recall of a hundredth."""
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "LEADERS", 64)
    real = D.near_pairs
    monkeypatch.setattr(D, "near_pairs", lambda first: real(first, plain))
    given = vectors()
    want, _ = plainly(given, dict.fromkeys("abc", 0.9))
    first = reps(given)
    between = {(j, a, b): s for (j, a, b), s in want.items() if first[j, a] == a and first[j, b] == b}
    stars = {(j, f, i): 1.0 for (j, i), f in first.items() if f != i and i < 20_000}
    got = D.lsh_pairs(spark.createDataFrame(given, SCHEMA), 0.9, 0.01).collect()
    found = {(x["job_ref"], x["a"], x["b"]): x["sim"] for x in got}
    assert len(got) == len(found) and found.keys() == between.keys() | stars.keys()
    assert all(abs(found[k] - s) < 1e-9 for k, s in (between | stars).items())


def test_links_count_all_copies(spark):
    given = vectors(20, 8, 60) + [("a", 40_000 + k, vectors(20, 8, 60)[5][2]) for k in range(20)]
    df = spark.createDataFrame(given, SCHEMA).cache()
    want = {}
    for j, a, b in plainly(given, dict.fromkeys("abc", 0.8))[0]:
        for i in (a, b):
            want[j, i] = want.get((j, i), 0) + 1
    for pairs in (D.similar(df, 0.8)[0], D.lsh_pairs(df, 0.8)):
        assert {(x["job_ref"], x["id"]): x["n_near"] for x in D.link_counts(df, pairs).collect()} == want


@pytest.mark.parametrize("hot", [3, 4096])
def test_hamming_edges_hold_ids_of_equal_hashes(spark, monkeypatch, hot):
    monkeypatch.setattr(D, "HOT", hot)
    r = np.random.default_rng(8)
    base = [int(x) for x in r.integers(0, 1 << 62, 30)]
    data = [("ab"[k % 3 == 0], k, [base[k % 30] ^ sum(1 << int(b) for b in r.integers(0, 62, r.integers(0, 4) if k % 2 else 0))]) for k in range(300)]
    got = [tuple(x) for x in D.hamming_edges(spark.createDataFrame(data, "job_ref string, id long, hash array<long>"), 1, 4).collect()]
    want = {(j, i, k) for j, i, x in data for other, k, y in data if j == other and i < k and (x[0] ^ y[0]).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("name", ["cosine_pairs_lsh", "cosine_lsh_recall", "similar_uniqueness", "near_dup_edges"])
def test_query_on_copies(spark, tmp_path, name):
    """Against SQL, on vectors with many copies, and others that share their signs alone."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 100")
    copies = e.where("vec_id = 3").withColumn("vec_id", F.explode(F.sequence(F.lit(1000), F.lit(1040))))
    wide = lambda x, i: (x * F.when((i + F.col("vec_id")) % 5 == 0, 40.0).otherwise(1.0)).cast("float")
    alike = e.where("vec_id IN (3, 4, 5)").withColumn("embedding", F.transform("embedding", wide)).withColumn("vec_id", F.col("vec_id") + 2000)
    flipped = copies.where("vec_id < 1005").withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i < F.col("vec_id") % 1000, -x).otherwise(x))).withColumn("vec_id", F.col("vec_id") + 2000)
    e.union(copies).union(alike).union(flipped).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    got = rows(df.columns, [tuple(x) for x in df.collect()])
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = c.execute(ORACLE[name])
    assert got == rows([x[0] for x in found.description], found.fetchall()) and tidy(0.0) not in got
