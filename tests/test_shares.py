"""All pairs of a job in shares: no task gets a whole job, and a vector is sent a bounded number of times."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.operators import measure as M
from gleanery.operators import nearest as N
from gleanery.operators import neardup as D
from gleanery.operators import shares as S


def frame(spark, n, dim=8, seed=1, job="a"):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(job, k, v.tolist()) for k, v in enumerate(r.normal(size=(n, dim)))], "job_ref string, id long, features array<double>")


def test_pairs_of_one_job_come_from_many_tasks(spark):
    found = D.cosine_pairs(frame(spark, 3000), 0.8).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(found) > 20 and max(x["count"] for x in found) < 0.2 * sum(x["count"] for x in found)


@pytest.mark.parametrize("n", [100, 3000, 12000])
def test_a_vector_is_sent_to_a_bounded_number_of_tasks(spark, n):
    df = frame(spark, n, 2)
    times = S.sent(df, S.share_counts(df, D.BLOCK)).groupBy("id").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert times[0] == times[1] == min(-(-n // D.BLOCK), S.SHARES) and times[2] == n


def test_shares_of_many_bytes_are_more(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARE_BYTES", 100 * 8 * 8)
    assert S.share_counts(frame(spark, 3000), 10).first()["shares"] == 30


def test_links_connect_what_pairs_connect(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 60)
    monkeypatch.setattr(D, "TILE", 16)
    r = np.random.default_rng(2)
    base = r.normal(size=(30, 16))
    rows = [("ab"[k % 2], 3 * k, (base[k % 30] + r.normal(size=16) * 0.22).tolist()) for k in range(600)] + [("a", 5000, [0.0] * 16)]
    df = spark.createDataFrame(rows, "job_ref string, id long, features array<double>").cache()
    pairs, links = D.cosine_pairs(df).select("job_ref", "a", "b").cache(), D.cosine_links(df).cache()
    ends = lambda d: {tuple(x) for x in D.near_dup_components(d).collect()}
    assert ends(pairs) == ends(links) and links.where("a >= b").count() == 0
    assert 0 < links.count() < pairs.count()


def test_a_search_sends_a_vector_for_pairs_of_shares_not_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "LEADERS", 64)
    given, real = [], N.dealt
    monkeypatch.setattr(N, "dealt", lambda rows, *keys, least=1: given.append(rows) or real(rows, *keys, least=least))
    D.similar(frame(spark, 1600, 24), 0.9, 0)
    times = given[0].groupBy("id").count().agg(F.max("count"), F.count("*")).first()
    assert 1 < times[0] <= S.SHARES and times[1] == 1600


def test_candidates_meet_their_vectors_in_shares(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 50)
    monkeypatch.setattr(D, "VERIFIED", 1000)
    v = frame(spark, 400, 4).select("job_ref", "id", D.unit(F.col("features")).alias("features"), F.lit(0.9).alias("cut"))
    every = spark.range(400).select(F.lit("a").alias("job_ref"), F.col("id").alias("a")).crossJoin(spark.range(400).withColumnRenamed("id", "b")).where("a < b")
    got = {(x["a"], x["b"]) for x in D._verified(every, v).collect()}
    assert got == {(x["a"], x["b"]) for x in D.cosine_pairs(v, 0.9).collect()} and got


def test_many_small_images_are_measured_in_small_stacks(spark, monkeypatch):
    taken, real = [], M.measure_stack
    monkeypatch.setattr(M, "measure_stack", lambda x, faces, t: taken.append(len(x)) or real(x, faces, t))
    n = 3000
    kept = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: kept.setdefault("run", run) and self)
    image = F.struct(F.lit("x").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(b"0").alias("data"))
    M.measure_images(spark.range(1).select(image.alias("image")))
    columns = {"path": ["x"] * n, "height": np.full(n, 8, np.int32), "width": np.full(n, 8, np.int32), "nChannels": np.full(n, 1, np.int32), "data": [bytes(range(64))] * n, "face": pa.nulls(n, pa.struct([("x", pa.float64())]))}
    rows = sum(b.num_rows for b in kept["run"](iter([pa.RecordBatch.from_pydict(columns)])))
    assert rows == n == sum(taken) and max(taken) <= 400
