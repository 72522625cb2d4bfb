"""Places within jobs against a plain sort."""

import random

import pytest

from gleanery.operators.ranks import numbered


@pytest.mark.parametrize(("first", "last"), [(1, None), (1, 5), (41, 80), (990, 1200), (5000, 6000)])
def test_places_like_a_sort(spark, first, last):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", "c", None]), r.choice(["x", "y", None]), f"{k:05}") for k in range(2000)]
    df = spark.createDataFrame(rows, "job_ref string, bucket string, filename string").repartition(7)
    got = sorted((tuple(x) for x in numbered(df, ["bucket", "filename"], first, last).collect()), key=repr)
    want = []
    for job in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == job), key=lambda x: (x[1] is not None, x[1] or "", x[2]))
        want += [(*x, k) for k, x in enumerate(own, 1) if first <= k <= (last or k)]
    assert got == sorted(want, key=repr)
    assert numbered(df.limit(0), ["filename"]).count() == 0


def test_no_window_over_a_whole_job(spark):
    plan = numbered(spark.range(100).selectExpr("'a' as job_ref", "id"), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 1 and "Window [row_number() windowspecdefinition(job_ref" in plan and "_range" in plan.split("Window [row_number()")[1].split("\n")[0]
