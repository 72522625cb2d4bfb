"""Vectors of a job dealt to shares, so that any two of them meet in one task.

A job has as many shares as vectors by `least`, SHARES at most, so a vector is sent
SHARES times at most and what is sent grows as the number of vectors. Only where a
share would pass SHARE_BYTES there are more.

What a job has in common is joined by job and SALTS parts of it: a join by job alone
brings a job into one task, and leaves it there for all that is grouped within the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARES, SHARE_BYTES, SALTS = 12, 1 << 25, 64


def dealt(rows: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """rows dealt by keys to as many tasks as a shuffle has, `least` at least: the number is given, so small rows with much work are not put into one task."""
    return rows.repartition(max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def of_job(rows: DataFrame, common: DataFrame, key: str = "id") -> DataFrame:
    """rows (job_ref, key, ..) with the columns of `common`, which has a row for each job_ref; rows of other jobs go."""
    spread = common.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = dealt(rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")), "job_ref", "_salt")
    return salted.join(spread, ["job_ref", "_salt"]).drop("_salt")


def share_counts(rows: DataFrame, least: int) -> DataFrame:
    """(job_ref, shares) of rows (job_ref, features)."""
    sizes = rows.groupBy("job_ref").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("dims"))
    most = F.greatest(F.lit(SHARES), F.ceil(F.col("n") * F.col("dims") * 8 / SHARE_BYTES))
    return sizes.select("job_ref", F.least(F.ceil(F.col("n") / least), most).cast("int").alias("shares"))


def share(key: str) -> Column:
    """The share, from 0, of a key in a job of `shares`."""
    return F.pmod(F.xxhash64(key), F.col("shares")).cast("int")


def met(a: Column, b: Column) -> tuple[Column, Column]:
    """(low, high): the pair of shares in which those of a and b meet."""
    return F.least(a, b).alias("low"), F.greatest(a, b).alias("high")


def sent(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (job_ref, id, ..) once for each pair of shares that holds their own: low, high and share are added."""
    d = of_job(rows, counts).withColumn("share", share("id"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return dealt(d.select(*rows.columns, "share", *met(F.col("share"), F.col("_other"))), "job_ref", "low", "high", least=2 * SHARES * SHARES)
