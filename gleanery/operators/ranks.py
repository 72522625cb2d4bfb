"""Numbers of rows in order within each job, at any size of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Scratch


def numbered(df: DataFrame, order: list[str], first: int = 1, last: int | None = None) -> DataFrame:
    """Adds `nth`, a row's place from 1 in its job by `order`; only places from `first` to `last`. Columns are named, ascending, nulls first.

    Rows are dealt to ranges of (job_ref, order) and written with the number of their range, by a job that runs while the
    result is built; a job's rows in the ranges before give each range its offset. So a task ranks a range, not a job, and
    ranges without wanted places are not ranked at all. Rows that are equal in `order` get their places in any order, but
    for a whole range of them, which would be one task's: order by something that tells rows apart.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.write(df.repartitionByRange("job_ref", *order).withColumn("_range", F.spark_partition_id()))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("job_ref").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy("job_ref", "_range").agg(F.count("*").alias("_rows")).withColumn("_before", before)
    wanted: Column = F.col("_before") + F.col("_rows") >= first
    if last is not None:
        wanted &= F.col("_before") < last
    ranges = ranges.where(wanted).select(F.col("job_ref").alias("_job"), F.col("_range").alias("_own"), "_before")
    here = rows.join(ranges, F.col("job_ref").eqNullSafe(F.col("_job")) & (F.col("_range") == F.col("_own")))
    nth = F.row_number().over(Window.partitionBy("job_ref", "_range").orderBy(*order)) + F.col("_before")
    out = here.withColumn("nth", nth.cast("long")).drop("_range", "_job", "_own", "_before")
    return out.where(F.col("nth") >= first) if last is None else out.where(F.col("nth").between(first, last))
