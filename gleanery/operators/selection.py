"""Rejection rules and balanced selection; every step is partitioned by job_ref."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CoverageLimits
from ..plans.lineage import Scratch
from ..purposes import not_false, of_purpose, vl
from .quality import whole

LIMITS = CoverageLimits()
#: Slices of the score that a bucket is ranked in; ranges of a doubling that a median counts by.
SLICES, RANGES = 64, 64


def upper_median(column: str) -> Column:
    """The middle of a column's sorted values, the upper one of two. It counts each distinct value of a group in one buffer: for sizes of buckets, of which n rows give at most the root of 2 n."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def upper_medians(df: DataFrame, value: str, carried: dict[str, Column]) -> DataFrame:
    """(job_ref, m, carried) for each job: the upper median of a column of any number of positive values, others don't count; null without one. `carried` are aggregates.

    Values are counted by ranges of about one per cent first, as many for any input, and the range that holds the
    middle is ranked by value. A sort spills, so no task holds a job's values in memory.
    """
    job, upto = Window.partitionBy("job_ref"), Window.partitionBy("job_ref").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(upto), F.lit(0))
    rows = df.select("job_ref", F.when(F.col(value) > 0, F.col(value)).alias("x"), F.when(F.col(value) > 0, F.floor(F.log2(value) * RANGES)).alias("at"), *(c.alias(k) for k, c in carried.items()))
    ranges = rows.groupBy("job_ref", "at").agg(F.count("x").alias("_n"), *(F.max(k).alias(k) for k in carried))
    ranges = ranges.withColumn("place", F.floor(F.sum("_n").over(job) / 2) - before)
    here = F.col("at").isNotNull() & F.col("place").between(0, F.col("_n") - 1)
    jobs = ranges.groupBy("job_ref").agg(F.max(F.when(here, F.struct("at", "place"))).alias("middle"), *(F.max(k).alias(k) for k in carried))
    middle = jobs.where("middle is not null").select("job_ref", "middle.at", "middle.place")
    inside = rows.select("job_ref", "x", "at").where("at is not null").join(middle, ["job_ref", "at"]).groupBy("job_ref", F.col("x").alias("at")).agg(F.count("*").alias("_n"), F.max("place").alias("place"))
    found = inside.withColumn("place", F.col("place") - before).where("place between 0 and _n - 1").select("job_ref", F.col("at").alias("m"))
    return jobs.join(found, "job_ref", "left").select("job_ref", "m", *carried)


def soft_face_threshold(df: DataFrame, t: CoverageLimits = LIMITS) -> DataFrame:
    """(job_ref, soft_face_threshold): the greater of a floor and a part of the median over all detected faces; 0 if off or none.

    Limits may be columns of `df`, the same in all rows of a job.
    """
    sharp = df.withColumn("_sharp", F.when(F.col("face_detected") & F.lit(t.soft_face_reject), F.col("face_sharpness")))
    jobs = upper_medians(sharp, "_sharp", {"floor": F.lit(t.soft_face_floor), "ratio": F.lit(t.soft_face_ratio)})
    return jobs.select("job_ref", F.when(F.col("m").isNull(), 0.0).otherwise(F.greatest("floor", F.col("m") * F.col("ratio"))).alias("soft_face_threshold"))


def with_threshold(df: DataFrame, t: CoverageLimits = LIMITS) -> DataFrame:
    return df.join(soft_face_threshold(df, t), "job_ref")


def rule_quality_fail() -> Column:
    return F.when(F.col("quality_verdict") == "fail", F.concat(F.lit("quality:"), F.array_join(F.slice("quality_reasons", 1, 2), "; ")))


def rule_duplicate() -> Column:
    return F.when(F.col("is_duplicate"), F.lit("duplicate"))


def rule_multiple_subjects() -> Column:
    many = (F.coalesce(vl("subject_count"), F.lit(1)) > 1) | F.coalesce(F.array_contains(vl("issues"), "multiple_subjects"), F.lit(False))
    return F.when(many, F.lit("multiple subjects"))


def rule_face_blurry() -> Column:
    return F.when((vl("face_clarity") == "blurry") & not_false(vl("face_visible")), F.lit("vl:blurry face"))


def rule_soft_face() -> Column:
    cut = F.col("soft_face_threshold")
    soft = (cut > 0) & F.col("face_detected") & not_false(vl("face_visible")) & (F.col("face_sharpness") < cut)
    return F.when(soft, F.concat(F.lit("soft face (sharpness "), whole(F.col("face_sharpness")), F.lit(" < "), whole(cut), F.lit(")")))


def _not_visible(field: str, text: str) -> Callable[[], Column]:
    return lambda: F.when(~not_false(vl(field)), F.lit(text))


def rule_garment_blurry() -> Column:
    return F.when(vl("garment_clarity") == "blurry", F.lit("vl:blurry garment"))


def rule_low_suitability(t: CoverageLimits = LIMITS) -> Column:
    return F.when(vl("training_suitability") < t.min_suitability, F.concat(F.lit("low suitability ("), vl("training_suitability").cast("string"), F.lit(")")))


#: Rules that purposes name; each gives a reason or null.
RULES: dict[str, Callable[[], Column]] = {
    "multiple_subjects": rule_multiple_subjects,
    "face_blurry": rule_face_blurry,
    "soft_face": rule_soft_face,
    "body_not_visible": _not_visible("body_shape_visible", "body not visible"),
    "pose_not_visible": _not_visible("pose_clearly_visible", "pose not visible"),
    "garment_not_visible": _not_visible("garment_visible", "garment not visible"),
    "garment_blurry": rule_garment_blurry,
}


def hard_reject(df: DataFrame, name: str | Column = "face", t: CoverageLimits = LIMITS) -> DataFrame:
    """Adds reject_reason: the first of quality, duplicate, the purpose's rules and low suitability, or null. A column may name each row's purpose."""
    own = of_purpose(name, lambda p: F.coalesce(*(RULES[r]() for r in p.rules)) if p.rules else F.lit(None).cast("string"))
    return with_threshold(df, t).withColumn("reject_reason", F.coalesce(rule_quality_fail(), rule_duplicate(), own, rule_low_suitability(t)))


def combined_score() -> Column:
    """Rank among images that pass."""
    suit = F.coalesce(vl("training_suitability").cast("double"), F.lit(50.0)) / 100.0
    return F.coalesce(F.col("quality_score"), F.lit(0.0)) * suit * (0.5 + 0.5 * F.coalesce(F.col("uniqueness"), F.lit(0.5)))


def bucket_key(name: str | Column) -> Column:
    return of_purpose(name, lambda p: p.bucket())


def survivors(df: DataFrame, name: str | Column = "face", t: CoverageLimits = LIMITS) -> DataFrame:
    """Rows without a reason to reject, with bucket and combined_score."""
    return hard_reject(df, name, t).where("reject_reason is null").withColumns({"bucket": bucket_key(name), "combined_score": combined_score()})


def bucket_sizes(kept: DataFrame) -> DataFrame:
    return kept.groupBy("job_ref", "bucket").agg(F.count("*").alias("n"))


def _caps(sizes: DataFrame, target: int | Column | None, t: CoverageLimits) -> DataFrame:
    """(job_ref, cap) from bucket sizes; limits that are columns are those of `sizes`, the same in a job."""
    jobs = sizes.groupBy("job_ref")
    found: list[Column] = [] if t.per_bucket_cap is None else [_of_job(t.per_bucket_cap)]
    if not found or isinstance(t.per_bucket_cap, Column):
        counts = [_of_job(target) / F.count("*")] if isinstance(target, Column) else [F.lit(float(target)) / F.count("*")] if target else []
        bases = [*(F.when(_of_job(target) > 0, c) if isinstance(target, Column) else c for c in counts), upper_median("n").cast("double")]
        found.append(F.greatest(_of_job(t.cap_min), F.ceil(F.coalesce(*bases) * _of_job(t.cap_factor))))
    return jobs.agg(F.coalesce(*found).cast("long").alias("cap"))


def _of_job(limit: object) -> Column:
    """A limit as an aggregate of a job's rows."""
    return F.max(limit) if isinstance(limit, Column) else F.lit(limit)


def bucket_caps(kept: DataFrame, target: int | None = None, t: CoverageLimits = LIMITS) -> DataFrame:
    """(job_ref, cap) of survivors: explicit, or from the target, or from the median bucket."""
    return _caps(bucket_sizes(kept), target, t)


def select_images(df: DataFrame, name: str | Column = "face", target: int | Column | None = None, t: CoverageLimits = LIMITS) -> DataFrame:
    """Adds auto_decision, auto_reason, bucket (empty for hard rejects) and combined_score to all rows.

    Survivors are ranked in their bucket by score, then filename; those beyond the cap go. If more than the target
    are left, the lowest go, but never a bucket's first. Purpose, limits and target may be columns of `df`, the same in
    all rows of a job.

    Rows are judged once and written to the shared folder, by jobs that run while the result is built; the result reads
    that. A bucket is ranked in SLICES slices of the score, one after another, so one that holds most rows isn't sorted
    as a whole. How many rows caps leave in each slice follows from the slices' sizes, and so does the slice in which the
    trim ends; only what is left of that is ranked, for the last row to go.
    """
    scratch = Scratch(df.sparkSession)
    slot = F.least(F.greatest(F.floor(combined_score() * SLICES), F.lit(0)), F.lit(SLICES)).cast("int")
    wanted = F.lit(target).cast("long")
    judged = hard_reject(df, name, t).withColumns({"bucket": F.when(F.col("reject_reason").isNull(), bucket_key(name)).otherwise(""), "combined_score": combined_score(), "_ok": F.col("reject_reason").isNull()})
    judged = scratch.write(judged.withColumn("_slice", F.when(F.col("_ok"), slot)).withColumn("_wanted", wanted))
    limits = _columns(target, t)
    sliced = judged.where("_ok").groupBy("job_ref", "bucket", "_slice").agg(F.count("*").alias("n"), F.max("_wanted").alias("_wanted"), *(F.max(c).alias(k) for k, c in limits.items()))
    places = scratch.write(_places(sliced, limits, target, t))
    # rows that aren't ranked are spread, or they would be sorted as one group
    spread = F.pmod(F.xxhash64("filename"), F.lit(4096))
    ranked = judged.join(places.select("job_ref", "bucket", "_slice", "_above", "cap", "_end", "_rest"), ["job_ref", "bucket", "_slice"], "left").withColumn("_part", F.when(F.col("_ok"), F.col("_slice")).otherwise(-1 - spread))
    ranked = _with_rank(ranked)
    over = F.concat(F.lit("over-represented bucket '"), "bucket", F.lit("' (>"), F.col("cap").cast("string"), F.lit("); rank "), F.col("_rank").cast("string"))
    reason = F.coalesce("reject_reason", F.when(~F.col("_in"), over))
    if target is not None and (isinstance(target, Column) or target):
        last = _last_trimmed(judged, places)
        ranked = ranked.join(last, "job_ref", "left")
        gone = (F.col("_slice") < F.col("_end")) | ((F.col("_slice") == F.col("_end")) & (F.struct("combined_score", "filename") <= F.col("_last")))
        trim = F.when(F.col("_in") & (F.col("_rank") > 1) & F.coalesce(gone, F.lit(False)), F.concat(F.lit("target trim (kept top "), F.col("_wanted").cast("string"), F.lit(")")))
        reason = F.coalesce(reason, trim)
    out = ranked.withColumns({"auto_decision": F.when(reason.isNull(), "keep").otherwise("reject"), "auto_reason": F.coalesce(reason, F.lit(""))})
    return out.select(*df.columns, "soft_face_threshold", "bucket", "combined_score", "auto_decision", "auto_reason")


def _with_rank(rows: DataFrame) -> DataFrame:
    """Adds _rank in the bucket and _in, whether the cap leaves a row."""
    place = F.row_number().over(Window.partitionBy("job_ref", "bucket", "_part").orderBy(F.desc("combined_score"), "filename"))
    return rows.withColumn("_rank", F.when(F.col("_ok"), place + F.col("_above"))).withColumn("_in", F.col("_ok") & (F.col("_rank") <= F.col("cap")))


def _places(sliced: DataFrame, limits: dict[str, Column], target: object, t: CoverageLimits) -> DataFrame:
    """Of slices (job_ref, bucket, _slice, n, limits): rows _above in the bucket, cap, and of the job _end, the slice in which the trim ends, with _rest rows of it to go."""
    sizes = sliced.groupBy("job_ref", "bucket").agg(F.sum("n").alias("n"), *(F.max(k).alias(k) for k in limits))
    caps = _caps(sizes, *_named(target, t))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("job_ref", "bucket").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sliced.withColumn("_above", above).join(caps, "job_ref")
    kept = F.greatest(F.least(F.col("n"), F.col("cap") - F.col("_above")), F.lit(0))
    # never a bucket's first
    placed = placed.withColumn("_kept", kept).withColumn("_free", F.col("_kept") - F.when((F.col("_above") == 0) & (F.col("_kept") > 0), 1).otherwise(0))
    free = placed.groupBy("job_ref", "_slice").agg(F.sum("_free").alias("_free"), F.sum("_kept").alias("_kept"), F.max("_wanted").alias("_wanted"))
    job = Window.partitionBy("job_ref")
    free = free.withColumn("_excess", F.when(F.col("_wanted") > 0, F.least(F.sum("_kept").over(job) - F.col("_wanted"), F.sum("_free").over(job))))
    free = free.withColumn("_before", F.coalesce(F.sum("_free").over(job.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    end = free.where((F.col("_before") < F.col("_excess")) & (F.col("_excess") <= F.col("_before") + F.col("_free"))).select("job_ref", F.col("_slice").alias("_end"), (F.col("_excess") - F.col("_before")).alias("_rest"))
    return placed.select("job_ref", "bucket", "_slice", "_above", "cap").join(end, "job_ref", "left")


def _last_trimmed(judged: DataFrame, places: DataFrame) -> DataFrame:
    """(job_ref, _last): score and filename of the last row that the trim takes, from the rows of the slice in which it ends."""
    ends = places.where("_slice = _end")
    rows = judged.where("_ok").select("job_ref", "bucket", "_slice", "combined_score", "filename", "_ok").join(ends, ["job_ref", "bucket", "_slice"])
    free = _with_rank(rows.withColumn("_part", F.col("_slice"))).where((F.col("_rank") <= F.col("cap")) & (F.col("_rank") > 1))
    nth = F.row_number().over(Window.partitionBy("job_ref").orderBy("combined_score", "filename"))
    return free.withColumn("_nth", nth).where("_nth = _rest").select("job_ref", F.struct("combined_score", "filename").alias("_last"))


_CAP_LIMITS = ("per_bucket_cap", "cap_min", "cap_factor")


def _columns(target: object, t: CoverageLimits) -> dict[str, Column]:
    """The limits of caps that are columns, by the names that they have in bucket sizes."""
    every = {"_target": target} | {f"_{k}": getattr(t, k) for k in _CAP_LIMITS}
    return {k: c for k, c in every.items() if isinstance(c, Column)}


def _named(target: object, t: CoverageLimits) -> tuple[object, object]:
    """Target and limits with columns of bucket sizes in place of those of rows."""
    names = _columns(target, t)
    limit = lambda k: F.col(f"_{k}") if f"_{k}" in names else getattr(t, k)
    return F.col("_target") if "_target" in names else target, SimpleNamespace(**{k: limit(k) for k in _CAP_LIMITS})
