"""Coverage of what survives the hard rules: requirements, gaps, verdict, histograms, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CoverageLimits
from ..purposes import PURPOSES, Purpose, Requirement, of_purpose, purpose, vl
from .selection import LIMITS, hard_reject


def _count(r: Requirement, where: Column | None = None) -> Column:
    if r.distinct:
        # the field is a label from a short list
        x = F.coalesce(vl(r.distinct), F.lit(r.default))
        return F.size(F.collect_set(x if where is None else F.when(where, x))).cast("long")
    return F.count_if(r.count() if where is None else where & r.count())


def _requirements(name: str | Column) -> list[Requirement]:
    """Those of a purpose; of all purposes, each once, where a column names it."""
    if not isinstance(name, Column):
        return list(purpose(name).requirements)
    return list({r.name: r for p in PURPOSES.values() for r in p.requirements}.values())


def _limit_columns(t: CoverageLimits) -> dict[str, Column]:
    """Limits that are columns, by the names they have in rows of jobs."""
    found = {f"_need_{k}": c for k, c in t.minimums.items()} | {f"_{k}": getattr(t, k) for k in ("min_total_marginal", "min_total_sufficient") if hasattr(t, k)}
    return {k: c for k, c in found.items() if isinstance(c, Column)}


def _own_limit(t: CoverageLimits, key: str, counts: DataFrame) -> Column:
    """A limit as a column of rows of jobs: what requirement_counts carried, or the value itself."""
    value = t.minimums[key.removeprefix("_need_")] if key.startswith("_need_") else getattr(t, key[1:])
    return F.col(key) if isinstance(value, Column) and key in counts.columns else F.lit(value)


def requirement_counts(kept: DataFrame, name: str | Column = "face", t: CoverageLimits = LIMITS) -> DataFrame:
    """(job_ref, one column for each requirement of the purpose) of survivors.

    Purpose and limits may be columns of `kept`, the same in all rows of a job: then counts are there for the requirements
    of all purposes, with `purpose`, and limits that are columns are carried on for coverage_display and coverage_gaps.
    """
    own = [F.max(name).alias("purpose")] if isinstance(name, Column) else []
    return kept.groupBy("job_ref").agg(*own, *(_count(r).alias(r.name) for r in _requirements(name)), *(F.max(c).alias(k) for k, c in _limit_columns(t).items()))


def coverage_display(counts: DataFrame, name: str | Column = "face", t: CoverageLimits = LIMITS) -> DataFrame:
    """(job_ref, place, requirement, label, count, minimum) in the purpose's gap order, from requirement_counts. Purpose and minimums may be columns, as there."""

    def rows(p: Purpose) -> Column:
        by_name = {r.name: r for r in p.requirements}
        return F.array(*(F.struct(F.lit(k).alias("place"), F.lit(n).alias("requirement"), F.lit(by_name[n].label).alias("label"), F.col(n).alias("count"), _own_limit(t, f"_need_{n}", counts).cast("int").alias("minimum")) for k, n in enumerate(p.gaps)))

    return counts.select("job_ref", F.inline(of_purpose(F.col("purpose") if isinstance(name, Column) else name, rows)))


def coverage_gaps(counts: DataFrame, name: str | Column = "face", t: CoverageLimits = LIMITS) -> DataFrame:
    """Requirements below their minimum, with a text."""
    text = F.concat("label", F.lit(": too few ("), F.col("count").cast("string"), F.lit("/"), F.col("minimum").cast("string"), F.lit(")"))
    return coverage_display(counts, name, t).where("count < minimum").withColumn("text", text)


def sufficiency(df: DataFrame, name: str | Column = "face", t: CoverageLimits = LIMITS) -> DataFrame:
    """(job_ref, n_survivors, n_gaps, verdict) for each job of all rows. Purpose and limits may be columns of `df`, the same in all rows of a job."""
    ok = F.col("reject_reason").isNull()
    own = [F.max(name).alias("purpose")] if isinstance(name, Column) else []
    jobs = hard_reject(df, name, t).groupBy("job_ref").agg(F.count_if(ok).alias("n_survivors"), *own, *(_count(r, ok).alias(r.name) for r in _requirements(name)), *(F.max(c).alias(k) for k, c in _limit_columns(t).items()))

    def below(p: Purpose) -> Column:
        return sum((F.when(F.col(r.name) < _own_limit(t, f"_need_{r.name}", jobs), 1).otherwise(0) for r in p.requirements), F.lit(0))

    jobs = jobs.withColumn("n_gaps", of_purpose(F.col("purpose") if isinstance(name, Column) else name, below).cast("long"))
    few, enough = (_own_limit(t, k, jobs) for k in ("_min_total_marginal", "_min_total_sufficient"))
    verdict = F.when(F.col("n_survivors") < few, "insufficient").when((F.col("n_gaps") > 0) | (F.col("n_survivors") < enough), "marginal").otherwise("sufficient")
    return jobs.select("job_ref", "n_survivors", "n_gaps", verdict.alias("verdict"))


def label_counts(kept: DataFrame, field: str, default: str) -> DataFrame:
    """(job_ref, label, n) of an evaluation field."""
    return kept.groupBy("job_ref", F.coalesce(vl(field), F.lit(default)).alias("label")).agg(F.count("*").alias("n"))


def label_map(kept: DataFrame, field: str, default: str) -> DataFrame:
    """(job_ref, counts map<string, bigint>): the same in one row for each job."""
    pairs = F.sort_array(F.collect_list(F.struct("label", "n")))
    return label_counts(kept, field, default).groupBy("job_ref").agg(F.map_from_entries(pairs).alias("counts"))


def coverage_table(selected: DataFrame) -> DataFrame:
    """(job_ref, bucket, total, kept) of selected rows; hard rejects have no bucket."""
    return selected.where("bucket != ''").groupBy("job_ref", "bucket").agg(F.count("*").alias("total"), F.count_if(F.col("auto_decision") == "keep").alias("kept"))


def run_summary(selected: DataFrame, name: str | Column = "face") -> DataFrame:
    """A row of counts for each job, with the purpose's requirement counts (of all purposes, where a column names it). Overflow leaves out trimmed rows."""
    passed = F.col("bucket") != ""
    aggs = [
        F.count("*").alias("n_input"),
        F.round(F.first("soft_face_threshold"), 1).alias("soft_face_threshold"),
        F.count_if(~passed).alias("n_hard_reject"),
        F.count_if(passed).alias("n_survivors"),
        F.count_if(F.col("auto_reason").startswith("over-represented")).alias("n_overflow_reject"),
        F.count_if(F.col("auto_decision") == "keep").alias("n_final_keep"),
    ]
    aggs += [_count(r, passed).alias(r.name) for r in _requirements(name)]
    return selected.groupBy("job_ref").agg(*aggs)
