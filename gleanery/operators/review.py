"""Human overrides, apply manifests and analytics over runs."""

from __future__ import annotations

from dataclasses import fields
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CoverageLimits, DedupLimits, QualityLimits
from .ranks import numbered

ACTIVE = ("queued", "running", "apply_queued", "applying", "stopping")


def final_decision() -> Column:
    """A keep or reject override wins, else the automatic decision."""
    return F.when(F.col("user_decision").isin("keep", "reject"), F.col("user_decision")).otherwise(F.col("auto_decision"))


def latest_override(images: DataFrame, log: DataFrame) -> DataFrame:
    """images with user_decision of the last log entry (job_ref, image_id, ts, event_id, decision) for them.

    Anything but keep or reject clears; entries for unknown images have no effect.
    """
    last = log.groupBy("job_ref", "image_id").agg(F.max_by("decision", F.struct("ts", "event_id")).alias("d"))
    joined = images.join(last, ["job_ref", "image_id"], "left")
    return joined.withColumn("user_decision", F.when(F.col("d").isin("keep", "reject"), F.col("d"))).drop("d")


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def sidecar_join(images: DataFrame, texts: DataFrame) -> DataFrame:
    """images (folder, filename, ..) with the caption file of the same stem, or null. texts: folder, filename."""
    captions = texts.where(F.col("filename").endswith(".txt")).select("folder", stem(F.col("filename")).alias("_stem"), F.col("filename").alias("sidecar"))
    return images.withColumn("_stem", stem(F.col("filename"))).join(captions, ["folder", "_stem"], "left").drop("_stem")


def apply_manifest(decided: DataFrame, mode: str = "move", dry_run: bool = False) -> DataFrame:
    """A row for each file of a rejected image: source, target under <folder>_rejected (null where it is deleted), collision.

    decided: folder, filename, sidecar, auto_decision, user_decision. In a dry run `applied` is false.
    """
    gone = decided.where(final_decision() == "reject")
    files = gone.select("folder", F.explode(F.array_compact(F.array("filename", "sidecar"))).alias("name"))
    target = F.concat(F.col("folder"), F.lit("_rejected/"), F.col("name")) if mode == "move" else F.lit(None).cast("string")
    files = files.select(F.concat_ws("/", "folder", "name").alias("source"), target.alias("target"))
    if mode != "move":
        return files.select("source", "target", F.lit(False).alias("collision"), F.lit(not dry_run).alias("applied"))
    counts = files.groupBy("target").agg(F.count("*").alias("n"))
    return files.join(counts, "target").select("source", "target", (F.col("n") > 1).alias("collision"), F.lit(not dry_run).alias("applied"))


def recaption_worklist(decided: DataFrame, recaption: bool = True, dry_run: bool = False) -> DataFrame:
    """Images that stay, where captions are to be made anew."""
    return decided.where((final_decision() == "keep") & F.lit(recaption and not dry_run))


def apply_summary(decided: DataFrame, mode: str = "move", recaption: bool = True, dry_run: bool = False) -> DataFrame:
    """(job_ref, kept, rejected, moved, deleted, recaptioned)."""
    d = final_decision()
    act = F.lit(not dry_run)
    return decided.groupBy("job_ref").agg(
        F.count_if(d == "keep").alias("kept"),
        F.count_if(d == "reject").alias("rejected"),
        F.count_if((d == "reject") & act & F.lit(mode == "move")).alias("moved"),
        F.count_if((d == "reject") & act & F.lit(mode != "move")).alias("deleted"),
        F.count_if((d == "keep") & act & F.lit(recaption)).alias("recaptioned"),
    )


def review_category() -> Column:
    """overflow: over-full bucket; hard: every other automatic reject; kept. Null for rows without a decision."""
    over = F.col("auto_reason").contains("over-represented")
    return F.when(F.col("auto_decision") == "keep", "kept").when((F.col("auto_decision") == "reject") & over, "overflow").when(F.col("auto_decision") == "reject", "hard")


def review_categories(decided: DataFrame) -> DataFrame:
    """(job_ref, keep, reject, overflow, hard): by final decision, and automatic rejects by kind."""
    c, d = review_category(), final_decision()
    return decided.groupBy("job_ref").agg(F.count_if(d == "keep").alias("keep"), F.count_if(d == "reject").alias("reject"), F.count_if(c == "overflow").alias("overflow"), F.count_if(c == "hard").alias("hard"))


def review_page(decided: DataFrame, page: int = 0, size: int = 60, category: str | None = None) -> DataFrame:
    """A page of each job in (bucket, filename) order; empty buckets are called (unbucketed). Only ranges of rows that hold the page are ranked."""
    rows = decided if category is None else decided.where(final_decision() == category) if category in ("keep", "reject") else decided.where(review_category() == category)
    rows = numbered(rows, ["bucket", "filename"], page * size + 1, (page + 1) * size)
    return rows.orderBy("job_ref", "nth").drop("nth").withColumn("section", F.when(F.coalesce("bucket", F.lit("")) == "", "(unbucketed)").otherwise(F.col("bucket")))


def gallery_order(decided: DataFrame) -> DataFrame:
    """Job by job, sections by bucket, kept rows first, then by file."""
    return decided.orderBy("job_ref", "bucket", F.col("auto_decision") != "keep", "filename")


def reject_reasons(decided: DataFrame, most: int = 200) -> DataFrame:
    """(job_ref, filename, auto_reason): the first automatic rejects of each job with a reason, in file order."""
    rows = numbered(decided.where("auto_decision = 'reject' and auto_reason != ''").select("job_ref", "filename", "auto_reason"), ["filename"], 1, most)
    return rows.orderBy("job_ref", "nth").select("job_ref", "filename", "auto_reason")


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("job_ref", "auto_decision").agg(F.count("*").alias("n"))


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    """(status, n), with a row of null status for all."""
    return jobs.rollup("status").agg(F.count("*").alias("n"))


def recent_jobs(jobs: DataFrame, most: int = 10) -> DataFrame:
    """The newest jobs, with progress 0 where there are no steps, and whether they are active."""
    progress = F.when(F.col("total_steps") > 0, F.col("step") / F.col("total_steps")).otherwise(0.0)
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(most).withColumns({"progress": progress, "active": F.col("status").isin(*ACTIVE)})


#: Keys of params that are called otherwise in the limits.
KEYS = {
    "face_area_warn": "face_area_frac_warn", "face_area_min": "face_area_frac_min", "clip_warn": "clip_frac_warn", "luma_low": "mean_luma_low", "luma_high": "mean_luma_high",
    "cosine": "similarity_threshold", "hamming": "phash_exact_max_hamming", "hash_side": "phash_size", "soft_face_ratio": "soft_face_rel_ratio", "min_garment_visible": "min_garment_visible_shots",
}
#: Fields of limits that params don't set.
_INNER = ("processing_long_side", "clip_worst", "no_face")
_TYPES = {bool: "boolean", int: "int", float: "double", str: "string", type(None): "int"}


def _keys(limits) -> dict[str, object]:
    """Key to default of the params of a class of limits."""
    values = {f.name: getattr(limits, f.name) for f in fields(limits) if f.name not in _INNER}
    values |= {f"min_{k}": v for k, v in values.pop("minimums", {}).items()}
    return {KEYS.get(k, k): v for k, v in values.items()}


#: Block of params ('' for the top) to the default of each key; those after the limits are of models and tools.
PARAMS: dict[str, dict[str, object]] = {
    "quality": _keys(QualityLimits()) | {"face_detect_conf": 0.6},
    "dedup": _keys(DedupLimits()) | {"use_clip_embeddings": False, "clip_model": "openai/clip-vit-base-patch32"},
    "coverage": _keys(CoverageLimits()),
    "": {"purpose": "face", "model_name_or_path": "huihui-ai/Huihui-Qwen3-VL-8B-Instruct-abliterated", "device": "cuda:0", "dtype": "bf16", "quantize": False, "qtype": "float8", "low_vram": False, "max_res": 1024, "vl_max_new_tokens": 512, "thumb_size": 384},
}


def job_params(jobs: DataFrame, preset: dict[str, float] | None = None) -> DataFrame:
    """job_id, a column for each key of PARAMS, and target: each job's params JSON over preset (of coverage) and defaults.

    Unknown keys, nulls and values of another type are ignored, broken JSON is empty. A target clears the cap.
    """
    preset = preset or {}
    blocks = [", ".join(f"{k}:{_TYPES[type(v)]}" for k, v in keys.items()) for keys in PARAMS.values()]
    schema = ", ".join(f"{block}:struct<{b}>" if block else b for block, b in zip(PARAMS, blocks, strict=True))
    d = jobs.withColumn("_p", F.from_json("params", f"struct<target:int, {schema}>"))
    target = F.col("_p.target")
    out = {}
    for block, keys in PARAMS.items():
        for k, default in keys.items():
            default = preset.get(k, default) if block == "coverage" else default
            out[k] = F.coalesce(F.col(f"_p.{block}.{k}" if block else f"_p.{k}"), F.lit(default).cast(_TYPES[type(keys[k])]))
    out["per_bucket_cap"] = F.when(target.isNull(), out["per_bucket_cap"])
    return d.select("job_id", *(c.alias(k) for k, c in out.items()), target.alias("target"))


def limits_of(limits: object, prefix: str = "limit_") -> SimpleNamespace:
    """A class of limits with the columns of `with_limits` in place of its values; what params don't set stays as it is."""
    own = {f.name: getattr(limits, f.name) for f in fields(limits)}
    known = {f.name: KEYS.get(f.name, f.name) for f in fields(limits) if f.name not in _INNER and f.name != "minimums"}
    found = own | {name: F.col(prefix + key) for name, key in known.items()}
    if "minimums" in own:
        found["minimums"] = {k: F.col(prefix + KEYS.get(f"min_{k}", f"min_{k}")) for k in own["minimums"]}
    return SimpleNamespace(**found)


def with_limits(rows: DataFrame, params: DataFrame, prefix: str = "limit_") -> DataFrame:
    """rows (job_ref, ..) with all params of their job (job_params, by job_id), as columns limit_<key>; jobs without params have the defaults.

    With `limits_of` these columns take the place of one set of limits, so jobs of different settings go through one run.
    """
    keys = [c for c in params.columns if c != "job_id"]
    own = params.select(F.col("job_id").alias("job_ref"), *(F.col(k).alias(prefix + k) for k in keys))
    defaults = {k: v for block in PARAMS.values() for k, v in block.items()}
    joined = rows.join(own, "job_ref", "left")
    fill = {prefix + k: F.coalesce(prefix + k, F.lit(v)) for k, v in defaults.items() if v is not None}
    return joined.withColumns(fill)
