"""Quality gate: verdict, reasons and weighted score of measured images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QualityLimits
from ..purposes import PURPOSES, of_purpose

LIMITS = QualityLimits()


def whole(x: Column) -> Column:
    """A number as text without decimals, halves to even."""
    return F.rint(x).cast("bigint").cast("string")


def tenths(x: Column) -> Column:
    """A number as text with one decimal, halves to even."""
    k = F.rint(x * 10).cast("bigint")
    return F.concat(F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"))


def min_side() -> Column:
    return F.least("width", "height")


def usable_face(t: QualityLimits = LIMITS) -> Column:
    return F.col("face_detected") & (F.col("face_area_frac") >= t.face_area_min)


def _checks(t: QualityLimits) -> list[Column]:
    """(severity, reason) of each check in order, null where it finds nothing. 2: fail, 1: warn."""
    found = lambda level, *text: F.struct(F.lit(level).alias("level"), F.concat(*text).alias("reason"))
    side, sharp, face, area = min_side(), F.col("global_sharpness"), F.col("face_sharpness"), F.col("face_area_frac")
    usable = usable_face(t)
    return [
        F.when(side < t.min_side_fail, found(2, F.lit("resolution too low ("), side.cast("string"), F.lit("px)"))).when(side < t.min_side_warn, found(1, F.lit("low resolution ("), side.cast("string"), F.lit("px)"))),
        F.when(sharp < t.global_sharpness_fail, found(2, F.lit("image very blurry (sharpness "), whole(sharp), F.lit(")"))).when(sharp < t.global_sharpness_warn, found(1, F.lit("image slightly soft (sharpness "), whole(sharp), F.lit(")"))),
        F.when(usable & (face < t.face_sharpness_fail), found(2, F.lit("blurry face (face sharpness "), whole(face), F.lit(")"))).when(usable & (face < t.face_sharpness_warn), found(1, F.lit("soft face (face sharpness "), whole(face), F.lit(")"))),
        F.when(usable & (area < t.face_area_warn), found(1, F.lit("small face ("), tenths(area * 100), F.lit("% of frame)"))),
        F.when(F.col("clip_frac") > t.clip_warn, found(1, F.lit("exposure clipping ("), whole(F.col("clip_frac") * 100), F.lit("%)"))),
        F.when(F.col("mean_luma") < t.luma_low, found(1, F.lit("underexposed"))).when(F.col("mean_luma") > t.luma_high, found(1, F.lit("overexposed"))),
    ]


def quality_gate(df: DataFrame, t: QualityLimits = LIMITS) -> DataFrame:
    """Adds quality_verdict (the worst check's) and quality_reasons (in order of the checks). Limits may be columns of `df`."""
    found = F.array_compact(F.array(*_checks(t)))
    worst = F.coalesce(F.array_max(F.transform("_found", lambda x: x["level"])), F.lit(0))
    verdict = F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass")
    return df.withColumn("_found", found).withColumns({"quality_verdict": verdict, "quality_reasons": F.transform("_found", lambda x: x["reason"])}).drop("_found")


def ramp(v: Column, lo: float | Column, hi: float | Column) -> Column:
    """0 up to lo, 1 from hi, a line between; 1 where the interval is empty. Limits may be columns."""
    lo, hi = F.lit(lo), F.lit(hi)
    return F.when(hi <= lo, 1.0).otherwise(F.greatest(F.least((v - lo) / (hi - lo), F.lit(1.0)), F.lit(0.0)))


def score_of(weights: list[Column], t: QualityLimits = LIMITS) -> Column:
    usable = usable_face(t)
    parts = [
        ramp(min_side(), t.min_side_fail, t.min_side_warn),
        ramp(F.col("global_sharpness"), t.global_sharpness_fail, t.global_sharpness_warn * 1.5),
        F.when(usable, ramp(F.col("face_sharpness"), t.face_sharpness_fail, t.face_sharpness_warn * 1.5)).otherwise(t.no_face),
        F.when(usable, ramp(F.col("face_area_frac"), t.face_area_min, t.face_area_warn * 2)).otherwise(t.no_face),
        1.0 - ramp(F.col("clip_frac"), t.clip_warn, t.clip_worst),
    ]
    total = weights[0] * parts[0]
    for w, p in zip(weights[1:], parts[1:], strict=True):
        total = total + w * p
    return F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0))


def quality_score(df: DataFrame, purpose: str | Column = "face", t: QualityLimits = LIMITS) -> DataFrame:
    """Adds quality_score, in 0 to 1, by the weights of a purpose or of that which a column names."""
    weights = [of_purpose(purpose, lambda p, k=k: F.lit(p.weights[k])) for k in range(5)]
    return df.withColumn("quality_score", score_of(weights, t))


def quality_score_by_purpose(df: DataFrame, t: QualityLimits = LIMITS) -> DataFrame:
    """Adds quality_score by the weights of each row's own `purpose`; a table of a few rows is joined."""
    names = ["w_res", "w_global", "w_face", "w_size", "w_expo"]
    weights = df.sparkSession.createDataFrame([(p.name, *p.weights) for p in PURPOSES.values()], "purpose string, " + ", ".join(f"{n} double" for n in names))
    return df.join(F.broadcast(weights), "purpose").withColumn("quality_score", score_of([F.col(n) for n in names], t)).drop(*names)


def rounded_metrics(df: DataFrame) -> DataFrame:
    """Metrics as they are stored, rounded after the verdict."""
    places = {"global_sharpness": 1, "face_sharpness": 1, "face_area_frac": 4, "face_conf": 3, "mean_luma": 1, "clip_frac": 3, "quality_score": 3}
    return df.withColumns({c: F.bround(c, n) for c, n in places.items() if c in df.columns})
