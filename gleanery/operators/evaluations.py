"""Normalisation of raw model answers: JSON extraction, coercion by type, one schema for each purpose.

Answers are parsed to VARIANT, which keeps numbers and texts apart. A missing key
is null, an explicit null has the type VOID.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLARITIES, GARMENT_TYPES, POSE_CATEGORIES, SHOT_TYPES, VIEW_ANGLES

_SPACE = r"^\s+|\s+$"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, _SPACE, "")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once however often f names it (columns are written out at each use)."""
    return F.transform(F.array(x), f)[0]


def json_text(answer: Column) -> Column:
    """The text from the first { to the } that balances it; braces in strings count. Null if none does."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(a: Column, x: Column) -> Column:
        depth = a["depth"] + x["d"]
        return F.struct(depth.alias("depth"), (a["at"] + x["n"]).alias("at"), F.when((a["end"] < 0) & (x["d"] == -1) & (depth == 0), a["at"] + 1).otherwise(a["end"]).alias("end"))

    def balanced(rest: Column) -> Column:
        # only braces decide: one step for each of them instead of one for each character
        mark = lambda x: F.struct(F.length(x).alias("n"), F.when(x.startswith("{"), 1).when(x.startswith("}"), -1).otherwise(0).alias("d"))
        marks = F.filter(F.transform(F.split(rest, "(?=[{}])"), mark), lambda x: x["n"] > 0)
        return F.aggregate(marks, zero, step, lambda a: F.when(a["end"] > 0, F.substr(rest, F.lit(1), a["end"])))

    text = strip(F.regexp_replace(answer, r"```(?:json)?", ""))
    return bound(text, lambda t: F.when(F.contains(t, F.lit("{")), bound(F.substr(t, F.instr(t, "{")), balanced)))


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def parsed(answer: Column) -> Column:
    """The answer's JSON object as VARIANT, or null."""
    return bound(F.try_parse_json(json_text(answer)), lambda v: F.when(_is_object(v), v))


def there(x: Column) -> Column:
    """Generates x where it isn't null: a filter after the column would have it computed a second time."""
    return F.explode(F.array_compact(F.array(x)))


class Field:
    """A key of a VARIANT column."""

    def __init__(self, v: Column, key: str):
        self.value = F.variant_get(v, f"$.{key}", "variant")
        self.kind = F.coalesce(F.schema_of_variant(self.value), F.lit("MISSING"))
        self.text = F.try_variant_get(v, f"$.{key}", "string")
        self.number = F.try_variant_get(v, f"$.{key}", "double")
        self.items = F.try_variant_get(v, f"$.{key}", "array<string>")
        self.flag = F.try_variant_get(v, f"$.{key}", "boolean")
        self.is_text, self.is_flag, self.is_null = self.kind == "STRING", self.kind == "BOOLEAN", self.kind == "VOID"
        self.missing = self.kind == "MISSING"
        self.is_number = self.kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def as_bool(f: Field, default: bool) -> Column:
    """Flags as they are, texts true/yes/1 as true and others as false, anything else the default."""
    return F.when(f.is_flag, f.flag).when(f.is_text, F.lower(strip(f.text)).isin("true", "yes", "1")).otherwise(F.lit(default))


def as_label(f: Field, allowed: list[str], default: str) -> Column:
    s = F.lower(strip(f.text))
    return F.when(s.isin(*allowed), s).otherwise(F.lit(default))


def _float_text(s: Column) -> Column:
    """Texts that read as a number."""
    s = strip(s)
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def as_suitability(f: Field) -> Column:
    """Rounded half to even, in 0 to 100; 50 for what isn't a finite number."""
    x = F.when(f.is_number, f.number).when(f.is_flag, f.flag.cast("double")).when(f.is_text, _float_text(f.text))
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(x).cast("bigint")))
    return F.when(x.isNotNull(), clamped).otherwise(50).cast("int")


def as_count(f: Field) -> Column:
    """Numbers cut to whole ones; texts only if they are whole; else 1."""
    text = F.when(strip(f.text).rlike(r"^[+-]?\d+$"), strip(f.text).try_cast("bigint"))
    return F.coalesce(F.when(f.is_number, f.number.cast("bigint")).when(f.is_flag, f.flag.cast("bigint")).when(f.is_text, text), F.lit(1))


def as_list(f: Field) -> Column:
    """Trimmed lower-case items that aren't empty; a text is one item, other types none."""
    items = F.when(f.is_text, F.array(f.text)).when(f.kind.startswith("ARRAY"), F.transform(f.items, lambda x: F.coalesce(x, F.lit("None"))))
    return F.coalesce(F.filter(F.transform(items, lambda x: F.lower(strip(x))), lambda x: x != ""), F.array().cast("array<string>"))


def as_text(f: Field) -> Column:
    """Trimmed, 280 characters at most; an explicit null is the text None."""
    return F.substring(F.when(f.missing, "").when(f.is_null, "None").when(f.is_flag, F.initcap(f.flag.cast("string"))).otherwise(strip(F.coalesce(f.text, F.lit("")))), 1, 280)


_Part = Callable[[Column], Column]


def _flag(key: str, default: bool) -> tuple[str, _Part]:
    return key, lambda v: as_bool(Field(v, key), default)


def _label(key: str, allowed: list[str], default: str) -> tuple[str, _Part]:
    return key, lambda v: as_label(Field(v, key), allowed, default)


def _clarity(key: str) -> tuple[str, _Part]:
    return _label(key, CLARITIES, "slightly_soft")


_SHOT, _VIEW = _label("shot_type", SHOT_TYPES, "other"), _label("view_angle", VIEW_ANGLES, "front")
_COUNT = ("subject_count", lambda v: as_count(Field(v, "subject_count")))
_END = [
    ("issues", lambda v: as_list(Field(v, "issues"))),
    ("training_suitability", lambda v: as_suitability(Field(v, "training_suitability"))),
    ("reason", lambda v: as_text(Field(v, "reason"))),
]


def _tags(v: Column) -> Column:
    tags = as_list(Field(v, "style_tags"))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("unknown")))


#: Fields of each purpose's evaluation, in order.
SCHEMAS: dict[str, list[tuple[str, _Part]]] = {
    "face": [_SHOT, _VIEW, _flag("face_visible", True), _flag("face_occluded", False), _clarity("face_clarity"), _COUNT, _flag("body_shape_visible", False), *_END],
    "full_body": [_SHOT, _VIEW, _COUNT, _flag("full_body_visible", False), _flag("body_shape_visible", False), _flag("body_occluded", False), *_END],
    "pose": [_SHOT, _VIEW, _COUNT, _label("pose_category", POSE_CATEGORIES, "other"), _flag("pose_clearly_visible", True), _flag("body_occluded", False), *_END],
    "outfit": [_SHOT, _VIEW, _COUNT, _label("garment_type", GARMENT_TYPES, "other"), _flag("garment_visible", True), _flag("garment_occluded", False), _clarity("garment_clarity"), *_END],
    "style": [_SHOT, _VIEW, _COUNT, ("style_tags", _tags), _flag("style_consistent", True), *_END],
}


def normalize(v: Column, purpose: str = "face") -> Column:
    """The evaluation struct of a VARIANT object; null for null."""
    fields = SCHEMAS.get(purpose, SCHEMAS["face"])
    return bound(v, lambda v: F.when(v.isNotNull(), F.struct(*(part(v).alias(name) for name, part in fields))))


def attempt_resolve(images: DataFrame, answers: DataFrame, purpose: str = "face") -> DataFrame:
    """images (job_ref, image_id) with `vl` of the first attempt that parses, or defaults, and parse_failed.

    answers: job_ref, image_id, attempt, answer. Only attempts 1 and 2 count.
    """
    read = bound(json_text(F.col("answer")), lambda t: F.when(_is_object(F.try_parse_json(t)), t))
    good = answers.where("attempt in (1, 2)").select("job_ref", "image_id", "attempt", there(read).alias("object"))
    first = good.groupBy("job_ref", "image_id").agg(F.min_by("object", "attempt").alias("object"))
    joined = images.join(first, ["job_ref", "image_id"], "left")
    failed = F.col("object").isNull()
    vl = normalize(F.parse_json(F.coalesce("object", F.lit("{}"))), purpose)
    vl = bound(vl, lambda e: F.when(failed, e.withField("reason", F.lit("model output could not be parsed"))).otherwise(e))
    return joined.select(*images.columns, vl.alias("vl"), failed.alias("parse_failed"))
