"""Training purposes: for each the score weights, bucket key, requirements and rejection rules.

A purpose is an entry of PURPOSES; operators take everything from it. Own purposes
can be added to the registry with the same Column builders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Vl = Callable[[str], Column]


def vl(name: str) -> Column:
    """A field of the evaluation."""
    return F.col("vl")[name]


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def not_false(c: Column) -> Column:
    """A missing flag counts as true."""
    return F.coalesce(c, F.lit(True))


@dataclass(frozen=True)
class Requirement:
    """Rows that must be there: those that satisfy `count`, or distinct values of `distinct` (missing: `default`)."""

    name: str
    label: str
    count: Callable[[], Column] | None = None
    distinct: str | None = None
    default: str = "other"


@dataclass(frozen=True)
class Purpose:
    name: str
    #: Resolution, global sharpness, face sharpness, face size, exposure.
    weights: tuple[float, float, float, float, float]
    bucket: Callable[[], Column]
    requirements: tuple[Requirement, ...]
    #: Rules of operators.selection.RULES, the first that holds wins.
    rules: tuple[str, ...]
    #: Order of gaps, where it isn't the requirements' own.
    gap_order: tuple[str, ...] = ()

    @property
    def gaps(self) -> tuple[str, ...]:
        return self.gap_order or tuple(r.name for r in self.requirements)


def _view() -> Column:
    return F.coalesce(vl("view_angle"), F.lit("front"))


def _shot() -> Column:
    return F.coalesce(vl("shot_type"), F.lit("other"))


def _view_shot() -> Column:
    return F.concat_ws("|", _view(), _shot())


_VIEWS = Requirement("distinct_views", "Distinct views", distinct="view_angle", default="front")

#: Names, weights, order of requirements, of rules and of gaps.
PURPOSES = {
    p.name: p
    for p in (
        Purpose(
            "face",
            (0.18, 0.22, 0.32, 0.13, 0.15),
            _view_shot,
            (
                Requirement("front_face", "Front faces", lambda: (vl("view_angle") == "front") & vl("shot_type").isin("closeup_face", "head_and_shoulders")),
                Requirement("profiles", "Profiles", lambda: vl("view_angle").startswith("profile")),
                Requirement("three_quarter", "Three-quarter views", lambda: vl("view_angle").startswith("three_quarter")),
                Requirement("full_body", "Full bodies", lambda: vl("shot_type") == "full_body"),
                _VIEWS,
            ),
            ("multiple_subjects", "face_blurry", "soft_face"),
            ("front_face", "three_quarter", "profiles", "full_body", "distinct_views"),
        ),
        Purpose(
            "full_body",
            (0.25, 0.35, 0.10, 0.05, 0.25),
            _view_shot,
            (
                Requirement("full_body_shots", "Full-body shots", lambda: vl("shot_type") == "full_body"),
                Requirement("body_visible", "Visible bodies", lambda: is_true(vl("body_shape_visible"))),
                _VIEWS,
            ),
            ("multiple_subjects", "body_not_visible"),
        ),
        Purpose(
            "pose",
            (0.25, 0.40, 0.0, 0.0, 0.35),
            lambda: F.coalesce(vl("pose_category"), F.lit("other")),
            (
                Requirement("pose_categories", "Pose categories", distinct="pose_category"),
                Requirement("pose_visible", "Visible poses", lambda: is_true(vl("pose_clearly_visible"))),
            ),
            ("multiple_subjects", "pose_not_visible"),
        ),
        Purpose(
            "outfit",
            (0.25, 0.45, 0.0, 0.0, 0.30),
            lambda: F.concat_ws("|", F.coalesce(vl("garment_type"), F.lit("other")), _view()),
            (
                Requirement("garment_types", "Garment types", distinct="garment_type"),
                Requirement("garment_visible", "Visible garments", lambda: is_true(vl("garment_visible"))),
            ),
            ("multiple_subjects", "garment_not_visible", "garment_blurry"),
        ),
        Purpose(
            "style",
            (0.30, 0.30, 0.0, 0.0, 0.40),
            lambda: F.coalesce(F.try_element_at(vl("style_tags"), F.lit(1)), F.lit("unknown")),
            (
                Requirement("style_consistent", "Consistent styles", lambda: is_true(vl("style_consistent"))),
                Requirement("style_variety", "Distinct shots", distinct="shot_type"),
            ),
            (),
        ),
    )
}


def purpose(name: str | None) -> Purpose:
    """The purpose of that name; unknown names and None mean face."""
    return PURPOSES.get(name or "face", PURPOSES["face"])


def of_purpose(name: str | Column | None, build: Callable[[Purpose], Column]) -> Column:
    """`build` for one purpose, or for that which a column names in each row; unknown names and nulls mean face."""
    if not isinstance(name, Column):
        return build(purpose(name))
    out = None
    for p in PURPOSES.values():
        if p.name != "face":
            out = F.when(name == p.name, build(p)) if out is None else out.when(name == p.name, build(p))
    return build(PURPOSES["face"]) if out is None else out.otherwise(build(PURPOSES["face"]))
