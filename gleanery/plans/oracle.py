"""The registered queries in SQL, for a check by another engine."""

from __future__ import annotations

from dataclasses import replace

from ..config import CLARITIES, GARMENT_TYPES, POSE_CATEGORIES, SHOT_TYPES, VIEW_ANGLES, CoverageLimits, QualityLimits
from ..operators.measure import dct_weights
from ..operators.review import ACTIVE, KEYS, PARAMS
from ..purposes import PURPOSES
from . import fixtures as X

_Q, _C = QualityLimits(), CoverageLimits()
_IMAGE = r"'(?i)\.(png|jpg|jpeg|webp|bmp)$'"


def _d(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}e0"


def _six(x: str) -> str:
    return f"round_even(({x}) * 1000000e0, 0) / 1000000e0"


def _whole(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def _ramp(v: str, lo: float, hi: float) -> str:
    return f"greatest(least(({v} - {_d(lo)}) / ({_d(hi)} - {_d(lo)}), 1e0), 0e0)"


_SIDE = "least(width, height)"
_TENTHS = "CAST(round_even(face_area_frac * 100 * 10, 0) AS BIGINT)"


def _usable(q: QualityLimits) -> str:
    return f"(face_detected AND face_area_frac >= {_d(q.face_area_min)})"


def _checks(q: QualityLimits) -> list[list[tuple[str, int, str]]]:
    return [
        [(f"{_SIDE} < {q.min_side_fail}", 2, f"concat('resolution too low (', {_SIDE}, 'px)')"), (f"{_SIDE} < {q.min_side_warn}", 1, f"concat('low resolution (', {_SIDE}, 'px)')")],
        [(f"global_sharpness < {q.global_sharpness_fail}", 2, f"concat('image very blurry (sharpness ', {_whole('global_sharpness')}, ')')"), (f"global_sharpness < {q.global_sharpness_warn}", 1, f"concat('image slightly soft (sharpness ', {_whole('global_sharpness')}, ')')")],
        [(f"{_usable(q)} AND face_sharpness < {q.face_sharpness_fail}", 2, f"concat('blurry face (face sharpness ', {_whole('face_sharpness')}, ')')"), (f"{_usable(q)} AND face_sharpness < {q.face_sharpness_warn}", 1, f"concat('soft face (face sharpness ', {_whole('face_sharpness')}, ')')")],
        [(f"{_usable(q)} AND face_area_frac < {_d(q.face_area_warn)}", 1, f"concat('small face (', {_TENTHS} // 10, '.', {_TENTHS} % 10, '% of frame)')")],
        [(f"clip_frac > {_d(q.clip_warn)}", 1, f"concat('exposure clipping (', {_whole('clip_frac * 100')}, '%)')")],
        [(f"mean_luma < {q.luma_low}", 1, "'underexposed'"), (f"mean_luma > {q.luma_high}", 1, "'overexposed'")],
    ]


def _level(q: QualityLimits) -> str:
    return "greatest(" + ", ".join("CASE " + " ".join(f"WHEN {c} THEN {s}" for c, s, _ in check) + " ELSE 0 END" for check in _checks(q)) + ")"


def _reasons(q: QualityLimits) -> str:
    return "list_filter([" + ", ".join("CASE " + " ".join(f"WHEN {c} THEN {t}" for c, _, t in check) + " END" for check in _checks(q)) + "], lambda x: x IS NOT NULL)"


def _score(weights: list[str], q: QualityLimits = _Q) -> str:
    parts = [
        _ramp(_SIDE, q.min_side_fail, q.min_side_warn),
        _ramp("global_sharpness", q.global_sharpness_fail, q.global_sharpness_warn * 1.5),
        f"CASE WHEN {_usable(q)} THEN {_ramp('face_sharpness', q.face_sharpness_fail, q.face_sharpness_warn * 1.5)} ELSE {_d(q.no_face)} END",
        f"CASE WHEN {_usable(q)} THEN {_ramp('face_area_frac', q.face_area_min, q.face_area_warn * 2)} ELSE {_d(q.no_face)} END",
        f"(1e0 - {_ramp('clip_frac', q.clip_warn, q.clip_worst)})",
    ]
    return "greatest(least(" + " + ".join(f"{w} * {p}" for w, p in zip(weights, parts, strict=True)) + ", 1e0), 0e0)"


def _rules(c: CoverageLimits = _C) -> dict[str, str]:
    return {
        "quality_fail": "CASE WHEN quality_verdict = 'fail' THEN concat('quality:', array_to_string(quality_reasons[1:2], '; ')) END",
        "duplicate": "CASE WHEN is_duplicate THEN 'duplicate' END",
        "multiple_subjects": "CASE WHEN coalesce(subject_count, 1) > 1 OR many_issue THEN 'multiple subjects' END",
        "face_blurry": "CASE WHEN face_clarity = 'blurry' AND coalesce(face_visible, true) THEN 'vl:blurry face' END",
        "soft_face": f"CASE WHEN cut > 0 AND face_detected AND coalesce(face_visible, true) AND face_sharpness < cut THEN concat('soft face (sharpness ', {_whole('face_sharpness')}, ' < ', {_whole('cut')}, ')') END",
        "body_not_visible": "CASE WHEN NOT coalesce(body_shape_visible, true) THEN 'body not visible' END",
        "pose_not_visible": "CASE WHEN NOT coalesce(pose_clearly_visible, true) THEN 'pose not visible' END",
        "garment_not_visible": "CASE WHEN NOT coalesce(garment_visible, true) THEN 'garment not visible' END",
        "garment_blurry": "CASE WHEN garment_clarity = 'blurry' THEN 'vl:blurry garment' END",
        "low_suitability": f"CASE WHEN training_suitability < {c.min_suitability} THEN concat('low suitability (', training_suitability, ')') END",
    }


_RULES = _rules()
_VIEW, _SHOT = "coalesce(view_angle, 'front')", "coalesce(shot_type, 'other')"
_BUCKET = {
    "face": f"concat({_VIEW}, '|', {_SHOT})",
    "full_body": f"concat({_VIEW}, '|', {_SHOT})",
    "pose": "coalesce(pose_category, 'other')",
    "outfit": f"concat(coalesce(garment_type, 'other'), '|', {_VIEW})",
    "style": "coalesce(style_tag, 'unknown')",
}
_COUNTS = {
    "front_face": "count(*) FILTER (view_angle = 'front' AND shot_type IN ('closeup_face', 'head_and_shoulders'))",
    "profiles": "count(*) FILTER (starts_with(view_angle, 'profile'))",
    "three_quarter": "count(*) FILTER (starts_with(view_angle, 'three_quarter'))",
    "full_body": "count(*) FILTER (shot_type = 'full_body')",
    "full_body_shots": "count(*) FILTER (shot_type = 'full_body')",
    "distinct_views": f"count(DISTINCT {_VIEW})",
    "body_visible": "count(*) FILTER (body_shape_visible)",
    "pose_categories": "count(DISTINCT coalesce(pose_category, 'other'))",
    "pose_visible": "count(*) FILTER (pose_clearly_visible)",
    "garment_types": "count(DISTINCT coalesce(garment_type, 'other'))",
    "garment_visible": "count(*) FILTER (garment_visible)",
    "style_consistent": "count(*) FILTER (style_consistent)",
    "style_variety": f"count(DISTINCT {_SHOT})",
}


def _median(x: str) -> str:
    return f"list_sort(list({x}))[count(*) // 2 + 1]"


def _chain(p: str = "face", target: int | None = None, cap: int | None = None, q: QualityLimits = _Q, c: CoverageLimits = _C) -> str:
    """Common tables from records to selected rows."""
    reason = ", ".join(_rules(c)[r] for r in ("quality_fail", "duplicate", *PURPOSES[p].rules, "low_suitability"))
    limit = str(cap) if cap is not None else f"greatest({c.cap_min}, CAST(ceil(" + (f"({_d(target)} / count(*))" if target else f"CAST({_median('n')} AS DOUBLE)") + f" * {_d(c.cap_factor)}) AS BIGINT))"
    trim = f"ok AND rank <= cap AND rank > 1 AND nth <= n_in - {target}" if target else "false"
    return f"""
WITH records AS ({X.RECORDS_SQL}),
gated AS (SELECT *, CASE {_level(q)} WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS quality_verdict, {_reasons(q)} AS quality_reasons FROM records),
scored AS (SELECT *, {_score([_d(w) for w in PURPOSES[p].weights], q)} AS quality_score FROM gated),
faces AS (SELECT job_ref, {_median('face_sharpness')} AS m FROM records WHERE face_detected AND face_sharpness > 0 AND {str(c.soft_face_reject).lower()} GROUP BY job_ref),
cuts AS (SELECT j.job_ref, CASE WHEN m IS NULL THEN 0e0 ELSE greatest({_d(c.soft_face_floor)}, m * {_d(c.soft_face_ratio)}) END AS cut FROM (SELECT DISTINCT job_ref FROM records) j LEFT JOIN faces f ON j.job_ref = f.job_ref),
ruled AS (SELECT s.*, cut FROM scored s JOIN cuts c ON s.job_ref = c.job_ref),
judged AS (SELECT *, coalesce({reason}) AS reject_reason, {_BUCKET[p]} AS bucket_key,
  quality_score * (coalesce(CAST(training_suitability AS DOUBLE), 50e0) / 100e0) * (0.5e0 + 0.5e0 * coalesce(uniqueness, 0.5e0)) AS combined FROM ruled),
kept AS (SELECT *, bucket_key AS bucket FROM judged WHERE reject_reason IS NULL),
sizes AS (SELECT job_ref, bucket, count(*) AS n FROM kept GROUP BY ALL),
caps AS (SELECT job_ref, {limit} AS cap FROM sizes GROUP BY job_ref),
ranked AS (SELECT j.*, cap, reject_reason IS NULL AS ok, row_number() OVER (PARTITION BY j.job_ref, bucket_key, reject_reason IS NULL ORDER BY combined DESC, filename) AS rank FROM judged j LEFT JOIN caps c ON j.job_ref = c.job_ref),
counted AS (SELECT *, count(*) FILTER (ok AND rank <= cap) OVER (PARTITION BY job_ref) AS n_in,
  row_number() OVER (PARTITION BY job_ref, ok AND rank <= cap AND rank > 1 ORDER BY combined, filename) AS nth FROM ranked),
selected AS (SELECT *, CASE WHEN ok THEN bucket_key ELSE '' END AS bucket,
  coalesce(reject_reason, CASE WHEN rank > cap THEN concat('over-represented bucket ''', bucket_key, ''' (>', cap, '); rank ', rank) END, CASE WHEN {trim} THEN 'target trim (kept top {target})' END, '') AS auto_reason FROM counted),
decided AS (SELECT s.*, CASE WHEN s.auto_reason = '' THEN 'keep' ELSE 'reject' END AS auto_decision, u.decision AS user_decision FROM selected s
  LEFT JOIN (SELECT doc_id, decision FROM ({X.OVERRIDES_SQL}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) = 1) u ON s.doc_id = u.doc_id)
"""


TARGET = 60
_FACE = _chain("face", TARGET)
_MIRROR = "(CASE WHEN {0} < 0 THEN 1 WHEN {0} >= {n} THEN {n} - 2 ELSE {0} END)"


def _laplacian(pixels: str, n: int, scale: int) -> tuple[str, str]:
    """Population variance of the Laplacian of lists `pixels`, of whole numbers."""
    at = lambda r, c: f"{pixels}[{_MIRROR.format(r, n=n)} * {n} + {_MIRROR.format(c, n=n)} + 1]"
    r, c = f"(k // {n})", f"(k % {n})"
    lap = f"{at(r + ' - 1', c)} + {at(r + ' + 1', c)} + {at(r, c + ' - 1')} + {at(r, c + ' + 1')} - 4 * {pixels}[k + 1]"
    return f"list_transform(range({n * n}), lambda k: CAST({lap} AS BIGINT)) AS lap", f"({n * n} * list_sum(list_transform(lap, lambda x: x * x)) - list_sum(lap) * list_sum(lap)) / {_d(n * n * n * n * scale * scale)}"


_LAP8, _VAR8 = _laplacian("pixels", 8, 1)
_LAP4, _VAR4 = _laplacian("half", 4, 4)
_HALF = "list_transform(range(16), lambda k: " + " + ".join(f"pixels[((k // 4) * 2 + {i}) * 8 + (k % 4) * 2 + {j} + 1]" for i in (0, 1) for j in (0, 1)) + ") AS half"

_VECTORS = f"""
WITH RECURSIVE raw AS ({X.VECTORS_SQL}),
v AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS norm, list_sum(list_transform(range(64), lambda i: CASE WHEN v[i + 1] > 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END)) AS bits FROM raw),
sims AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) / (a.norm * b.norm) AS sim, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS distance FROM v a JOIN v b ON a.id < b.id),
edges AS (SELECT a, b FROM sims WHERE sim >= 0.9e0 OR distance <= 4),
both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
members AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a),
numbered AS (SELECT component, row_number() OVER (ORDER BY min(concat('img_', lpad(CAST(id AS VARCHAR), 8, '0'), '.png'))) - 1 AS cluster_id FROM members GROUP BY component),
clustered AS (SELECT v.id, concat('img_', lpad(CAST(v.id AS VARCHAR), 8, '0'), '.png') AS filename, (v.id * 61) % 1000 / 1000 AS q, coalesce(cluster_id, -1) AS cluster_id FROM v LEFT JOIN members m ON v.id = m.id LEFT JOIN numbered n ON m.component = n.component),
flagged AS (SELECT *, cluster_id >= 0 AND row_number() OVER (PARTITION BY cluster_id ORDER BY q DESC, filename) > 1 AS is_duplicate FROM clustered),
tops AS (SELECT id, greatest(0, max(sim)) AS max_sim FROM (SELECT a AS id, sim FROM sims UNION ALL SELECT b, sim FROM sims) GROUP BY id)
"""

_DCT = "[" + ", ".join("list_inner_product(p, [" + ", ".join(_d(x) if "e" not in repr(x) else repr(x) for x in w) + "])" for w in dct_weights(8, 4)) + "] AS low"

_BEST_BOX = f"SELECT * FROM ({X.BOXES_SQL}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w * h DESC, box_no) = 1"

# --- answers ---------------------------------------------------------------

_CLEAN = r"regexp_replace(answer, '```(json)?', '', 'g')"
#: Answers nest braces two deep at most.
_OBJECT = r"CASE WHEN {0} THEN '{{not json}}' ELSE nullif(regexp_extract(" + _CLEAN + r", '\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}'), '') END"
_EXTRACT = _OBJECT.format("contains(answer, '{not json}')")
_ANSWERS = f"WITH answers AS ({X.ANSWERS_SQL}), objects AS (SELECT doc_id, job_ref, attempt, {_EXTRACT} AS object FROM answers), good AS (SELECT doc_id, job_ref, attempt, object AS j FROM objects WHERE object IS NOT NULL AND object <> '{{not json}}')"


def _text(key: str) -> str:
    return f"(j ->> '$.{key}')"


def _kind(key: str) -> str:
    return f"json_type(j, '$.{key}')"


def _bool(key: str, default: bool) -> str:
    return f"CASE {_kind(key)} WHEN 'BOOLEAN' THEN {_text(key)} = 'true' WHEN 'VARCHAR' THEN lower(trim({_text(key)})) IN ('true', 'yes', '1') ELSE {str(default).lower()} END"


def _enum(key: str, allowed: list[str], default: str) -> str:
    return f"CASE WHEN lower(trim({_text(key)})) IN ({', '.join(repr(a) for a in allowed)}) THEN lower(trim({_text(key)})) ELSE '{default}' END"


_NUMBER = "('BIGINT', 'UBIGINT', 'DOUBLE')"
_SUIT = f"CASE WHEN {_kind('training_suitability')} = 'BOOLEAN' THEN CASE WHEN {_text('training_suitability')} = 'true' THEN 1 ELSE 0 END WHEN TRY_CAST({_text('training_suitability')} AS DOUBLE) IS NULL THEN 50 ELSE CAST(greatest(0, least(100, round_even(TRY_CAST({_text('training_suitability')} AS DOUBLE), 0))) AS BIGINT) END"
_SUBJECTS = f"CASE WHEN {_kind('subject_count')} IN {_NUMBER} THEN CAST(trunc(CAST({_text('subject_count')} AS DOUBLE)) AS BIGINT) WHEN {_kind('subject_count')} = 'VARCHAR' AND regexp_full_match({_text('subject_count')}, '[0-9]+') THEN CAST({_text('subject_count')} AS BIGINT) ELSE 1 END"


def _list(key: str) -> str:
    items = f"CASE {_kind(key)} WHEN 'VARCHAR' THEN [{_text(key)}] WHEN 'ARRAY' THEN json_extract_string(j, '$.{key}[*]') ELSE [] END"
    return f"array_to_string(list_filter(list_transform({items}, lambda x: lower(trim(x))), lambda x: x <> ''), ',')"


_REASON = f"substr(CASE WHEN {_kind('reason')} IS NULL THEN '' WHEN {_kind('reason')} = 'NULL' THEN 'None' WHEN {_kind('reason')} = 'OBJECT' THEN replace(CAST(json_extract(j, '$.reason') AS VARCHAR), ' ', '') ELSE trim({_text('reason')}) END, 1, 280)"
_TAGS = f"CASE WHEN {_list('style_tags')} = '' THEN 'unknown' ELSE {_list('style_tags')} END"
_FIELDS = {
    "shot_type": _enum("shot_type", SHOT_TYPES, "other"),
    "view_angle": _enum("view_angle", VIEW_ANGLES, "front"),
    "face_visible": _bool("face_visible", True),
    "face_occluded": _bool("face_occluded", False),
    "face_clarity": _enum("face_clarity", CLARITIES, "slightly_soft"),
    "garment_clarity": _enum("garment_clarity", CLARITIES, "slightly_soft"),
    "subject_count": _SUBJECTS,
    "body_shape_visible": _bool("body_shape_visible", False),
    "full_body_visible": _bool("full_body_visible", False),
    "body_occluded": _bool("body_occluded", False),
    "pose_category": _enum("pose_category", POSE_CATEGORIES, "other"),
    "pose_clearly_visible": _bool("pose_clearly_visible", True),
    "garment_type": _enum("garment_type", GARMENT_TYPES, "other"),
    "garment_visible": _bool("garment_visible", True),
    "garment_occluded": _bool("garment_occluded", False),
    "style_consistent": _bool("style_consistent", True),
    "style_tags": _TAGS,
    "issues": _list("issues"),
    "training_suitability": _SUIT,
    "reason": _REASON,
}


_SHARED = ("shot_type", "view_angle", "subject_count", "issues", "training_suitability", "reason")
_OWN = {
    "face": ("face_visible", "face_occluded", "face_clarity", "body_shape_visible"),
    "full_body": ("full_body_visible", "body_shape_visible", "body_occluded"),
    "pose": ("pose_category", "pose_clearly_visible", "body_occluded"),
    "outfit": ("garment_type", "garment_visible", "garment_occluded", "garment_clarity"),
    "style": ("style_tags", "style_consistent"),
}

_FILES = f"WITH files AS ({X.FILES_SQL})"
_SIDECARS = f"images AS (SELECT i.doc_id, i.folder, i.filename, t.filename AS sidecar FROM files i LEFT JOIN files t ON i.folder = t.folder AND t.filename = concat(regexp_replace(i.filename, '\\.[^.]*$', ''), '.txt') WHERE regexp_matches(i.filename, {_IMAGE}))"
_BROKEN = "CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 4) ELSE props END"

ORACLE: dict[str, str] = {
    "image_id": f"{_FILES} SELECT path, substr(md5(concat(job_ref, ':', path)), 1, 16) AS image_id FROM files",
    "image_scan_filter": f"{_FILES} SELECT path, filename FROM files WHERE regexp_matches(filename, {_IMAGE}) AND NOT starts_with(filename, '.')",
    "sidecar_join": f"{_FILES}, {_SIDECARS} SELECT folder, filename, sidecar FROM images",
    "dataset_catalog": f"{_FILES} SELECT * FROM (SELECT split_part(folder, '/', 4) AS name, folder AS path, concat('/', split_part(folder, '/', 2), '/', split_part(folder, '/', 3)) AS root, count(*) FILTER (regexp_matches(filename, {_IMAGE})) AS n_images FROM files GROUP BY folder) WHERE NOT starts_with(name, '_') AND NOT starts_with(name, '.') AND NOT ends_with(name, '_rejected')",
    "results_read": f"SELECT concat('img_', lpad(CAST(event_id AS VARCHAR), 8, '0')) AS filename, CASE WHEN json_valid({_BROKEN}) THEN CAST(json_extract({_BROKEN}, '$.k') AS BIGINT) END AS k, CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n_reasons FROM events WHERE event_type = 'view'",
    "job_cascade_delete": "SELECT user_id AS job_ref, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0)",
    "exposure": f"SELECT vec_id, list_sum(pixels) / 64 AS mean_luma, len(list_filter(pixels, lambda x: x < 6 OR x > 249)) / 64 AS clip_frac FROM ({X.GRIDS_SQL})",
    "laplacian_var": f"SELECT vec_id, {_VAR8} AS sharpness FROM (SELECT vec_id, {_LAP8} FROM ({X.GRIDS_SQL}))",
    "global_sharpness": f"SELECT vec_id, {_VAR4} AS sharpness FROM (SELECT vec_id, {_LAP4} FROM (SELECT vec_id, {_HALF} FROM ({X.GRIDS_SQL})))",
    "phash_bits": f"SELECT vec_id, array_to_string(list_transform(low, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS hash_bits FROM (SELECT *, list_sort(low[6:8] || low[10:12] || low[14:16])[5] AS m FROM (SELECT vec_id, {_DCT} FROM (SELECT vec_id, list_transform(pixels, lambda x: CAST(x AS DOUBLE)) AS p FROM ({X.GRIDS_SQL}))))",
    "largest_face": f"SELECT doc_id, box_no, x, y, w, h, score FROM ({_BEST_BOX})",
    "face_area": f"WITH records AS ({X.RECORDS_SQL}), best AS ({_BEST_BOX}) SELECT r.doc_id, coalesce(CAST(w * h AS DOUBLE) / CAST(width * height AS DOUBLE), 0e0) AS face_area_frac, w IS NOT NULL AS face_detected FROM records r LEFT JOIN best b ON r.doc_id = b.doc_id",
    "eye_band_box": f"""
WITH e AS (SELECT doc_id, box_no, CAST(x AS DOUBLE) AS rx, CAST(y AS DOUBLE) AS ry, CAST(x + w / 4 AS DOUBLE) AS lx, CAST(y + box_no AS DOUBLE) AS ly FROM ({X.BOXES_SQL})),
m AS (SELECT *, sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry)) AS d, (rx + lx) / 2e0 AS cx, (ry + ly) / 2e0 AS cy FROM e),
b AS (SELECT *, CAST(trunc(greatest(0e0, cx - d * 1.25e0)) AS INTEGER) AS x0, CAST(trunc(greatest(0e0, cy - d * 0.55e0)) AS INTEGER) AS y0, CAST(trunc(least(64e0, cx + d * 1.25e0)) AS INTEGER) AS x1, CAST(trunc(least(48e0, cy + d * 0.55e0)) AS INTEGER) AS y1 FROM m),
o AS (SELECT *, d >= 6 AND x1 - x0 >= 4 AND y1 - y0 >= 4 AS ok FROM b)
SELECT doc_id, box_no, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1 FROM o""",
    "face_sharpness_choice": f"SELECT doc_id, CASE WHEN NOT face_detected THEN 0e0 WHEN doc_id % 3 > 0 THEN face_sharpness ELSE global_sharpness END AS face_sharpness FROM ({X.RECORDS_SQL})",
    "quality_verdict": f"{_FACE} SELECT doc_id, quality_verdict FROM gated",
    "quality_reasons": f"{_FACE} SELECT doc_id, array_to_string(quality_reasons, '; ') AS quality_reasons FROM gated",
    "quality_score": f"{_FACE} SELECT doc_id, {_six('quality_score')} AS quality_score FROM scored",
    "quality_score_by_purpose": _FACE + " UNION ALL ".join(f"SELECT doc_id, '{p.name}' AS purpose, {_six(_score([_d(w) for w in p.weights]))} AS quality_score FROM records" for p in PURPOSES.values()),
    "json_extract": f"{_ANSWERS} SELECT doc_id, attempt, object FROM objects",
    "attempt_resolve": f"""{_ANSWERS},
best AS (SELECT * FROM good WHERE attempt <= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY attempt) = 1),
j AS (SELECT d.doc_id, d.lang AS job_ref, b.j IS NULL AS parse_failed, coalesce(b.j, '{{}}') AS j FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id)
SELECT doc_id AS image_id, job_ref, parse_failed, {_FIELDS['view_angle']} AS view_angle, {_FIELDS['subject_count']} AS subject_count, CASE WHEN parse_failed THEN 'model output could not be parsed' ELSE {_REASON} END AS reason FROM j""",
    "vector_choice": "SELECT concat('job', label % 3) AS job_ref, vec_id, CAST(CASE WHEN bool_and(NOT (label % 3 = 1 AND vec_id % 10 = 0)) OVER (PARTITION BY label % 3) THEN 64 ELSE 1 END AS BIGINT) AS dims FROM embeddings",
    "cosine_pairs": f"{_VECTORS} SELECT a, b, {_six('sim')} AS sim FROM sims WHERE sim >= 0.9e0",
    "cosine_pairs_lsh": f"{_VECTORS}, firsts AS (SELECT min(id) AS id, v FROM v GROUP BY v) SELECT a, b, {_six('sim')} AS sim FROM sims WHERE sim >= 0.9e0 AND a IN (SELECT id FROM firsts) AND b IN (SELECT id FROM firsts) UNION ALL SELECT f.id, v.id, {_six('1e0')} FROM v JOIN firsts f ON v.v = f.v AND v.id <> f.id",
    "cosine_lsh_recall": f"{_VECTORS} SELECT count(*) AS n_pairs, true AS enough FROM sims WHERE sim >= 0.9e0",
    "similar_uniqueness": f"{_VECTORS}, near AS (SELECT id, count(*) AS n_near FROM (SELECT a AS id FROM sims WHERE sim >= 0.9e0 UNION ALL SELECT b FROM sims WHERE sim >= 0.9e0) GROUP BY id) SELECT t.id, round((1 - max_sim - min(1 - max_sim) OVER ()) / (max(1 - max_sim) OVER () - min(1 - max_sim) OVER ()), 3) AS uniqueness, coalesce(n_near, 0) AS n_near FROM tops t LEFT JOIN near n ON t.id = n.id",
    "hamming_pairs": f"{_VECTORS}, firsts AS (SELECT min(id) AS id, bits FROM v GROUP BY bits) SELECT a, b, distance FROM sims WHERE distance <= 4 AND a IN (SELECT id FROM firsts) AND b IN (SELECT id FROM firsts) UNION ALL SELECT f.id, v.id, 0 FROM v JOIN firsts f ON v.bits = f.bits AND v.id <> f.id",
    "near_dup_edges": f"{_VECTORS} SELECT a, b FROM edges",
    "near_dup_components": f"{_VECTORS} SELECT id, component FROM members",
    "cluster_ids": f"{_VECTORS} SELECT id, cluster_id FROM clustered",
    "cluster_representative": f"{_VECTORS} SELECT cluster_id, id FROM flagged WHERE cluster_id >= 0 AND NOT is_duplicate",
    "duplicate_flags": f"{_VECTORS} SELECT id, is_duplicate FROM flagged",
    "max_similarity_pruned": f"{_VECTORS} SELECT id, {_six('max_sim')} AS max_sim FROM tops",
    "max_similarity": f"{_VECTORS} SELECT id, {_six('max_sim')} AS max_sim FROM tops",
    "uniqueness": f"{_VECTORS} SELECT id, round((1 - max_sim - min(1 - max_sim) OVER ()) / (max(1 - max_sim) OVER () - min(1 - max_sim) OVER ()), 3) AS uniqueness FROM tops",
    "soft_face_threshold": f"{_FACE} SELECT job_ref, {_six('cut')} AS soft_face_threshold FROM cuts",
    **{f"rule_{r}": f"{_FACE} SELECT doc_id, {e} AS reason FROM ruled WHERE {e} IS NOT NULL" for r, e in _RULES.items()},
    "combined_score": f"{_FACE} SELECT doc_id, {_six('combined')} AS combined_score FROM judged",
    "bucket_cap": f"""{_FACE}, all_caps AS (SELECT job_ref, count(*) AS n, {_median('n')} AS m FROM sizes GROUP BY job_ref)
SELECT job_ref, CAST(5 AS BIGINT) AS cap, 'explicit' AS mode FROM all_caps UNION ALL SELECT job_ref, greatest(6, CAST(ceil(200e0 / n * 1.5e0) AS BIGINT)), 'target' FROM all_caps UNION ALL SELECT job_ref, greatest(6, CAST(ceil(m * 1.5e0) AS BIGINT)), 'median' FROM all_caps""",
    "bucket_cap_select": f"{_chain('face', None, 4)} SELECT doc_id, bucket, auto_decision, auto_reason FROM decided WHERE bucket <> ''",
    "target_trim": f"{_chain('face', 20)} SELECT doc_id, bucket, auto_reason FROM decided WHERE starts_with(auto_reason, 'target trim')",
    "sufficiency": f"""{_FACE}, c AS (SELECT job_ref, count(*) AS n, {', '.join(f"{_COUNTS[r.name]} AS {r.name}" for r in PURPOSES['face'].requirements)} FROM kept GROUP BY job_ref),
g AS (SELECT j.job_ref, coalesce(n, 0) AS n_survivors, coalesce({' + '.join(f"CASE WHEN {r.name} < {_C.minimums[r.name]} THEN 1 ELSE 0 END" for r in PURPOSES['face'].requirements)}, {len(PURPOSES['face'].requirements)}) AS n_gaps FROM (SELECT DISTINCT job_ref FROM records) j LEFT JOIN c ON j.job_ref = c.job_ref)
SELECT job_ref, n_survivors, CAST(n_gaps AS BIGINT) AS n_gaps, CASE WHEN n_survivors < {_C.min_total_marginal} THEN 'insufficient' WHEN n_gaps > 0 OR n_survivors < {_C.min_total_sufficient} THEN 'marginal' ELSE 'sufficient' END AS verdict FROM g""",
    "view_counts": f"{_FACE} SELECT job_ref, {_VIEW} AS label, count(*) AS n FROM kept GROUP BY ALL",
    "shot_counts": f"{_FACE} SELECT job_ref, {_SHOT} AS label, count(*) AS n FROM kept GROUP BY ALL",
    "coverage_table": f"{_FACE} SELECT job_ref, bucket, count(*) AS total, count(*) FILTER (auto_decision = 'keep') AS kept FROM decided WHERE bucket <> '' GROUP BY ALL",
    "run_summary": f"""{_FACE}, k AS (SELECT job_ref, {', '.join(f"{_COUNTS[r.name]} AS {r.name}" for r in PURPOSES['face'].requirements)} FROM kept GROUP BY job_ref),
s AS (SELECT job_ref, count(*) AS n_input, round(any_value(cut), 1) AS soft_face_threshold, count(*) FILTER (bucket = '') AS n_hard_reject, count(*) FILTER (bucket <> '') AS n_survivors, count(*) FILTER (starts_with(auto_reason, 'over-represented')) AS n_overflow_reject, count(*) FILTER (auto_decision = 'keep') AS n_final_keep FROM decided GROUP BY job_ref)
SELECT s.*, {', '.join(f"coalesce({r.name}, 0) AS {r.name}" for r in PURPOSES['face'].requirements)} FROM s LEFT JOIN k ON s.job_ref = k.job_ref""",
    "decision_counts": f"{_FACE} SELECT job_ref, auto_decision, count(*) AS n FROM decided GROUP BY ALL",
    "jobs_by_status": f"SELECT status, count(*) AS n FROM ({X.JOBS_SQL}) GROUP BY ROLLUP (status)",
    "recent_jobs": f"SELECT job_id, status, CASE WHEN total_steps > 0 THEN step / total_steps ELSE 0e0 END AS progress, status IN ({', '.join(repr(a) for a in ACTIVE)}) AS active FROM ({X.JOBS_SQL}) ORDER BY created_at DESC, job_id DESC LIMIT 10",
    "job_params": f"""
WITH j AS (SELECT job_id, CASE WHEN json_valid(params) THEN params ELSE '{{}}' END AS p FROM ({X.JOBS_SQL})),
v AS (SELECT job_id, CAST(p ->> '$.coverage.min_suitability' AS BIGINT) AS m, CAST(p ->> '$.coverage.per_bucket_cap' AS BIGINT) AS c, CAST(p ->> '$.target' AS BIGINT) AS t FROM j)
SELECT job_id, coalesce(m, {_C.min_suitability}) AS min_suitability, CASE WHEN t IS NULL THEN c END AS per_bucket_cap, t AS target FROM v""",
}


def _display(p: str, gaps: bool) -> str:
    own = PURPOSES[p]
    label = {r.name: r.label for r in own.requirements}
    rows = " UNION ALL ".join(f"SELECT job_ref, {k} AS place, '{n}' AS requirement, '{label[n]}' AS label, {n} AS count, {_C.minimums[n]} AS minimum FROM c" for k, n in enumerate(own.gaps))
    base = f"{_chain(p, TARGET)}, c AS (SELECT job_ref, {', '.join(f'{_COUNTS[r.name]} AS {r.name}' for r in own.requirements)} FROM kept GROUP BY job_ref), d AS ({rows})"
    if gaps:
        return base + " SELECT job_ref, place, requirement, count, minimum, concat(label, ': too few (', count, '/', minimum, ')') AS text FROM d WHERE count < minimum"
    return base + " SELECT * FROM d"


ORACLE["coverage_display"] = _display("face", False)
for _p in PURPOSES:
    ORACLE[f"hard_reject_{_p}"] = f"{_chain(_p, TARGET)} SELECT doc_id, reject_reason FROM judged"
    ORACLE[f"bucket_key_{_p}"] = f"SELECT doc_id, {_BUCKET[_p]} AS bucket FROM ({X.RECORDS_SQL})"
    ORACLE[f"select_{_p}"] = f"{_chain(_p, TARGET)} SELECT doc_id, job_ref, filename, bucket, {_six('combined')} AS combined_score, auto_decision, auto_reason FROM decided"
    ORACLE[f"requirement_counts_{_p}"] = f"{_chain(_p, TARGET)} SELECT job_ref, {', '.join(f'{_COUNTS[r.name]} AS {r.name}' for r in PURPOSES[_p].requirements)} FROM kept GROUP BY job_ref"
    ORACLE[f"coverage_gaps_{_p}"] = _display(_p, True)
    ORACLE[f"coverage_gaps_small_jobs_{_p}"] = X.in_small_jobs(_display(_p, True))

# --- review and answers ------------------------------

_ALL = f"{_FACE}, every AS (SELECT *, coalesce(user_decision, auto_decision) AS decision FROM decided)"
ORACLE |= {
    "latest_override": f"{_ALL} SELECT job_ref, doc_id, user_decision FROM every",
    "final_decision": f"{_ALL} SELECT job_ref, doc_id, decision FROM every",
    "apply_manifest": f"""{_ALL}, files AS ({X.FILES_SQL}), {_SIDECARS},
gone AS (SELECT i.folder, unnest([i.filename, i.sidecar]) AS name FROM images i JOIN every o ON i.doc_id = o.doc_id WHERE decision = 'reject'),
m AS (SELECT concat(folder, '/', name) AS source, concat(folder, '_rejected/', name) AS target FROM gone WHERE name IS NOT NULL)
SELECT source, target, count(*) OVER (PARTITION BY target) > 1 AS collision, true AS applied FROM m""",
    "recaption_worklist": f"{_ALL} SELECT job_ref, doc_id, filename FROM every WHERE decision = 'keep'",
    "apply_summary": f"{_ALL} SELECT job_ref, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'reject') AS rejected, count(*) FILTER (decision = 'reject') AS moved, CAST(0 AS BIGINT) AS deleted, count(*) FILTER (decision = 'keep') AS recaptioned FROM every GROUP BY job_ref",
    "review_categories": f"{_ALL} SELECT job_ref, count(*) FILTER (decision = 'keep') AS keep, count(*) FILTER (decision = 'reject') AS reject, count(*) FILTER (auto_decision = 'reject' AND contains(auto_reason, 'over-represented')) AS overflow, count(*) FILTER (auto_decision = 'reject' AND NOT contains(auto_reason, 'over-represented')) AS hard FROM every GROUP BY job_ref",
    "review_page": f"{_ALL} SELECT job_ref, doc_id, bucket, filename, CASE WHEN bucket = '' THEN '(unbucketed)' ELSE bucket END AS section FROM every QUALIFY row_number() OVER (PARTITION BY job_ref ORDER BY bucket, filename) BETWEEN 61 AND 120",
    "gallery_order": f"{_ALL} SELECT job_ref, doc_id, bucket, auto_decision, filename FROM every",
    "reject_reasons": f"{_ALL} SELECT job_ref, filename, auto_reason FROM every WHERE auto_decision = 'reject' AND auto_reason <> '' QUALIFY row_number() OVER (PARTITION BY job_ref ORDER BY filename) <= 200",
}


def _every_attempt(*names: str) -> str:
    return f"{_ANSWERS} SELECT doc_id, attempt, {', '.join(f'{_FIELDS[n]} AS {n}' for n in names)} FROM good"


ORACLE |= {
    "coerce_bool": _every_attempt("face_visible", "face_occluded"),
    "coerce_enum": _every_attempt("shot_type", "face_clarity"),
    "coerce_int": _every_attempt("training_suitability", "subject_count"),
    "coerce_list": _every_attempt("issues"),
    "coerce_text": _every_attempt("reason"),
    **{f"normalize_{p}": _every_attempt(*_SHARED, *own) for p, own in _OWN.items()},
}


def _param(block: str, key: str, default: object) -> str:
    kind = {bool: "BOOLEAN", float: "DOUBLE", str: "VARCHAR"}.get(type(default), "INTEGER")
    value = "NULL" if default is None else repr(default) if isinstance(default, str) else _d(default) if isinstance(default, float) else str(default)
    x = f"coalesce(CAST(p ->> '$.{block + '.' if block else ''}{key}' AS {kind}), {value})"
    return f"CASE WHEN CAST(p ->> '$.target' AS INTEGER) IS NULL THEN {x} END AS {key}" if key == "per_bucket_cap" else f"{x} AS {key}"


ORACLE["job_params_all_keys"] = f"""
WITH j AS (SELECT job_id, CASE WHEN json_valid(params) THEN params ELSE '{{}}' END AS p FROM ({X.WIDE_JOBS_SQL}))
SELECT job_id, {', '.join(_param(b, k, v) for b, keys in PARAMS.items() for k, v in keys.items())}, CAST(p ->> '$.target' AS INTEGER) AS target FROM j"""



def _own(params: dict, block: str) -> dict[str, object]:
    """A block of params by the names of the limits."""
    names = {v: k for k, v in KEYS.items()}
    return {names.get(k, k): v for k, v in params.get(block, {}).items()}


# --- jobs of different settings --------------------------------------------

_BY_JOB = {
    job: _chain("face", params.get("target"), params.get("coverage", {}).get("per_bucket_cap") if not params.get("target") else None, replace(_Q, **_own(params, "quality")), replace(_C, **{k: v for k, v in _own(params, "coverage").items() if k != "per_bucket_cap"}))
    for job, params in X.JOB_SETTINGS.items()
}
ORACLE["select_by_job"] = " UNION ALL ".join(f"SELECT * FROM ({sql} SELECT doc_id, job_ref, bucket, quality_verdict, {_six('combined')} AS combined_score, auto_decision, auto_reason FROM decided WHERE job_ref = '{job}')" for job, sql in _BY_JOB.items())

ORACLE["select_by_purpose"] = " UNION ALL ".join(f"SELECT doc_id, concat(job_ref, ':{p}') AS job_ref, filename, bucket, combined_score, auto_decision, auto_reason FROM ({ORACLE[f'select_{p}']})" for p in PURPOSES)


def _own_limits(params: dict) -> CoverageLimits:
    own = _own(params, "coverage")
    return replace(_C, **{k: v for k, v in own.items() if not k.startswith("min_") or k.startswith("min_total")}, minimums=_C.minimums | {k.removeprefix("min_"): v for k, v in own.items() if k.startswith("min_") and not k.startswith("min_total")})


def _of_job(job: str, params: dict) -> str:
    return _chain(params["purpose"], params.get("target"), None, replace(_Q, **_own(params, "quality")), _own_limits(params))


def _of_all_jobs(select) -> str:
    """`select` gives the query of a job over its common tables, which hold all languages."""
    return " UNION ALL ".join(f"SELECT * FROM ({_of_job(job, params)} {select(job, params)})" for job, params in X.PURPOSE_SETTINGS.items())


def _job_sufficiency(job: str, params: dict) -> str:
    t, needs = _own_limits(params), PURPOSES[params["purpose"]].requirements
    counts = ", ".join(f"{_COUNTS[r.name]} AS {r.name}" for r in needs)
    gaps = " + ".join(f"CASE WHEN {r.name} < {t.minimums[r.name]} THEN 1 ELSE 0 END" for r in needs)
    lang = job.split(":")[0]
    return f"""SELECT '{job}' AS job_ref, n_survivors, CAST(n_gaps AS BIGINT) AS n_gaps, CASE WHEN n_survivors < {t.min_total_marginal} THEN 'insufficient' WHEN n_gaps > 0 OR n_survivors < {t.min_total_sufficient} THEN 'marginal' ELSE 'sufficient' END AS verdict
FROM (SELECT *, {gaps} AS n_gaps FROM (SELECT count(*) AS n_survivors, {counts} FROM kept WHERE job_ref = '{lang}')) WHERE EXISTS (SELECT 1 FROM records WHERE job_ref = '{lang}')"""


def _job_gaps(job: str, params: dict) -> str:
    t, own = _own_limits(params), PURPOSES[params["purpose"]]
    label = {r.name: r.label for r in own.requirements}
    counts = ", ".join(f"{_COUNTS[r.name]} AS {r.name}" for r in own.requirements)
    rows = " UNION ALL ".join(f"SELECT {k} AS place, '{n}' AS requirement, '{label[n]}' AS label, (SELECT {n} FROM c) AS count, {t.minimums[n]} AS minimum" for k, n in enumerate(own.gaps))
    return f"SELECT '{job}' AS job_ref, place, requirement, count, minimum, concat(label, ': too few (', count, '/', minimum, ')') AS text FROM (WITH c AS (SELECT {counts} FROM kept WHERE job_ref = '{job.split(':')[0]}' HAVING count(*) > 0) {rows}) WHERE count < minimum"


ORACLE["select_by_purpose_and_job"] = _of_all_jobs(lambda job, _: f"SELECT doc_id, '{job}' AS job_ref, bucket, {_six('combined')} AS combined_score, auto_decision, auto_reason FROM decided WHERE job_ref = '{job.split(':')[0]}'")
ORACLE["sufficiency_by_job"] = _of_all_jobs(_job_sufficiency)
ORACLE["coverage_gaps_by_job"] = _of_all_jobs(_job_gaps)


def _by_vector_job(key: str, default: float) -> str:
    return "CASE a % 1000000 % 3 " + " ".join(f"WHEN {k} THEN {_d(p.get(key, default))}" for k, p in enumerate(X.DEDUP_SETTINGS.values())) + " END"


ORACLE["dedup_by_job"] = _VECTORS.replace("edges AS (SELECT a, b FROM sims WHERE sim >= 0.9e0 OR distance <= 4)", f"edges AS (SELECT a, b FROM sims WHERE a % 1000000 % 3 = b % 1000000 % 3 AND (sim >= {_by_vector_job('similarity_threshold', 0.9)} OR distance <= {_by_vector_job('phash_exact_max_hamming', 4)}))") + " SELECT concat('v', id % 1000000 % 3) AS job_ref, id, component FROM members"

# --- pictures --------------------------------------------------------------


def _crop_sharpness() -> str:
    """Of the 4 x 4 box at (2, 1), each pixel blown up to 64 x 64: inside a block the Laplacian is 0, along its edges the steps to its neighbours."""
    at = lambda r, c: f"pixels[({r} + 1) * 8 + {c} + 3]"
    total, square = [], []
    for r in range(4):
        for c in range(4):
            up, down, left, right = (f"({at(r + i, c + j)} - {at(r, c)})" if 0 <= r + i < 4 and 0 <= c + j < 4 else "0" for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1)))
            total.append(f"64 * ({up} + {down} + {left} + {right})")
            square.append(" + ".join([f"62 * {x} * {x}" for x in (up, down, left, right)] + [f"({x} + {y}) * ({x} + {y})" for x in (up, down) for y in (left, right)]))
    n = "65536e0"
    return f"(({' + '.join(square)}) / {n} - (({' + '.join(total)}) / {n}) * (({' + '.join(total)}) / {n}))"


_PICTURES = f"WITH g AS ({X.GRIDS_SQL})"
ORACLE["measured_pictures"] = f"""{_PICTURES}, l AS (SELECT *, {_LAP8} FROM g), m AS (SELECT *, vec_id % 2 = 0 AS face FROM l)
SELECT concat('vec_', vec_id) AS path, 8 AS width, 8 AS height, {_six(_VAR8)} AS global_sharpness, list_sum(pixels) / 64 AS mean_luma, len(list_filter(pixels, lambda x: x < 6 OR x > 249)) / 64 AS clip_frac,
face AS face_detected, CASE WHEN face THEN 16 / 64 ELSE 0e0 END AS face_area_frac, CASE WHEN face THEN 0.5e0 ELSE 0e0 END AS face_conf, CASE WHEN face THEN {_six(_crop_sharpness())} ELSE 0e0 END AS face_sharpness FROM m"""
_MEANS = "list_transform(range(16), lambda k: CAST(floor((" + " + ".join(f"pixels[((k // 4) * 2 + {i}) * 8 + (k % 4) * 2 + {j} + 1]" for i in (0, 1) for j in (0, 1)) + ") / 4 + 0.5) AS BIGINT)) AS half"
ORACLE["measured_pictures_shrunk"] = f"""{_PICTURES}, s AS (SELECT vec_id, {_MEANS} FROM g), l AS (SELECT *, {_LAP4} FROM s)
SELECT concat('vec_', vec_id) AS path, 8 AS width, 8 AS height, {_six(f"({_VAR4}) * 16")} AS global_sharpness, list_sum(half) / 16 AS mean_luma, len(list_filter(half, lambda x: x < 6 OR x > 249)) / 16 AS clip_frac FROM l"""

_SHARES = "sqrt(CASE WHEN spread > 0 THEN 0.62e0 * 0.62e0 ELSE 0e0 END + 0.62e0 * 0.62e0 + 0.22e0 * 0.22e0)"
ORACLE["perceptual_vector"] = f"""{_PICTURES}, m AS (SELECT *, list_sum(pixels) / 64 AS mean FROM g),
s AS (SELECT *, list_sum(list_transform(pixels, lambda x: (x - mean) * (x - mean))) AS spread, list_transform(range(4), lambda j: len(list_filter(pixels, lambda x: x // 64 = j))) AS bins FROM m),
u AS (SELECT *, {_SHARES} AS size, sqrt(list_sum(list_transform(bins, lambda x: x * x))) AS colours FROM s),
v AS (SELECT vec_id, list_concat(list_transform(pixels, lambda x: CASE WHEN spread > 0 THEN 0.62e0 * (x - mean) / (3 * sqrt(spread)) / size ELSE 0e0 END), [0.62e0 / 16 / size], list_transform(bins, lambda x: 0.22e0 * x / colours / size)) AS x FROM u)
SELECT concat('vec_', vec_id) AS path, CAST(k AS INTEGER) AS k, CAST(CAST(x[k + 1] AS FLOAT) AS DOUBLE) AS x FROM v, range(69) r(k)"""

_TINY = QualityLimits(min_side_fail=4, min_side_warn=8, global_sharpness_fail=2000.0, global_sharpness_warn=4000.0, luma_low=118.0, luma_high=139.0, clip_warn=0.01)
_NO_VL = ", ".join(f"CAST(NULL AS {kind}) AS {n}" for kind, names in {"INTEGER": ("subject_count", "training_suitability"), "VARCHAR": ("face_clarity", "garment_clarity", "view_angle", "shot_type", "pose_category", "garment_type", "style_tag"), "BOOLEAN": ("face_visible", "body_shape_visible", "pose_clearly_visible", "garment_visible", "style_consistent")}.items() for n in names)
_SAME_JOB = "a % 1000000 % 3 = b % 1000000 % 3"
# pictures with metrics, cluster, duplicate flag and uniqueness, in the place of records
_PICTURE_RECORDS = (
    _VECTORS.strip().replace("sims AS (", "every AS (").replace("edges AS (SELECT a, b FROM sims WHERE sim >= 0.9e0 OR distance <= 4)", f"sims AS (SELECT * FROM every WHERE {_SAME_JOB}), edges AS (SELECT a, b FROM sims WHERE sim >= 0.9e0)")
    .replace("row_number() OVER (ORDER BY min(", "row_number() OVER (PARTITION BY component % 1000000 % 3 ORDER BY min(")
    + f""",
pg AS ({X.GRIDS_SQL}), pl AS (SELECT *, {_LAP8} FROM pg),
metrics AS (SELECT vec_id, 8 AS width, 8 AS height, {_VAR8} AS global_sharpness, list_sum(pixels) / 64 AS mean_luma, len(list_filter(pixels, lambda x: x < 6 OR x > 249)) / 64 AS clip_frac, {_crop_sharpness()} AS crop FROM pl),
pictures AS (SELECT v.id AS doc_id, concat('p', v.id % 1000000 % 3) AS job_ref, concat('img_', lpad(CAST(v.id AS VARCHAR), 8, '0'), '.png') AS filename, width, height, global_sharpness, v.id % 2 = 0 AND v.id < 1000000 AS face_detected,
  CASE WHEN v.id % 2 = 0 AND v.id < 1000000 THEN 16 / 64 ELSE 0e0 END AS face_area_frac, CASE WHEN v.id % 2 = 0 AND v.id < 1000000 THEN crop ELSE 0e0 END AS face_sharpness, mean_luma, clip_frac FROM v JOIN metrics m ON v.id % 1000000 = m.vec_id),
valued AS (SELECT *, {_score([_d(w) for w in PURPOSES['face'].weights], _TINY)} AS own_score FROM pictures),
grouped AS (SELECT p.*, coalesce(cluster_id, -1) AS cluster_id FROM valued p LEFT JOIN members m ON p.doc_id = m.id LEFT JOIN numbered n ON m.component = n.component),
alone AS (SELECT id, max_sim, id % 1000000 % 3 AS j FROM tops)
SELECT g.*, cluster_id >= 0 AND row_number() OVER (PARTITION BY job_ref, cluster_id ORDER BY own_score DESC, filename) > 1 AS is_duplicate,
  coalesce(u.uniqueness, 0) AS uniqueness, {_NO_VL}, false AS many_issue FROM grouped g
JOIN (SELECT id, round((1 - max_sim - min(1 - max_sim) OVER (PARTITION BY j)) / (max(1 - max_sim) OVER (PARTITION BY j) - min(1 - max_sim) OVER (PARTITION BY j)), 3) AS uniqueness FROM alone) u ON g.doc_id = u.id"""
)
ORACLE["pictures_to_selection"] = _chain("face", 40, None, _TINY).replace(f"records AS ({X.RECORDS_SQL})", f"records AS ({_PICTURE_RECORDS})") + f" SELECT job_ref, doc_id AS id, cluster_id, uniqueness, quality_verdict, {_six('combined')} AS combined_score, auto_decision, auto_reason FROM decided"

# --- sinks, read again -----------------------------------------------------

ORACLE["results_upsert"] = """
SELECT lang AS job_ref, concat('img_', doc_id) AS image_id, CASE WHEN lang NOT IN ('de', 'fr') THEN n_chars WHEN n_chars % 6 = 0 THEN n_chars + 1 ELSE n_chars END AS value,
CAST(CASE WHEN lang NOT IN ('de', 'fr') THEN 1 WHEN n_chars % 6 = 0 THEN 3 ELSE 2 END AS BIGINT) AS updated_at FROM documents WHERE lang NOT IN ('de', 'fr') OR n_chars % 2 = 0"""
ORACLE["report_records"] = f"{_FACE} SELECT doc_id, job_ref, bucket, auto_decision, auto_reason, {_six('combined')} AS combined_score FROM decided"
ORACLE["report_summary"] = ORACLE["run_summary"]
ORACLE["quarantine_split"] = f"{_FACE} SELECT doc_id, job_ref, auto_decision AS decision FROM decided"

# --- unreadable images, empty folders, stored metrics ----------------------

ORACLE["read_report"] = f"SELECT *, CASE WHEN read_errors = n_images THEN 'no readable images' END AS error FROM (SELECT lang AS job_ref, count(*) AS n_images, count(*) FILTER ({X.HEIGHT} <= 0) AS read_errors FROM documents GROUP BY lang)"
ORACLE["dataset_catalog_folders"] = f"{_FILES}, all_folders AS ({X.FOLDERS_SQL}) SELECT * FROM (SELECT split_part(d.path, '/', 4) AS name, d.path, concat('/', split_part(d.path, '/', 2), '/', split_part(d.path, '/', 3)) AS root, count(*) FILTER (regexp_matches(filename, {_IMAGE})) AS n_images FROM all_folders d LEFT JOIN files f ON f.folder = d.path GROUP BY d.path) WHERE NOT starts_with(name, '_') AND NOT starts_with(name, '.') AND NOT ends_with(name, '_rejected')"
_PLACES = {"global_sharpness": 1, "face_sharpness": 1, "face_area_frac": 4, "face_conf": 3, "mean_luma": 1, "clip_frac": 3, "quality_score": 3}
ORACLE["rounded_metrics"] = "SELECT doc_id, " + ", ".join(f"round_even({X.LONG_METRICS[n]}, {k}) AS {n}" for n, k in _PLACES.items()) + " FROM documents"
