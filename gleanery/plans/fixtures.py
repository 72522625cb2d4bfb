"""Tables of the selection engine, derived from the generic test tables.

Expressions that Spark and the checking engine both read are shared; they only
make inputs, never results.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GARMENT_TYPES, POSE_CATEGORIES, SHOT_TYPES, VIEW_ANGLES
from ..purposes import PURPOSES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: str, labels: list[str]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(labels)) + " END"


def _missing(every: int, at: int, value: str) -> str:
    return f"CASE WHEN doc_id % {every} = {at} THEN NULL ELSE {value} END"


_FACE = "doc_id % 5 <> 0"
#: Columns of a record over documents d left join labels l, in both engines' SQL.
RECORD = {
    "doc_id": "doc_id",
    "job_ref": "lang",
    "filename": "concat('img_', lpad(CAST(doc_id AS STRING), 8, '0'), '.png')",
    "width": "400 + (doc_id * 37) % 1200",
    "height": "400 + (doc_id * 53) % 1200",
    "global_sharpness": "CAST((doc_id * 71) % 3000 AS DOUBLE) / 10",
    "face_detected": _FACE,
    "face_area_frac": f"CASE WHEN {_FACE} THEN CAST((doc_id * 13) % 400 AS DOUBLE) / 10000 ELSE CAST(0 AS DOUBLE) END",
    "face_sharpness": f"CASE WHEN {_FACE} THEN CAST((doc_id * 97) % 9000 AS DOUBLE) / 10 ELSE CAST(0 AS DOUBLE) END",
    "mean_luma": "CAST((doc_id * 29) % 256 AS DOUBLE)",
    "clip_frac": "CAST((doc_id * 17) % 100 AS DOUBLE) / 200",
    "is_duplicate": "doc_id % 11 = 0",
    "uniqueness": "CAST((doc_id * 41) % 1000 AS DOUBLE) / 1000",
    "subject_count": _missing(53, 7, "CASE WHEN doc_id % 19 = 0 THEN 2 ELSE 1 END"),
    "face_clarity": "CASE WHEN doc_id % 17 = 0 THEN 'blurry' WHEN doc_id % 3 = 0 THEN 'slightly_soft' ELSE 'sharp' END",
    "garment_clarity": "CASE WHEN doc_id % 17 = 0 THEN 'blurry' WHEN doc_id % 3 = 0 THEN 'slightly_soft' ELSE 'sharp' END",
    "view_angle": _missing(41, 3, _pick("doc_id % 6", VIEW_ANGLES)),
    "shot_type": _missing(43, 5, _pick("(doc_id * 7 + 3) % 5", SHOT_TYPES)),
    "pose_category": _missing(47, 9, _pick("(doc_id * 3 + 1) % 7", POSE_CATEGORIES)),
    "garment_type": _missing(37, 11, _pick("(doc_id * 5 + 2) % 7", GARMENT_TYPES)),
    "style_tag": _missing(10, 0, _pick("doc_id % 4", ["anime", "oil", "photo", "sketch"])),
    "face_visible": _missing(31, 2, "doc_id % 23 <> 0"),
    "body_shape_visible": _missing(7, 3, "doc_id % 4 <> 0"),
    "pose_clearly_visible": _missing(9, 4, "doc_id % 6 <> 1"),
    "garment_visible": _missing(13, 5, "doc_id % 8 <> 2"),
    "style_consistent": _missing(15, 6, "doc_id % 3 <> 1"),
    "many_issue": "doc_id % 29 = 0",
    "training_suitability": "CASE WHEN quality IS NULL THEN NULL ELSE 30 + 40 * quality - 25 * toxic + (doc_id * 31) % 30 END",
}
_VL = ["subject_count", "face_clarity", "garment_clarity", "view_angle", "shot_type", "pose_category", "garment_type", "face_visible", "body_shape_visible", "pose_clearly_visible", "garment_visible", "style_consistent", "training_suitability"]

RECORDS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in RECORD.items()) + " FROM (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x"


#: The same with a job for each language and source: small jobs, in which each purpose has gaps.
SMALL_JOB = "concat(lang, '/', source)"


def in_small_jobs(sql: str) -> str:
    return sql.replace("lang AS job_ref", f"{SMALL_JOB} AS job_ref").replace("d.lang, l.quality", "d.lang, d.source, l.quality")


def records(spark: SparkSession, sf_dir: str, job: str = "lang") -> DataFrame:
    """One row for each document: metrics, and the evaluation as struct `vl`."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(job).alias("lang")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    # generated, as if read from a table: rules are not rewritten in terms of the expressions that make the fixture
    flat = d.select(F.inline(F.array(F.struct(*(F.expr(e).alias(n) for n, e in RECORD.items())))))
    issues = F.when(F.col("many_issue"), F.array(F.lit("multiple_subjects"), F.lit("watermark_or_text"))).otherwise(F.array(F.lit("occlusion")))
    tags = F.when(F.col("style_tag").isNotNull(), F.array("style_tag", F.lit("other"))).otherwise(F.array().cast("array<string>"))
    vl = F.struct(*_VL, issues.alias("issues"), tags.alias("style_tags"))
    return flat.withColumn("vl", vl).drop(*_VL, "many_issue", "style_tag")


# --- vectors with planted near-duplicates ---------------------------------

VECTORS_SQL = """
SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
UNION ALL SELECT vec_id + 1000000, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (1 + 0.2e0 * ((i + vec_id) % 3 - 1))) FROM embeddings WHERE vec_id % 7 = 0
UNION ALL SELECT vec_id + 2000000, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (1 + 0.3e0 * ((i + vec_id) % 3 - 1))) FROM embeddings WHERE vec_id % 21 = 0
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_ref, id, filename, features, quality_score): the embeddings, and scaled copies of some."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))

    def copies(every: int, plus: int, by: float) -> DataFrame:
        scaled = F.transform("v", lambda x, i: x * (1 + by * ((i + 1 + F.col("vec_id")) % 3 - 1)))
        return e.where(F.col("vec_id") % every == 0).select((F.col("vec_id") + plus).alias("id"), scaled.alias("features"))

    out = e.select(F.col("vec_id").alias("id"), F.col("v").alias("features")).union(copies(7, 1000000, 0.2)).union(copies(21, 2000000, 0.3))
    name = F.concat(F.lit("img_"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(".png"))
    return out.select(F.lit("all").alias("job_ref"), "id", name.alias("filename"), "features", ((F.col("id") * 61) % 1000 / 1000).alias("quality_score"))


def sign_words(v, width: int = 64):
    """A hash of one 64-bit word from the signs of a vector."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    return F.array(F.aggregate(F.transform(v, bit), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x)))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image): the grids as rows of the `image` source, of one channel."""
    pixels = F.unhex(F.array_join(F.transform("pixels", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    image = F.struct(F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), pixels.alias("data"))
    return grids(spark, sf_dir).select(image.alias("image"))


def picture_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, box_no, x, y, w, h, rx, ry, lx, ly, score): two boxes in every second picture, of which the second is larger; no eyes."""
    d = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("path"), F.explode(F.array(F.lit(1), F.lit(2))).alias("box_no"))
    side = F.col("box_no") * 2
    return d.select("path", "box_no", F.lit(2).alias("x"), F.lit(1).alias("y"), side.alias("w"), side.alias("h"), *(F.lit(None).cast("double").alias(c) for c in ("rx", "ry", "lx", "ly")), (F.col("box_no") / 4).alias("score"))


#: Schema of an evaluation without a field set, as in runs without a model.
EMPTY_EVALUATION = "subject_count int, issues array<string>, face_visible boolean, face_clarity string, training_suitability int, view_angle string, shot_type string"

#: Vectors that stand for a picture: those of the embeddings, and some that are copied nearly; jobs by id.
PICTURE_JOB = "concat('p', CAST(id % 1000000 % 3 AS STRING))"


# --- grids, logs, jobs, answers, boxes, files ------------------------------


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, pixels): 8 x 8 grey values."""
    pixel = lambda x: F.least(F.greatest(F.floor(F.lit(128.0) + 400.0 * x.cast("double")), F.lit(0)), F.lit(255))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("pixels"))


GRIDS_SQL = "SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor(128e0 + 400e0 * CAST(x AS DOUBLE)), 0), 255) AS BIGINT)) AS pixels FROM embeddings"

OVERRIDES_SQL = "SELECT user_id AS doc_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'error' THEN 'reject' END AS decision FROM events WHERE event_type IN ('purchase', 'error', 'view')"


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, ts, event_id, decision): edits of decisions; null clears."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error', 'view')")
    return e.select(F.col("user_id").alias("image_id"), "ts", "event_id", F.expr("CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'error' THEN 'reject' END").alias("decision"))


#: A job for each event, in both engines' SQL.
JOB = {
    "job_id": "event_id",
    "status": "CASE event_type WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'running' ELSE 'review' END",
    "created_at": "ts",
    "total_steps": "event_id % 50",
    "step": "(event_id % 50 - (event_id % 50) % 2) / 2",
    "params": "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '{\"coverage\": {\"min_suitability\": null}, \"target\": 40}' WHEN event_id % 13 = 0 THEN '{\"target\": null, \"coverage\": {\"per_bucket_cap\": 9}, \"unknown\": 1}' WHEN event_id % 17 = 0 THEN '{broken' ELSE concat('{\"coverage\": {\"min_suitability\": ', CAST(event_id % 90 AS STRING), ', \"per_bucket_cap\": 8}', CASE WHEN event_id % 3 = 0 THEN ', \"target\": 25' ELSE '' END, '}') END",
}
JOBS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in JOB.items()) + " FROM events"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in JOB.items()))


#: Params of a job that override keys of every block, in both engines' SQL.
WIDE_PARAMS = (
    "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '{broken' WHEN event_id % 5 = 0 THEN '{\"purpose\": \"pose\", \"quality\": null, \"nope\": 1, \"dedup\": {\"nope\": 2}, \"target\": 30, \"coverage\": {\"per_bucket_cap\": 5}}'"
    " ELSE concat('{\"quantize\": true, \"max_res\": null, \"quality\": {\"min_side_fail\": ', CAST(event_id % 900 AS STRING), ', \"mean_luma_low\": 30.5, \"nope\": 2}, \"dedup\": {\"similarity_threshold\": 0.', CAST(80 + event_id % 20 AS STRING),"
    " ', \"phash_size\": null, \"phash_exact_max_hamming\": 6}, \"coverage\": {\"soft_face_reject\": false, \"soft_face_rel_ratio\": 0.5, \"cap_factor\": 2, \"cap_min\": 3, \"min_style_variety\": ', CAST(event_id % 9 AS STRING), ', \"per_bucket_cap\": 7}}') END"
)
WIDE_JOBS_SQL = f"SELECT event_id AS job_id, {WIDE_PARAMS} AS params FROM events"


def wide_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, params): jobs whose params hold keys of every block."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS job_id", f"{WIDE_PARAMS} AS params")


#: Params of jobs, by job_ref of records; other jobs have none.
JOB_SETTINGS = {
    "en": {"quality": {"min_side_fail": 600, "face_sharpness_warn": 300.0}, "coverage": {"cap_min": 3, "cap_factor": 1.25, "min_suitability": 55, "soft_face_floor": 300.0}, "target": 30},
    "de": {"quality": {"clip_frac_warn": 0.2, "face_area_frac_min": 0.01}, "coverage": {"per_bucket_cap": 4, "soft_face_reject": False}},
    "fr": {"quality": {"mean_luma_low": 60.0, "global_sharpness_fail": 20.0}, "coverage": {"soft_face_rel_ratio": 0.9, "cap_min": 2}},
    "es": {},
}


def job_settings(spark: SparkSession) -> DataFrame:
    """(job_id, params) of the jobs of records; a table of a few rows, one for each job."""
    return spark.createDataFrame([(job, json.dumps(params)) for job, params in JOB_SETTINGS.items() if params], "job_id string, params string")


def _purpose_settings() -> dict[str, dict]:
    """Params of a job for each language and purpose: minimums, totals, caps and targets of their own."""
    out = {}
    for k, (lang, p) in enumerate((lang, p) for lang in ("en", "de", "fr", "es") for p in PURPOSES.values()):
        keys = {"garment_visible": "min_garment_visible_shots"}
        minimums = {keys.get(r.name, f"min_{r.name}"): (2, 9, 40, 4, 0)[(k + j) % 5] for j, r in enumerate(p.requirements)}
        own = {"purpose": p.name, "coverage": {**minimums, "min_total_marginal": (5, 30, 15)[k % 3], "min_total_sufficient": (10, 60, 25)[k % 3], "cap_min": 2 + k % 4}}
        out[f"{lang}:{p.name}"] = own | ({"target": 20 + k} if k % 4 else {}) | ({"quality": {"min_side_fail": 450 + 15 * k}} if k % 2 else {})
    return out


#: Params of jobs of all purposes, by job_ref.
PURPOSE_SETTINGS = _purpose_settings()


def purpose_settings(spark: SparkSession) -> DataFrame:
    """(job_id, params) of the jobs of records_by_purpose; a few rows."""
    return spark.createDataFrame([(job, json.dumps(params)) for job, params in PURPOSE_SETTINGS.items()], "job_id string, params string")


def records_by_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records once for each purpose, in a job for each language and purpose."""
    d = records(spark, sf_dir).withColumn("purpose", F.explode(F.array(*(F.lit(p) for p in PURPOSES))))
    return d.withColumn("job_ref", F.concat("job_ref", F.lit(":"), "purpose"))


#: Params of the jobs that vectors are dealt to, by id; the last has none.
DEDUP_SETTINGS = {"v0": {"similarity_threshold": 0.95, "phash_exact_max_hamming": 2}, "v1": {"similarity_threshold": 0.6, "phash_exact_max_hamming": 9}, "v2": {}}


def dedup_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(job, json.dumps({"dedup": params})) for job, params in DEDUP_SETTINGS.items() if params], "job_id string, params string")


#: An answer for each document and attempt, in both engines' SQL.
_SUIT = "CASE doc_id % 8 WHEN 0 THEN CAST((doc_id * 31) % 130 AS STRING) WHEN 1 THEN concat('\"', CAST((doc_id * 31) % 130 AS STRING), '\"') WHEN 2 THEN '62.5' WHEN 3 THEN '\"good\"' WHEN 4 THEN 'null' WHEN 5 THEN '\"71.5\"' WHEN 6 THEN '-3' ELSE 'true' END"
_FLAG = "CASE (doc_id + {0}) % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '\" Yes \"' WHEN 3 THEN '\"no\"' WHEN 4 THEN '1' WHEN 5 THEN '\"1\"' ELSE 'null' END"
_LIST = "CASE doc_id % 5 WHEN 0 THEN '[\" Blur \", \"\", \"x\"]' WHEN 1 THEN '\"Watermark\"' WHEN 2 THEN '3' WHEN 3 THEN '[]' ELSE 'null' END"
_COUNT = "CASE doc_id % 6 WHEN 0 THEN '2' WHEN 1 THEN '\"3\"' WHEN 2 THEN '2.9' WHEN 3 THEN '\"2.9\"' WHEN 4 THEN 'null' ELSE '1' END"
_OBJECT = (
    "concat('{\"shot_type\": \"', CASE doc_id % 4 WHEN 0 THEN ' Full_Body ' WHEN 1 THEN 'upper_body' WHEN 2 THEN 'nonsense' ELSE 'other' END, '\", \"view_angle\": \"', CASE doc_id % 3 WHEN 0 THEN 'BACK' WHEN 1 THEN 'front' ELSE '?' END, '\"'"
    + "".join(f", ', \"{k}\": ', {_FLAG.format(i)}" for i, k in enumerate(["face_visible", "face_occluded", "body_shape_visible", "full_body_visible", "body_occluded", "pose_clearly_visible", "garment_visible", "garment_occluded", "style_consistent"]))
    + f", ', \"subject_count\": ', {_COUNT}, ', \"issues\": ', {_LIST}, ', \"style_tags\": ', {_LIST}, ', \"training_suitability\": ', {_SUIT}"
    + ", ', \"face_clarity\": \"', CASE doc_id % 4 WHEN 0 THEN 'SHARP ' WHEN 1 THEN 'blurry' ELSE 'fuzzy' END, '\", \"garment_clarity\": \"blurry\", \"pose_category\": \"', CASE doc_id % 3 WHEN 0 THEN 'Sitting' WHEN 1 THEN 'flying' ELSE 'lying' END, '\", \"garment_type\": \"', CASE doc_id % 3 WHEN 0 THEN 'Dress' WHEN 1 THEN 'hat' ELSE 'top' END, '\"'"
    + ", CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN ', \"reason\": null' WHEN 2 THEN concat(', \"reason\": \"', repeat('long ', 70), '\"') WHEN 3 THEN ', \"reason\": {\"a\": 1}' ELSE ', \"reason\": \"  fine  \"' END, '}')"
)
ANSWER = (
    f"CASE WHEN doc_id % 23 = 0 AND attempt = 1 THEN concat('Sure: ', substr({_OBJECT}, 1, 60)) WHEN doc_id % 29 = 0 THEN 'I cannot tell.' WHEN doc_id % 31 = 0 AND attempt = 1 THEN concat('{{not json}} ', {_OBJECT})"
    f" WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN concat('Here it is', chr(10), '```json', chr(10), {_OBJECT}, chr(10), '```', ' bye }} {{') ELSE {_OBJECT} END"
).replace("{{", "{").replace("}}", "}")
ANSWERS_SQL = f"SELECT doc_id, lang AS job_ref, attempt, {ANSWER} AS answer FROM documents, (SELECT 1 AS attempt UNION ALL SELECT 2 UNION ALL SELECT 3) a"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, job_ref, attempt, answer): raw model answers of three attempts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("job_ref"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
    return d.selectExpr("doc_id", "job_ref", "attempt", f"{ANSWER} AS answer")


_FOLDER = "concat('/data/', lang, '/', CASE WHEN doc_id % 53 = 0 THEN '_' ELSE '' END, source, CASE WHEN doc_id % 23 = 0 THEN '_rejected' ELSE '' END)"
#: Height that the image source gives: below 0 where it can't decode, as for all images of one job.
HEIGHT = "CASE WHEN lang = 'es' OR doc_id % 17 = 0 THEN -1 ELSE 400 + (doc_id * 53) % 1200 END"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_ref, image): an image for each document."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("job_ref"), F.struct(F.expr(HEIGHT).alias("height")).alias("image"))


#: Folders as a file system lists them: those of the files, and one without files for each language.
FOLDERS_SQL = f"SELECT DISTINCT {_FOLDER} AS path FROM documents UNION SELECT DISTINCT concat('/data/', lang, '/nothing') FROM documents"


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.expr(_FOLDER).alias("path")).union(d.select(F.concat(F.lit("/data/"), "lang", F.lit("/nothing")))).distinct()


#: Metrics with more places than are stored.
LONG_METRICS = {"global_sharpness": "CAST((doc_id * 71) % 3000 AS DOUBLE) / 70", "face_sharpness": "CAST((doc_id * 97) % 9000 AS DOUBLE) / 70", "face_area_frac": "CAST((doc_id * 13) % 400 AS DOUBLE) / 13000", "face_conf": "CAST(doc_id % 97 AS DOUBLE) / 97", "mean_luma": "CAST((doc_id * 29) % 256 AS DOUBLE) / 7", "clip_frac": "CAST((doc_id * 17) % 100 AS DOUBLE) / 333", "quality_score": "CAST((doc_id * 41) % 1000 AS DOUBLE) / 1003"}


def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", *(f"{e} AS {n}" for n, e in LONG_METRICS.items()))


_SIDE = "(doc_id * box_no * 17) % 90 + 10"
BOX = {"doc_id": "doc_id", "box_no": "box_no", "x": "(doc_id * 3 + box_no) % 50", "y": "(doc_id * 5) % 40", "w": _SIDE, "h": f"CASE WHEN box_no = 2 THEN {_SIDE} ELSE 60 END", "score": "CAST((doc_id * 7 + box_no) % 100 AS DOUBLE) / 100"}
BOXES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in BOX.items()) + " FROM (SELECT doc_id, unnest(range(1, doc_id % 4 + 1)) AS box_no FROM documents) x"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, box_no, x, y, w, h, score): none to three boxes for each document."""
    d = table(spark, sf_dir, "documents").where("doc_id % 4 > 0").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int"))).alias("box_no"))
    return d.selectExpr(*(f"{e} AS {n}" for n, e in BOX.items()))


_STEM = "concat(CASE WHEN doc_id % 19 = 0 THEN '.' ELSE '' END, 'img_', lpad(CAST(doc_id AS STRING), 8, '0'))"
FILE = {
    "doc_id": "doc_id",
    "job_ref": "lang",
    "folder": _FOLDER,
    "filename": f"concat({_STEM}, CASE WHEN n = 2 THEN '.txt' WHEN doc_id % 7 = 0 THEN '.gif' WHEN doc_id % 13 = 0 THEN '.PNG' WHEN doc_id % 5 = 0 THEN '.jpeg' ELSE '.png' END)",
}
FILES_SQL = "SELECT *, concat(folder, '/', filename) AS path FROM (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FILE.items()) + " FROM documents, (SELECT 1 AS n UNION ALL SELECT 2) a WHERE n = 1 OR doc_id % 3 = 0) x"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, job_ref, folder, filename, path): an image file for each document, for some a caption."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).where("n = 1 or doc_id % 3 = 0")
    return d.selectExpr(*(f"{e} AS {n}" for n, e in FILE.items())).withColumn("path", F.concat_ws("/", "folder", "filename"))
