"""Registered queries of the selection engine, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CoverageLimits, QualityLimits
from ..operators import coverage as K
from ..operators import evaluations as V
from ..operators import measure as M
from ..operators import neardup as D
from ..operators import quality as Q
from ..operators import review as A
from ..operators import selection as C
from ..purposes import PURPOSES
from ..sources import images as S
from . import fixtures as X
from .lineage import Scratch

#: Images that a run is to keep, in the queries with a target.
TARGET = 60

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def six(x):
    """To six places, halves to even."""
    return F.rint(x * 1e6) / 1e6


def query(name: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        return f

    return add


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality_gate(X.records(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, purpose: str = "face") -> DataFrame:
    return Q.quality_score(gated(spark, sf_dir), purpose)


def selected(spark: SparkSession, sf_dir: str, purpose: str = "face") -> DataFrame:
    return C.select_images(scored(spark, sf_dir, purpose), purpose, TARGET)


def kept(spark: SparkSession, sf_dir: str, purpose: str = "face") -> DataFrame:
    return C.survivors(scored(spark, sf_dir, purpose), purpose)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected rows of all jobs with the overrides of the log; entries for images that no job has stay in it."""
    d = selected(spark, sf_dir).withColumn("image_id", F.col("doc_id"))
    jobs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.col("lang").alias("job_ref"))
    log = X.overrides(spark, sf_dir).join(jobs, "image_id", "left").fillna("none", ["job_ref"])
    return A.latest_override(d, log)


# --- sources ---------------------------------------------------------------


@query("image_id")
def _(spark, sf_dir):
    return X.files(spark, sf_dir).select("path", S.image_id(F.col("job_ref"), F.col("path")).alias("image_id"))


@query("image_scan_filter")
def _(spark, sf_dir):
    f = X.files(spark, sf_dir)
    return f.where(S.is_image(F.col("filename")) & ~F.col("filename").startswith(".")).select("path", "filename")


@query("sidecar_join")
def _(spark, sf_dir):
    f = X.files(spark, sf_dir)
    return A.sidecar_join(f.where(S.is_image(F.col("filename"))).select("folder", "filename"), f.select("folder", "filename"))


@query("dataset_catalog")
def _(spark, sf_dir):
    return S.dataset_catalog(X.files(spark, sf_dir))


@query("dataset_catalog_folders")
def _(spark, sf_dir):
    """The catalogue with folders that hold no file."""
    return S.dataset_catalog(X.files(spark, sf_dir), X.folders(spark, sf_dir))


@query("read_report")
def _(spark, sf_dir):
    return S.read_report(X.images(spark, sf_dir))


@query("results_read")
def _(spark, sf_dir):
    broken = "CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 4) ELSE props END"
    reasons = "CASE WHEN event_id % 5 = 0 THEN '[oops' ELSE concat('[\"', event_type, '\", \"r\"]') END"
    rows = X.table(spark, sf_dir, "events").selectExpr("event_type AS job_ref", "concat('img_', lpad(CAST(event_id AS STRING), 8, '0')) AS filename", f"{broken} AS vl", f"{reasons} AS reasons")
    return S.read_results(rows, "view").select("filename", F.variant_get("vl", "$.k", "bigint").alias("k"), F.size("reasons").cast("long").alias("n_reasons"))


@query("results_upsert")
def _(spark, sf_dir):
    """A table of results after a second run of some jobs: their rows are replaced, of one id the latest stays, other jobs keep theirs."""
    d = X.table(spark, sf_dir, "documents").select(F.col("lang").alias("job_ref"), F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("image_id"), F.col("n_chars").cast("long").alias("value"), F.lit(1).alias("updated_at"))
    again = d.where("job_ref in ('de', 'fr')")
    second = again.where("value % 2 = 0").withColumn("updated_at", F.lit(2)).union(again.where("value % 6 = 0").withColumns({"value": F.col("value") + 1, "updated_at": F.lit(3)}))
    path = Scratch(spark).path()
    S.write_results(d, path)
    S.write_results(second, path)
    return spark.read.schema(d.schema).parquet(path).select("job_ref", "image_id", "value", F.col("updated_at").cast("long").alias("updated_at"))


@query("report_records")
def _(spark, sf_dir):
    """Records of a run as the report has them: written as JSON lines and read again."""
    d = selected(spark, sf_dir).select("doc_id", "job_ref", "bucket", "auto_decision", "auto_reason", six(F.col("combined_score")).alias("combined_score"))
    path = Scratch(spark).path()
    S.write_report(K.run_summary(selected(spark, sf_dir)), d, path)
    return spark.read.schema(d.schema).json(f"{path}/records")


@query("report_summary")
def _(spark, sf_dir):
    """The summary of a run, written as JSON lines and read again."""
    d = K.run_summary(selected(spark, sf_dir))
    path = Scratch(spark).path()
    S.write_report(d, d.select("job_ref"), path)
    return spark.read.schema(d.schema).json(f"{path}/summary")


@query("quarantine_split")
def _(spark, sf_dir):
    """Kept and rejected rows as two partitions, read again."""
    d = selected(spark, sf_dir).select("doc_id", "job_ref", F.col("auto_decision").alias("decision"))
    path = Scratch(spark).path()
    S.write_split(d, path)
    return spark.read.schema(d.schema).parquet(path)


@query("job_cascade_delete")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_ref"), "event_id")
    deleted = X.table(spark, sf_dir, "events").where("event_type = 'error' and user_id % 3 = 0").select(F.col("user_id").alias("job_ref"))
    return S.delete_jobs(rows, deleted)


# --- measurement -----------------------------------------------------------


@query("exposure")
def _(spark, sf_dir):
    mean, clipped = M.grid_exposure(F.col("pixels"))
    return X.grids(spark, sf_dir).select("vec_id", mean.alias("mean_luma"), clipped.alias("clip_frac"))


@query("laplacian_var")
def _(spark, sf_dir):
    return X.grids(spark, sf_dir).select("vec_id", M.grid_laplacian_variance(F.col("pixels"), 8).alias("sharpness"))


@query("global_sharpness")
def _(spark, sf_dir):
    half = X.grids(spark, sf_dir).select("vec_id", M.grid_halved(F.col("pixels"), 8).alias("pixels"))
    return half.select("vec_id", M.grid_laplacian_variance(F.col("pixels"), 4, 4).alias("sharpness"))


_MEASURES = ("path", "width", "height", "global_sharpness", "mean_luma", "clip_frac", "face_detected", "face_area_frac", "face_conf", "face_sharpness")


@query("measured_pictures")
def _(spark, sf_dir):
    """The whole pixel pass over pictures with faces: exposure, sharpness, face area and sharpness of the crop."""
    d = M.measure_images(X.pictures(spark, sf_dir), X.picture_faces(spark, sf_dir)).select(*_MEASURES)
    return d.withColumns({c: six(F.col(c)) for c in ("global_sharpness", "face_sharpness")})


@query("measured_pictures_shrunk")
def _(spark, sf_dir):
    """The same at a processing size of half the side: metrics are of the copy, width and height of the picture itself."""
    return M.measure_images(X.pictures(spark, sf_dir), None, QualityLimits(processing_long_side=4)).select("path", "width", "height", six(F.col("global_sharpness")).alias("global_sharpness"), "mean_luma", "clip_frac")


@query("perceptual_vector")
def _(spark, sf_dir):
    """Of the perceptual vector of each picture: structure at the middle of the grid's cells, the size of the hash's share, and colour by value."""
    d = M.measure_images(X.pictures(spark, sf_dir)).select("path", F.col("perceptual").alias("v"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.get("v", ((F.floor(k / 8) * 3 + 1) * 24 + (k % 8) * 3 + 1).cast("int")))
    colour = F.slice("v", 576 + 256 + 1, 4)
    share = F.abs(F.get("v", 576))
    return d.select("path", F.posexplode(F.concat(cells, F.array(share), colour)).alias("k", "x")).select("path", "k", F.col("x").cast("double").alias("x"))


def _picture_rows(spark, sf_dir):
    """(job_ref, id, filename, features, image): pictures with a vector, some of them nearly copied."""
    v = X.vectors(spark, sf_dir).select("id", "filename", "features").withColumn("job_ref", F.expr(X.PICTURE_JOB))
    images = X.pictures(spark, sf_dir).select(F.regexp_extract("image.origin", r"(\d+)$", 1).cast("long").alias("vec_id"), "image")
    joined = v.withColumn("vec_id", F.col("id") % 1000000).join(images, "vec_id")
    # each picture has its own path, as files have
    return joined.withColumn("image", F.col("image").withField("origin", F.concat(F.lit("vec_"), F.col("id").cast("string")))).drop("vec_id")


#: Limits for pictures of 8 x 8.
_TINY = QualityLimits(min_side_fail=4, min_side_warn=8, global_sharpness_fail=2000.0, global_sharpness_warn=4000.0, luma_low=118.0, luma_high=139.0, clip_warn=0.01)


@query("pictures_to_selection")
def _(spark, sf_dir):
    """A run from pixels to decisions: measured, gated and scored, near-duplicates by vectors and their clusters, uniqueness, rules, caps and target."""
    rows = _picture_rows(spark, sf_dir)
    faces = X.picture_faces(spark, sf_dir)
    metrics = M.measure_images(rows.select("image"), faces).drop("perceptual", "hash")
    d = rows.select("job_ref", "id", "filename", "features", F.col("image.origin").alias("path")).join(metrics, "path")
    d = Q.quality_score(Q.quality_gate(d, _TINY), "face", _TINY)
    pairs, best = D.similar(d.select("job_ref", "id", "features"))
    clustered = D.cluster_ids(d.drop("features"), D.near_dup_components(pairs.select("job_ref", "a", "b")))
    flagged = D.duplicate_flags(clustered).join(D.uniqueness(best), ["job_ref", "id"])
    got = C.select_images(flagged.withColumn("vl", F.from_json(F.lit("{}"), X.EMPTY_EVALUATION)), "face", 40)
    return got.select("job_ref", "id", "cluster_id", "uniqueness", "quality_verdict", six(F.col("combined_score")).alias("combined_score"), "auto_decision", "auto_reason")


@query("phash_bits")
def _(spark, sf_dir):
    return M.grid_hash_bits(X.grids(spark, sf_dir)).select("vec_id", "hash_bits")


@query("largest_face")
def _(spark, sf_dir):
    return M.largest_face(X.detections(spark, sf_dir), ["doc_id"]).select("doc_id", "box_no", "x", "y", "w", "h", "score")


@query("face_area")
def _(spark, sf_dir):
    faces = M.largest_face(X.detections(spark, sf_dir), ["doc_id"]).drop("x", "y")
    d = X.records(spark, sf_dir).select("doc_id", "width", "height").join(faces, "doc_id", "left")
    return d.select("doc_id", F.coalesce(M.face_area(F.col("w"), F.col("h"), F.col("width"), F.col("height")), F.lit(0.0)).alias("face_area_frac"), F.col("w").isNotNull().alias("face_detected"))


@query("eye_band_box")
def _(spark, sf_dir):
    d = X.detections(spark, sf_dir)
    eyes = [F.col("x").cast("double"), F.col("y").cast("double"), (F.col("x") + F.col("w") / 4).cast("double"), (F.col("y") + F.col("box_no")).cast("double")]
    box = M.eye_band_box(*eyes, F.lit(64), F.lit(48))
    return d.select("doc_id", "box_no", box.alias("b")).select("doc_id", "box_no", "b.*")


@query("face_sharpness_choice")
def _(spark, sf_dir):
    r = X.records(spark, sf_dir)
    eye = F.when(F.col("face_detected") & (F.col("doc_id") % 3 > 0), F.col("face_sharpness"))
    crop = F.when(F.col("face_detected"), F.col("global_sharpness"))
    return r.select("doc_id", M.face_sharpness_choice(eye, crop).alias("face_sharpness"))


# --- quality ---------------------------------------------------------------


@query("quality_verdict")
def _(spark, sf_dir):
    return gated(spark, sf_dir).select("doc_id", "quality_verdict")


@query("quality_reasons")
def _(spark, sf_dir):
    return gated(spark, sf_dir).select("doc_id", F.array_join("quality_reasons", "; ").alias("quality_reasons"))


@query("quality_score")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", six(F.col("quality_score")).alias("quality_score"))


@query("rounded_metrics")
def _(spark, sf_dir):
    return Q.rounded_metrics(X.long_metrics(spark, sf_dir))


@query("quality_score_by_purpose")
def _(spark, sf_dir):
    each = X.records(spark, sf_dir).withColumn("purpose", F.explode(F.array(*(F.lit(p) for p in PURPOSES))))
    return Q.quality_score_by_purpose(each).select("doc_id", "purpose", six(F.col("quality_score")).alias("quality_score"))


# --- evaluations -----------------------------------------------------------


@query("json_extract")
def _(spark, sf_dir):
    return X.answers(spark, sf_dir).select("doc_id", "attempt", V.json_text(F.col("answer")).alias("object"))


def _answered(name: str, build):
    """Registers a query over all attempts, with the attempt as a key."""

    @query(name)
    def _(spark, sf_dir):
        return build(X.answers(spark, sf_dir), "doc_id", "attempt")


def _coerced(name: str, build):
    def coerced(answers, *keys):
        v = answers.select(*keys, V.there(V.parsed(F.col("answer"))).alias("v"))
        return v.select(*keys, *(c.alias(n) for n, c in build(lambda key: V.Field(F.col("v"), key)).items()))

    _answered(name, coerced)


_coerced("coerce_bool", lambda f: {"face_visible": V.as_bool(f("face_visible"), True), "face_occluded": V.as_bool(f("face_occluded"), False)})
_coerced("coerce_enum", lambda f: {"shot_type": V.as_label(f("shot_type"), V.SHOT_TYPES, "other"), "face_clarity": V.as_label(f("face_clarity"), V.CLARITIES, "slightly_soft")})
_coerced("coerce_int", lambda f: {"training_suitability": V.as_suitability(f("training_suitability")).cast("long"), "subject_count": V.as_count(f("subject_count"))})
_coerced("coerce_list", lambda f: {"issues": F.array_join(V.as_list(f("issues")), ",")})
_coerced("coerce_text", lambda f: {"reason": V.as_text(f("reason"))})


def _normalized(purpose: str):
    def normalized(answers, *keys):
        vl = answers.select(*keys, V.there(V.normalize(V.parsed(F.col("answer")), purpose)).alias("vl"))
        flat = []
        for name, _part in V.SCHEMAS[purpose]:
            c = F.col("vl")[name]
            flat.append((F.array_join(c, ",") if name in ("issues", "style_tags") else c.cast("long") if name == "training_suitability" else c).alias(name))
        return vl.select(*keys, *flat)

    _answered(f"normalize_{purpose}", normalized)


for _p in PURPOSES:
    _normalized(_p)


@query("attempt_resolve")
def _(spark, sf_dir):
    images = X.table(spark, sf_dir, "documents").select(F.col("lang").alias("job_ref"), F.col("doc_id").alias("image_id"))
    got = V.attempt_resolve(images, X.answers(spark, sf_dir).withColumnRenamed("doc_id", "image_id"))
    return got.select("image_id", "job_ref", "parse_failed", F.col("vl.view_angle").alias("view_angle"), F.col("vl.subject_count").alias("subject_count"), F.col("vl.reason").alias("reason"))


# --- near-duplicates -------------------------------------------------------


def _cosine(spark, sf_dir):
    return D.cosine_pairs(X.vectors(spark, sf_dir))


def _hashes(spark, sf_dir):
    return X.vectors(spark, sf_dir).select("job_ref", "id", X.sign_words(F.col("features")).alias("hash"))


def _hamming(spark, sf_dir):
    return D.hamming_pairs(_hashes(spark, sf_dir))


def _members(spark, sf_dir):
    return D.near_dup_components(D.near_dup_edges(D.cosine_links(X.vectors(spark, sf_dir)), _hamming(spark, sf_dir)))


def _clustered(spark, sf_dir):
    return D.cluster_ids(X.vectors(spark, sf_dir).drop("features"), _members(spark, sf_dir))


@query("vector_choice")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("job"), (F.col("label") % 3).cast("string")).alias("job_ref"), "vec_id", F.when(~((F.col("label") % 3 == 1) & (F.col("vec_id") % 10 == 0)), F.col("embedding")).alias("embedding"), F.array(F.lit(1.0)).cast("array<float>").alias("perceptual"))
    return D.vector_choice(e).select("job_ref", "vec_id", F.size("features").cast("long").alias("dims"))


@query("cosine_pairs")
def _(spark, sf_dir):
    return _cosine(spark, sf_dir).select("a", "b", six(F.col("sim")).alias("sim"))


@query("cosine_pairs_lsh")
def _(spark, sf_dir):
    return D.lsh_pairs(X.vectors(spark, sf_dir)).select("a", "b", six(F.col("sim")).alias("sim"))


@query("cosine_lsh_recall")
def _(spark, sf_dir):
    """How many pairs there are, and whether lsh_pairs finds nine tenths of them at least, counted with all copies (each that it finds is near, as its cosine is computed)."""
    v = X.vectors(spark, sf_dir)
    exact = D.cosine_pairs(v).agg(F.count("*").alias("n_pairs"))
    found = D.link_counts(v, D.lsh_pairs(v)).agg(F.coalesce(F.sum("n_near"), F.lit(0)).alias("n"))
    return exact.crossJoin(found).select("n_pairs", (F.col("n") / 2 >= 0.9 * F.col("n_pairs")).alias("enough"))


@query("similar_uniqueness")
def _(spark, sf_dir):
    """Uniqueness, and the number of all near vectors, from one comparison."""
    v = X.vectors(spark, sf_dir)
    pairs, best = D.similar(v)
    partners = D.link_counts(v, pairs).select("id", "n_near")
    return D.uniqueness(best).join(partners, "id", "left").select("id", "uniqueness", F.coalesce("n_near", F.lit(0)).alias("n_near"))


@query("max_similarity_pruned")
def _(spark, sf_dir):
    """The maxima of the search that prunes blocks, at any size of the job."""
    return D.similar(X.vectors(spark, sf_dir), plain=0)[1].select("id", six(F.col("max_sim")).alias("max_sim"))


@query("hamming_pairs")
def _(spark, sf_dir):
    return _hamming(spark, sf_dir).select("a", "b", "distance")


@query("dedup_by_job")
def _(spark, sf_dir):
    """Near-duplicate edges of jobs with thresholds and distances of their own, from their params."""
    v = X.vectors(spark, sf_dir).withColumn("job_ref", F.concat(F.lit("v"), (F.col("id") % 1000000 % 3).cast("string")))
    rows = A.with_limits(v, A.job_params(X.dedup_settings(spark)))
    near = D.similar(rows, F.col("limit_similarity_threshold"))[0].select("job_ref", "a", "b")
    hashes = rows.select("job_ref", "id", X.sign_words(F.col("features")).alias("hash"), "limit_phash_exact_max_hamming")
    alike = D.hamming_pairs(hashes, 1, F.col("limit_phash_exact_max_hamming"))
    return D.near_dup_components(D.near_dup_edges(near, alike)).select("job_ref", "id", "component")


@query("near_dup_edges")
def _(spark, sf_dir):
    return D.near_dup_edges(_cosine(spark, sf_dir), D.hamming_edges(_hashes(spark, sf_dir))).select("a", "b")


@query("near_dup_components")
def _(spark, sf_dir):
    return _members(spark, sf_dir).select("id", "component")


@query("cluster_ids")
def _(spark, sf_dir):
    return _clustered(spark, sf_dir).select("id", F.col("cluster_id").cast("long").alias("cluster_id"))


@query("cluster_representative")
def _(spark, sf_dir):
    return D.cluster_representatives(_clustered(spark, sf_dir)).select(F.col("cluster_id").cast("long").alias("cluster_id"), "id")


@query("duplicate_flags")
def _(spark, sf_dir):
    return D.duplicate_flags(_clustered(spark, sf_dir)).select("id", "is_duplicate")


@query("max_similarity")
def _(spark, sf_dir):
    return D.max_similarity(X.vectors(spark, sf_dir)).select("id", six(F.col("max_sim")).alias("max_sim"))


@query("uniqueness")
def _(spark, sf_dir):
    return D.uniqueness(D.max_similarity(X.vectors(spark, sf_dir))).select("id", "uniqueness")


# --- selection -------------------------------------------------------------


@query("soft_face_threshold")
def _(spark, sf_dir):
    return C.soft_face_threshold(X.records(spark, sf_dir)).select("job_ref", six(F.col("soft_face_threshold")).alias("soft_face_threshold"))


RULE_QUERIES = {
    "rule_quality_fail": C.rule_quality_fail,
    "rule_duplicate": C.rule_duplicate,
    "rule_multiple_subjects": C.rule_multiple_subjects,
    "rule_face_blurry": C.rule_face_blurry,
    "rule_soft_face": C.rule_soft_face,
    "rule_body_not_visible": C.RULES["body_not_visible"],
    "rule_pose_not_visible": C.RULES["pose_not_visible"],
    "rule_garment_not_visible": C.RULES["garment_not_visible"],
    "rule_garment_blurry": C.rule_garment_blurry,
    "rule_low_suitability": C.rule_low_suitability,
}


def _rule(name: str, rule):
    @query(name)
    def _(spark, sf_dir):
        return C.with_threshold(gated(spark, sf_dir)).select("doc_id", rule().alias("reason")).where("reason is not null")


for _name, _r in RULE_QUERIES.items():
    _rule(_name, _r)


def _by_purpose(p: str):
    @query(f"hard_reject_{p}")
    def _(spark, sf_dir):
        return C.hard_reject(gated(spark, sf_dir), p).select("doc_id", "reject_reason")

    @query(f"bucket_key_{p}")
    def _(spark, sf_dir):
        return X.records(spark, sf_dir).select("doc_id", PURPOSES[p].bucket().alias("bucket"))

    @query(f"select_{p}")
    def _(spark, sf_dir):
        return selected(spark, sf_dir, p).select("doc_id", "job_ref", "filename", "bucket", six(F.col("combined_score")).alias("combined_score"), "auto_decision", "auto_reason")

    @query(f"requirement_counts_{p}")
    def _(spark, sf_dir):
        return K.requirement_counts(kept(spark, sf_dir, p), p)

    @query(f"coverage_gaps_{p}")
    def _(spark, sf_dir):
        return K.coverage_gaps(K.requirement_counts(kept(spark, sf_dir, p), p), p).select("job_ref", "place", "requirement", "count", "minimum", "text")


    @query(f"coverage_gaps_small_jobs_{p}")
    def _(spark, sf_dir):
        rows = C.survivors(Q.quality_score(Q.quality_gate(X.records(spark, sf_dir, X.SMALL_JOB)), p), p)
        return K.coverage_gaps(K.requirement_counts(rows, p), p).select("job_ref", "place", "requirement", "count", "minimum", "text")


for _p in PURPOSES:
    _by_purpose(_p)


@query("combined_score")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", six(C.combined_score()).alias("combined_score"))


@query("bucket_cap")
def _(spark, sf_dir):
    k = kept(spark, sf_dir)
    explicit = C.bucket_caps(k, None, CoverageLimits(per_bucket_cap=5)).withColumn("mode", F.lit("explicit"))
    target = C.bucket_caps(k, 200).withColumn("mode", F.lit("target"))
    median = C.bucket_caps(k).withColumn("mode", F.lit("median"))
    return explicit.union(target).union(median)


@query("bucket_cap_select")
def _(spark, sf_dir):
    s = C.select_images(scored(spark, sf_dir), "face", None, CoverageLimits(per_bucket_cap=4))
    return s.where("bucket != ''").select("doc_id", "bucket", "auto_decision", "auto_reason")


@query("target_trim")
def _(spark, sf_dir):
    s = C.select_images(scored(spark, sf_dir), "face", 20)
    return s.where("auto_reason like 'target trim%'").select("doc_id", "bucket", "auto_reason")


@query("select_by_job")
def _(spark, sf_dir):
    """Jobs of different settings in one run: every limit and the target are those of the row's job."""
    rows = A.with_limits(X.records(spark, sf_dir), A.job_params(X.job_settings(spark)))
    q, c = A.limits_of(QualityLimits()), A.limits_of(CoverageLimits())
    got = C.select_images(Q.quality_score(Q.quality_gate(rows, q), "face", q), "face", F.col("limit_target"), c)
    return got.select("doc_id", "job_ref", "bucket", "quality_verdict", six(F.col("combined_score")).alias("combined_score"), "auto_decision", "auto_reason")


def _of_all_purposes(spark, sf_dir):
    """Scored rows of jobs of all purposes, each with its own params, and the coverage limits as columns."""
    rows = A.with_limits(X.records_by_purpose(spark, sf_dir).drop("purpose"), A.job_params(X.purpose_settings(spark)))
    q, own = A.limits_of(QualityLimits()), F.col("limit_purpose")
    return Q.quality_score(Q.quality_gate(rows, q), own, q), own, A.limits_of(CoverageLimits())


@query("select_by_purpose")
def _(spark, sf_dir):
    """Jobs of five purposes in one run, with one set of limits: the union of the five selections."""
    own = F.col("purpose")
    got = C.select_images(Q.quality_score(Q.quality_gate(X.records_by_purpose(spark, sf_dir)), own), own, TARGET)
    return got.select("doc_id", "job_ref", "filename", "bucket", six(F.col("combined_score")).alias("combined_score"), "auto_decision", "auto_reason")


@query("select_by_purpose_and_job")
def _(spark, sf_dir):
    """Jobs of five purposes, each with limits and a target of its own."""
    rows, own, c = _of_all_purposes(spark, sf_dir)
    got = C.select_images(rows, own, F.col("limit_target"), c)
    return got.select("doc_id", "job_ref", "bucket", six(F.col("combined_score")).alias("combined_score"), "auto_decision", "auto_reason")


# --- coverage --------------------------------------------------------------


@query("sufficiency_by_job")
def _(spark, sf_dir):
    rows, own, c = _of_all_purposes(spark, sf_dir)
    return K.sufficiency(rows, own, c)


@query("coverage_gaps_by_job")
def _(spark, sf_dir):
    rows, own, c = _of_all_purposes(spark, sf_dir)
    gaps = K.coverage_gaps(K.requirement_counts(C.survivors(rows, own, c), own, c), own, c)
    return gaps.select("job_ref", "place", "requirement", "count", "minimum", "text")


@query("coverage_display")
def _(spark, sf_dir):
    return K.coverage_display(K.requirement_counts(kept(spark, sf_dir)))


@query("sufficiency")
def _(spark, sf_dir):
    return K.sufficiency(scored(spark, sf_dir))


@query("view_counts")
def _(spark, sf_dir):
    return K.label_counts(kept(spark, sf_dir), "view_angle", "front")


@query("shot_counts")
def _(spark, sf_dir):
    return K.label_counts(kept(spark, sf_dir), "shot_type", "other")


@query("coverage_table")
def _(spark, sf_dir):
    return K.coverage_table(selected(spark, sf_dir))


@query("run_summary")
def _(spark, sf_dir):
    return K.run_summary(selected(spark, sf_dir))


# --- review ----------------------------------------------------------------


def _reviewed(name: str, build):
    """Registers a query over all jobs, with job_ref as a key."""

    @query(name)
    def _(spark, sf_dir):
        return build(decided(spark, sf_dir), spark, sf_dir)


def _manifest(d, spark, sf_dir):
    f = X.files(spark, sf_dir)
    images = A.sidecar_join(f.where(S.is_image(F.col("filename"))).select("doc_id", "folder", "filename"), f.select("folder", "filename"))
    return A.apply_manifest(images.join(d.select("doc_id", "auto_decision", "user_decision"), "doc_id"))


_reviewed("latest_override", lambda d, *_: d.select("job_ref", "doc_id", "user_decision"))
_reviewed("final_decision", lambda d, *_: d.select("job_ref", "doc_id", A.final_decision().alias("decision")))
_reviewed("apply_manifest", _manifest)
_reviewed("recaption_worklist", lambda d, *_: A.recaption_worklist(d).select("job_ref", "doc_id", "filename"))
_reviewed("apply_summary", lambda d, *_: A.apply_summary(d))
_reviewed("review_categories", lambda d, *_: A.review_categories(d))
_reviewed("review_page", lambda d, *_: A.review_page(d, 1).select("job_ref", "doc_id", "bucket", "filename", "section"))
_reviewed("gallery_order", lambda d, *_: A.gallery_order(d).select("job_ref", "doc_id", "bucket", "auto_decision", "filename"))
_reviewed("reject_reasons", lambda d, *_: A.reject_reasons(d))


@query("decision_counts")
def _(spark, sf_dir):
    return A.decision_counts(selected(spark, sf_dir))


@query("jobs_by_status")
def _(spark, sf_dir):
    return A.jobs_by_status(X.jobs(spark, sf_dir))


@query("recent_jobs")
def _(spark, sf_dir):
    return A.recent_jobs(X.jobs(spark, sf_dir)).select("job_id", "status", "progress", "active")


@query("job_params")
def _(spark, sf_dir):
    got = A.job_params(X.jobs(spark, sf_dir))
    return got.select("job_id", *(F.col(c).cast("long").alias(c) for c in ("min_suitability", "per_bucket_cap", "target")))


@query("job_params_all_keys")
def _(spark, sf_dir):
    return A.job_params(X.wide_jobs(spark, sf_dir))
