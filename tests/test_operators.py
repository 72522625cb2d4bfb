import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.config import CoverageLimits
from gleanery.operators import coverage as K
from gleanery.operators import evaluations as V
from gleanery.operators import neardup as D
from gleanery.operators import review as A
from gleanery.operators import selection as C
from gleanery.operators.graph import connected_components
from gleanery.plans.lineage import shared_folder
from gleanery.plans.queries import QUERIES
from gleanery.purposes import PURPOSES, purpose

VL = "shot_type string, view_angle string, face_visible boolean, face_clarity string, subject_count int, body_shape_visible boolean, pose_category string, pose_clearly_visible boolean, garment_type string, garment_visible boolean, garment_clarity string, style_tags array<string>, style_consistent boolean, issues array<string>, training_suitability int"
NAMES = [c.split()[0] for c in VL.split(", ")]


def records(spark, rows):
    """rows: dicts; missing fields are null, metrics have harmless defaults."""
    base = {"job_ref": "j", "quality_score": 0.8, "quality_verdict": "pass", "quality_reasons": [], "face_detected": True, "face_sharpness": 600.0, "uniqueness": 0.5, "is_duplicate": False}
    out = []
    for i, r in enumerate(rows):
        x = base | {"filename": f"f{i:03d}"} | {k: v for k, v in r.items() if k not in NAMES}
        out.append((x["job_ref"], x["filename"], x["quality_score"], x["quality_verdict"], x["quality_reasons"], x["face_detected"], x["face_sharpness"], x["uniqueness"], x["is_duplicate"], tuple(r.get(n) for n in NAMES)))
    return spark.createDataFrame(out, f"job_ref string, filename string, quality_score double, quality_verdict string, quality_reasons array<string>, face_detected boolean, face_sharpness double, uniqueness double, is_duplicate boolean, vl struct<{', '.join(c.replace(' ', ':', 1) for c in VL.split(', '))}>")


def test_purposes():
    assert set(PURPOSES) == {"face", "full_body", "pose", "outfit", "style"}
    assert purpose("nothing").name == purpose(None).name == "face"
    assert all(sum(p.weights) == pytest.approx(1) for p in PURPOSES.values())


def test_first_rule_wins(spark):
    df = records(spark, [{"face_clarity": "blurry", "face_sharpness": 10.0}, {"face_sharpness": 10.0}, {}, {}, {}])
    reasons = [r["reject_reason"] for r in C.hard_reject(df).orderBy("filename").collect()]
    assert reasons == ["vl:blurry face", "soft face (sharpness 10 < 270)", None, None, None]


def test_empty_evaluations_use_defaults(spark):
    df = records(spark, [{}] * 20)
    kept = C.survivors(df)
    assert [tuple(r) for r in K.label_counts(kept, "view_angle", "front").collect()] == [("j", "front", 20)]
    assert K.label_map(kept, "shot_type", "other").first()["counts"] == {"other": 20}
    counts = K.requirement_counts(kept).first()
    assert (counts["distinct_views"], counts["front_face"], counts["full_body"]) == (1, 0, 0)
    assert K.sufficiency(df).first()["verdict"] == "marginal"


def test_outfit(spark):
    df = records(spark, [{"garment_type": "dress", "garment_visible": True, "view_angle": "front"}, {"garment_type": "top"}, {"garment_type": "bottom", "garment_visible": False}, {"garment_type": "dress", "garment_clarity": "blurry", "face_sharpness": 1.0}])
    got = {r["filename"]: r for r in C.select_images(df, "outfit").collect()}
    assert got["f000"]["bucket"] == "dress|front" and got["f000"]["auto_decision"] == "keep"
    assert got["f002"]["auto_reason"] == "garment not visible" and got["f003"]["auto_reason"] == "vl:blurry garment"


def test_caps_and_trim_like_the_loop(spark):
    r = random.Random(3)
    rows = [{"job_ref": r.choice("ab"), "view_angle": r.choice(["front", "back", "profile_left"]), "quality_score": r.randint(1, 9) / 10, "training_suitability": 80, "uniqueness": 0.5} for _ in range(120)]
    for target, cap in ((None, None), (10, None), (25, 9), (2, 5), (0, 0)):
        got = {x["filename"]: x["auto_decision"] for x in C.select_images(records(spark, rows), "face", target, CoverageLimits(per_bucket_cap=cap)).collect()}
        want = {}
        for job in "ab":
            mine = [(f"f{i:03d}", x) for i, x in enumerate(rows) if x["job_ref"] == job]
            buckets = {}
            for f, x in mine:
                buckets.setdefault(x["view_angle"], []).append((f, x["quality_score"]))
            sizes = sorted(map(len, buckets.values()))
            c = cap if cap is not None else max(6, -(-target * 3 // (len(buckets) * 2))) if target else max(6, -(-sizes[len(sizes) // 2] * 3 // 2))
            keep = {}
            for members in buckets.values():
                for k, (f, s) in enumerate(sorted(members, key=lambda m: -m[1])):
                    if k < c:
                        keep[f] = (s, k)
            drop = len(keep) - target if target else 0
            for f, (_, k) in sorted(keep.items(), key=lambda m: (m[1][0], m[0])):
                if drop > 0 and k > 0:
                    del keep[f]
                    drop -= 1
            want |= {f: "keep" if f in keep else "reject" for f, _ in mine}
        assert got == want, (target, cap)


def test_summary_columns(spark):
    s = K.run_summary(C.select_images(records(spark, [{"view_angle": "front"}] * 9), "face"))
    assert s.columns == ["job_ref", "n_input", "soft_face_threshold", "n_hard_reject", "n_survivors", "n_overflow_reject", "n_final_keep", "front_face", "profiles", "three_quarter", "full_body", "distinct_views"]
    assert s.first()["n_input"] == 9


def test_answers(spark):
    texts = [("a", "Sure!\n```json\n{\"shot_type\": \"full_body\", \"x\": {\"y\": 1}}\n``` bye }"), ("b", "no object"), ("c", None), ("d", "{broken} {\"shot_type\": \"full_body\"}"), ("e", "{\"reason\": \"a } b\"}"), ("f", "{\"a\": {"), ("g", "} {\"shot_type\": \"other\"}"), ("h", "[1]"), ("i", "")]
    df = spark.createDataFrame(texts, "id string, answer string")
    got = {r["id"]: r["j"] for r in df.select("id", V.json_text(F.col("answer")).alias("j")).collect()}
    assert got == {"a": '{"shot_type": "full_body", "x": {"y": 1}}', "b": None, "c": None, "d": "{broken}", "e": '{"reason": "a }', "f": None, "g": '{"shot_type": "other"}', "h": None, "i": None}
    vl = {r["id"]: r["vl"] for r in df.select("id", V.normalize(V.parsed(F.col("answer"))).alias("vl")).collect()}
    assert vl["a"]["shot_type"] == "full_body" and vl["a"]["training_suitability"] == 50 and vl["d"] is None and vl["e"] is None
    assert list(vl["a"].asDict()) == ["shot_type", "view_angle", "face_visible", "face_occluded", "face_clarity", "subject_count", "body_shape_visible", "issues", "training_suitability", "reason"]


def test_components_of_a_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 161)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    r = random.Random(1)
    r.shuffle(edges)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 100 for i in range(100, 162)} | {i: 500 for i in range(500, 560)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_blocks_find_all_pairs(spark, monkeypatch):
    r = random.Random(5)
    rows = [("ab"[i % 2], i, [r.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    df = spark.createDataFrame(rows, "job_ref string, id long, features array<double>")
    whole = {(x["a"], x["b"]) for x in D.cosine_pairs(df, 0.8).collect()}
    best = {x["id"]: round(x["max_sim"], 9) for x in D.max_similarity(df).collect()}
    monkeypatch.setattr(D, "BLOCK", 7)
    assert {(x["a"], x["b"]) for x in D.cosine_pairs(df, 0.8).collect()} == whole and whole
    assert {x["id"]: round(x["max_sim"], 9) for x in D.max_similarity(df).collect()} == best and len(best) == 80


def test_hamming_bands(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) - 2**63 for _ in range(4)]
    rows = []
    for i in range(120):
        w = list(base) if i % 2 else [r.getrandbits(64) - 2**63 for _ in range(4)]
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            k = r.randrange(256)
            w[k // 64] ^= (1 << (k % 64)) if k % 64 < 63 else -(2**63)
        rows.append(("j", i, w))
    apart = lambda x, y: sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(x, y, strict=True))
    first = {}
    for _, i, w in rows:
        first.setdefault(tuple(w), i)
    want = {(first[tuple(w)], i, 0) for _, i, w in rows if first[tuple(w)] != i}
    reps = [(i, w) for _, i, w in rows if first[tuple(w)] == i]
    want |= {(i, j, apart(v, w)) for i, v in reps for j, w in reps if i < j and apart(v, w) <= 4}
    got = {(x["a"], x["b"], x["distance"]) for x in D.hamming_pairs(spark.createDataFrame(rows, "job_ref string, id long, hash array<long>"), 4).collect()}
    assert got == want and len(want) > 100


def test_manifest_collisions_and_dry_run(spark):
    d = spark.createDataFrame([("/d", "a.png", "a.txt", "reject", None), ("/d", "a.png", None, "reject", None), ("/d", "b.png", None, "reject", "keep"), ("/d", "c.png", None, "keep", "reject")], "folder string, filename string, sidecar string, auto_decision string, user_decision string").withColumn("job_ref", F.lit("j"))
    got = sorted((r["source"], r["collision"], r["applied"]) for r in A.apply_manifest(d, dry_run=True).collect())
    assert got == [("/d/a.png", True, False), ("/d/a.png", True, False), ("/d/a.txt", False, False), ("/d/c.png", False, False)]
    assert {r["target"] for r in A.apply_manifest(d, mode="delete").collect()} == {None}
    assert A.recaption_worklist(d, dry_run=True).count() == 0


def test_pages_and_reasons_of_each_job(spark):
    rows = [(j, i, f"f{i:02d}", "" if i % 3 else "b", "reject" if i % 3 else "keep", "why" if i % 3 else "") for j in "ab" for i in range(12)]
    d = spark.createDataFrame(rows, "job_ref string, doc_id long, filename string, bucket string, auto_decision string, auto_reason string")
    page = [(r["job_ref"], r["filename"], r["section"]) for r in A.review_page(d, 1, 7).collect()]
    want = ["f10", "f11", "f00", "f03", "f06", "f09"][1:]
    assert [(j, f) for j, f, _ in page] == [(j, f) for j in "ab" for f in want] and page[0][2] == "(unbucketed)"
    assert [tuple(r) for r in A.reject_reasons(d, 2).collect()] == [(j, f, "why") for j in "ab" for f in ("f01", "f02")]


@pytest.mark.parametrize("name", ["latest_override", "apply_summary", "review_categories", "final_decision"])
def test_all_jobs_are_reviewed(spark, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {r["job_ref"] for r in got.select("job_ref").collect()} == {"de", "en", "es", "fr"}


def test_all_attempts_are_coerced(spark):
    got = {(r["doc_id"], r["attempt"]) for r in QUERIES["coerce_text"](spark, "/root/testdata/sf0.001").collect()}
    assert {a for _, a in got} == {1, 2, 3} and (23, 1) not in got and {(23, 2), (23, 3)} <= got


def test_params_of_every_block(spark):
    text = '{"quantize": true, "purpose": "pose", "nope": 1, "quality": {"min_side_fail": 256, "nope": 2}, "dedup": {"similarity_threshold": 0.8}, "coverage": {"soft_face_floor": 90, "cap_min": 2, "min_front_face": 9, "min_garment_visible_shots": 1}}'
    a, b = A.job_params(spark.createDataFrame([(1, text), (2, "{}")], "job_id long, params string"), {"cap_min": 4}).orderBy("job_id").collect()
    keys = ("quantize", "purpose", "min_side_fail", "similarity_threshold", "soft_face_floor", "cap_min", "min_front_face", "min_garment_visible_shots", "face_area_frac_min")
    assert [a[k] for k in keys] == [True, "pose", 256, 0.8, 90.0, 2, 9, 1, 0.004]
    assert [b[k] for k in keys] == [False, "face", 512, 0.9, 200.0, 4, 4, 8, 0.004]


def test_params_of_models_and_tools(spark):
    """Every key that a job may set is a column, those of models and tools too."""
    text = '{"device": "cpu", "vl_max_new_tokens": 64, "thumb_size": null, "low_vram": true, "dedup": {"clip_model": "other"}}'
    a, b = A.job_params(spark.createDataFrame([(1, text), (2, None)], "job_id long, params string")).orderBy("job_id").collect()
    keys = ("clip_model", "device", "dtype", "qtype", "low_vram", "vl_max_new_tokens", "thumb_size")
    assert [a[k] for k in keys] == ["other", "cpu", "bf16", "float8", True, 64, 384]
    assert [b[k] for k in keys] == ["openai/clip-vit-base-patch32", "cuda:0", "bf16", "float8", False, 512, 384]
    assert {"model_name_or_path", "quantize", "max_res", "purpose", "face_detect_conf", "use_clip_embeddings"} <= set(a.asDict())


def test_hyperplanes_find_near_pairs(spark):
    """Recall of 0.9 at least on pairs of cosine 0.9 and little more, within jobs only; copies are paired with the first."""
    r = np.random.default_rng(4)
    rows, near = [], set()
    for i in range(0, 400, 2):
        v = r.normal(size=96)
        v /= np.linalg.norm(v)
        side = r.normal(size=96)
        side -= (side @ v) * v
        w = v + side / np.linalg.norm(side) * np.tan(np.arccos(0.9 + 0.02 * r.random()))
        rows += [("ab"[i % 4 // 2], i, v.tolist()), ("ab"[i % 4 // 2], i + 1, w.tolist())]
        near.add((i, i + 1))
    rows += [("a", 900, rows[0][2]), ("b", 901, rows[0][2]), ("a", 902, [0.0] * 96), ("a", 903, [0.0] * 96)]
    df = spark.createDataFrame(rows, "job_ref string, id long, features array<double>")
    exact = {(x["a"], x["b"]) for x in D.cosine_pairs(df).collect()}
    found = {(x["a"], x["b"]): x["sim"] for x in D.lsh_pairs(df).collect()}
    assert near <= exact and set(found) <= exact and (0, 900) in found and (0, 901) not in found
    assert len(near & set(found)) >= 0.9 * len(near)
    assert D.similar(df.limit(0))[0].count() == 0


def test_one_extraction_in_a_plan(spark):
    df = spark.createDataFrame([("{}",)], "answer string")
    vl = df.select(V.there(V.normalize(V.parsed(F.col("answer")))).alias("vl")).select("vl.*")
    assert vl._jdf.queryExecution().optimizedPlan().toString().count("```(?:json)?") == 1


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://there:7077", "x"

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_medians_of_ranges_like_a_sort(spark):
    """Upper medians of jobs of one to many values, with ties, values that don't count, and jobs without any."""
    r = random.Random(9)
    kinds = [lambda: r.random() * 900, lambda: 5.0, lambda: r.choice([1e-300, 1e300, 2.5]), lambda: 100 + r.random() * 1e-9, lambda: r.choice([0.0, -4.0, None, 7.0]), lambda: None]
    rows = [(f"{k}/{n}", kind()) for k, kind in enumerate(kinds) for n in (1, 2, 3, 10, 501) for _ in range(n)]
    df = spark.createDataFrame(rows, "job_ref string, x double").repartition(6)
    got = {x["job_ref"]: (x["m"], x["n"]) for x in C.upper_medians(df, "x", {"n": F.lit(3)}).collect()}
    want = {}
    for job in {x[0] for x in rows}:
        own = sorted(x for j, x in rows if j == job and x is not None and x > 0)
        want[job] = (own[len(own) // 2] if own else None, 3)
    assert got == want


def test_trim_ends_inside_a_slice_of_equal_scores(spark):
    """All scores are equal: the trim goes by file, and a bucket's first stays, whatever the slice."""
    rows = [{"view_angle": ["front", "back"][i % 2], "training_suitability": 80} for i in range(30)]
    got = C.select_images(records(spark, rows), "face", 9, CoverageLimits(per_bucket_cap=12))
    trimmed = sorted(x["filename"] for x in got.where("auto_reason like 'target trim%'").collect())
    # of 24 that caps leave, 15 go, in order of files; f000 and f001 are first in their buckets
    assert trimmed == [f"f{i:03d}" for i in range(2, 17)]
    assert got.where("auto_decision = 'keep'").count() == 9


def test_purposes_by_column(spark):
    """Jobs of different purposes in one run have the decisions, counts, gaps and verdicts of runs of their own."""
    r = random.Random(4)
    rows = []
    for p in (*PURPOSES, "nothing"):
        rows += [{"job_ref": p, "view_angle": r.choice(["front", "back"]), "shot_type": "full_body", "garment_type": r.choice(["top", "dress"]), "garment_visible": r.random() < 0.8, "garment_clarity": r.choice(["sharp", "blurry"]), "face_clarity": r.choice(["sharp", "blurry"]), "quality_score": r.random(), "training_suitability": r.randint(30, 99)} for _ in range(40)]
    df = records(spark, rows).withColumn("p", F.when(F.col("job_ref") != "nothing", F.col("job_ref"))).cache()
    tidy = lambda d: sorted(map(tuple, d.collect()), key=repr)
    own = F.col("p")
    for of in (
        lambda d, p: C.select_images(d, p, 12).select("job_ref", "filename", "bucket", "auto_decision", "auto_reason"),
        lambda d, p: K.sufficiency(d, p),
        lambda d, p: K.coverage_gaps(K.requirement_counts(C.survivors(d, p), p), p),
    ):
        apart = [x for job in (*PURPOSES, "nothing") for x in tidy(of(df.where(F.col("job_ref") == job), job))]
        assert tidy(of(df, own)) == sorted(apart, key=repr)
