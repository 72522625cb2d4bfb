import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import measure as M
from gleanery.sources import images as S


def png(path, rgb):
    """Writes 8-bit pixels (height, width, 3) as a PNG."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pictures")
    r = np.random.default_rng(1)
    base = np.kron(r.integers(0, 255, (12, 16, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    png(d / "a.png", base)
    png(d / "B.PNG", np.clip(base.astype(int) + 6, 0, 255).astype(np.uint8))
    png(d / "other.png", r.integers(0, 255, (60, 2000, 3)).astype(np.uint8))
    (d / "broken.png").write_bytes(b"no image")
    (d / "a.txt").write_text("caption")
    (d / ".hidden.png").write_bytes(b"x")
    (d / "below").mkdir()
    png(d / "below" / "c.png", base)
    return d


def test_scan(spark, folder):
    assert {r["filename"] for r in S.scan_images(spark, str(folder)).collect()} == {"a.png", "B.PNG", "other.png", "broken.png"}


def test_measure_and_unreadable_rows(spark, folder):
    rows = spark.read.format("image").load([str(folder / n) for n in ("a.png", "B.PNG", "other.png", "broken.png")])
    good, bad = S.readable(rows)
    assert good.count() == 3 and [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["broken.png"]
    origin = f"file://{folder}/a.png"
    faces = spark.createDataFrame([(origin, 5.0, 5.0, 40.0, 40.0, 20.0, 20.0, 50.0, 22.0, 0.9), (origin, 1.0, 1.0, 5.0, 5.0, 2.0, 2.0, 3.0, 3.0, 0.8)], "path string, x double, y double, w double, h double, rx double, ry double, lx double, ly double, score double")
    got = {r["path"].rsplit("/", 1)[1]: r for r in M.measure_images(rows, faces).collect()}
    assert set(got) == {"a.png", "B.PNG", "other.png"}
    assert (got["other.png"]["width"], got["other.png"]["height"]) == (2000, 60)
    assert got["a.png"]["face_detected"] and got["a.png"]["face_area_frac"] == pytest.approx(1600 / (128 * 96)) and got["a.png"]["face_sharpness"] > 0
    a, b, o = (np.array(got[k]["perceptual"]) for k in ("a.png", "B.PNG", "other.png"))
    assert len(a) == 1088 and np.linalg.norm(a) == pytest.approx(1, abs=1e-5)
    assert a @ b > 0.9 > a @ o
    apart = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(got["a.png"]["hash"], got["B.PNG"]["hash"], strict=True))
    assert apart < 30


def test_read_report_and_folders(spark, folder):
    rows = spark.read.format("image").load([str(folder / n) for n in ("a.png", "other.png", "broken.png")]).withColumn("job_ref", F.when(F.col("image.origin").contains("broken"), "bad").otherwise("good"))
    both = rows.union(rows.where("job_ref = 'bad'").withColumn("job_ref", F.lit("good")))
    assert sorted((r["job_ref"], r["n_images"], r["read_errors"], r["error"]) for r in S.read_report(both).collect()) == [("bad", 1, 1, "no readable images"), ("good", 3, 1, None)]
    (folder / "hollow").mkdir(exist_ok=True)
    files = S.scan_images(spark, str(folder / "below"))
    got = {(r["name"], r["n_images"]) for r in S.dataset_catalog(files, S.sub_folders(spark, [str(folder)])).collect()}
    assert got == {("below", 1), ("hollow", 0)}


def test_formulas():
    flat = np.full((20, 30), 77.0)
    assert M.laplacian_variance(flat) == 0
    g = np.arange(64).reshape(8, 8) ** 2 % 251
    p = np.pad(g.astype(float), 1, mode="reflect")
    lap = [p[r, c + 1] + p[r + 2, c + 1] + p[r + 1, c] + p[r + 1, c + 2] - 4 * p[r + 1, c + 1] for r in range(8) for c in range(8)]
    assert M.laplacian_variance(g) == pytest.approx(np.var(lap))
    assert M.area_resize(g, 4, 4) == pytest.approx(g.reshape(4, 2, 4, 2).mean((1, 3)))
    assert M.area_resize(np.ones((7, 5)), 3, 2) == pytest.approx(np.ones((3, 2)))
    m = M.dct_matrix(16)
    assert m @ m.T == pytest.approx(np.eye(16))
    assert M.shrink(np.zeros((10, 2048, 3)), 1024).shape == (5, 1024, 3) and M.shrink(g, 1024) is g
    zero = np.zeros((40, 40, 3), np.uint8)
    assert M.eye_band(zero, (1, 1, 3, 1)) is None and M.eye_band(zero, (5, 20, 25, 20)) == 0
    assert M.face_crop(np.random.default_rng(0).integers(0, 255, (50, 50, 3)).astype(np.uint8), (-5, 3, 20, 20)) > 0
    assert M.measure_pixels(zero, None)["clip_frac"] == 1.0


def test_largest_face_ties(spark):
    d = spark.createDataFrame([(1, 1, 4, 4), (1, 2, 8, 2), (1, 3, 2, 2)], "doc_id int, box_no int, w int, h int")
    assert M.largest_face(d, ["doc_id"]).first()["box_no"] == 1


def test_result_table_replaces_jobs(spark, tmp_path):
    out = str(tmp_path / "results")
    rows = lambda *x: spark.createDataFrame(list(x), "job_ref string, image_id string, keep boolean, updated_at int")
    S.write_results(rows(("a", "1", True, 1), ("a", "2", True, 1), ("b", "1", True, 1)), out)
    S.write_results(rows(("a", "3", False, 1), ("a", "3", True, 2)), out)
    got = spark.read.parquet(out).select("job_ref", "image_id", "keep").collect()
    assert sorted(map(tuple, got)) == [("a", "3", True), ("b", "1", True)]
    left = S.delete_jobs(spark.read.parquet(out), spark.createDataFrame([("b",)], "job_ref string"))
    assert {r["job_ref"] for r in left.collect()} == {"a"}


def test_reports_and_split(spark, tmp_path):
    rows = spark.createDataFrame([(1, "keep"), (2, "reject")], "id int, decision string")
    S.write_report(rows.groupBy().count(), rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "records")).count() == 2
    S.write_split(rows, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).where(F.col("decision") == "keep").count() == 1


def test_a_stack_is_measured_like_its_images():
    r = np.random.default_rng(3)
    stack = r.integers(0, 255, (5, 40, 60, 3)).astype(np.uint8)
    stack[3] = 9
    face = {"x": 5.0, "y": 4.0, "w": 20.0, "h": 22.0, "rx": 10.0, "ry": 12.0, "lx": 22.0, "ly": 13.0, "score": 0.7}
    faces = [face, None, face | {"rx": None}, None, None]
    for t in (M.LIMITS, M.QualityLimits(processing_long_side=33, sharpness_long_side=20)):
        whole = M.measure_stack(stack, faces, t)
        for k in range(5):
            one = M.measure_pixels(stack[k], faces[k], t)
            assert all(np.allclose(np.asarray(one[c], float), np.asarray(whole[c][k], float)) for c in one)
    x = stack[0].astype(float)
    v, d = x.max(2), x.max(2) - x.min(2)
    assert M.hsv_histogram(stack)[0].reshape(8, 8, 4).sum((0, 1)).tolist() == np.histogram(v, 4, (0, 256))[0].tolist()
    assert M.hsv_histogram(stack)[0].reshape(8, 8, 4).sum((0, 2)).tolist() == np.histogram(np.floor(255 * d / np.where(v > 0, v, 1) + 0.5), 8, (0, 256))[0].tolist()
    assert np.linalg.norm(M.perceptual(stack)[0], axis=1) == pytest.approx(np.ones(5), abs=1e-5)
    assert not M.unit_rows(np.zeros((2, 3))).any()
