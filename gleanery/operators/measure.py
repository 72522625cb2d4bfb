"""Image measurement: decoded pixels to metrics, hashes and vectors, in one Arrow pass.

Formulas work on arrays (numpy inside a task), on stacks of images of one shape;
small grids have the same formulas as Column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DedupLimits, QualityLimits

LIMITS = QualityLimits()


# --- arrays ---------------------------------------------------------------


def grey(bgr: np.ndarray) -> np.ndarray:
    """Luma of 8-bit pixels, rounded (Rec. 601 weights)."""
    return np.floor(bgr @ np.array([0.114, 0.587, 0.299]) + 0.5)


def laplacian_variance(g: np.ndarray) -> np.ndarray:
    """Population variance of the 4-neighbour Laplacian of (.., height, width); borders reflect without repeating the edge."""
    flat = [(0, 0)] * (g.ndim - 2)
    p = np.pad(g.astype(np.float64), [*flat, (1, 1), (1, 1)], mode="reflect" if min(g.shape[-2:]) > 1 else "edge")
    inner = p[..., 1:-1, 1:-1]
    return (p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * inner).var(axis=(-2, -1))


def _weights(n: int, m: int) -> np.ndarray:
    """m x n: the share of each of n cells in each of m equal stretches."""
    edge = np.linspace(0, n, m + 1)
    cell = np.arange(n)
    part = np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell)
    part = np.clip(part, 0, None)
    return part / part.sum(1, keepdims=True)


def area_resize(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area of each new pixel of (.., height, width)."""
    return _weights(g.shape[-2], height) @ g.astype(np.float64) @ _weights(g.shape[-1], width).T


def shrink(bgr: np.ndarray, long_side: int) -> np.ndarray:
    """Colour images (.., height, width, 3), or a grey one (height, width), to that long side, only if larger."""
    grey_one = bgr.ndim == 2
    height, width = bgr.shape if grey_one else bgr.shape[-3:-1]
    scale = long_side / max(height, width)
    if scale >= 1:
        return bgr
    out = area_resize(bgr if grey_one else np.moveaxis(bgr, -1, -3), max(1, int(height * scale)), max(1, int(width * scale)))
    return np.floor((out if grey_one else np.moveaxis(out, -3, -1)) + 0.5)


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def hash_bits(g32: np.ndarray, side: int = DedupLimits().hash_side) -> np.ndarray:
    """Bits (.., side * side) of the low frequencies above their median, which leaves out the first row and column."""
    m = dct_matrix(g32.shape[-1])
    low = (m @ g32 @ m.T)[..., :side, :side]
    rest = low[..., 1:, 1:].reshape(*low.shape[:-2], -1)
    return low.reshape(*low.shape[:-2], -1) > np.median(rest, axis=-1)[..., None]


def pack(bits: np.ndarray) -> list[int]:
    return np.packbits(bits).view(">i8").astype(np.int64).tolist()


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths; rows of zeros stay."""
    size = np.sqrt((v * v).sum(-1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def hsv_histogram(bgr: np.ndarray) -> np.ndarray:
    """Counts (image, 256) in 8 x 8 x 4 bins of hue (0..180), saturation and value (0..256) of images (image, height, width, 3)."""
    n = len(bgr)
    x = bgr.reshape(-1, 3).astype(np.float64)
    b, g, r = x[:, 0], x[:, 1], x[:, 2]
    v = x.max(1)
    d = v - x.min(1)
    safe = np.where(d > 0, d, 1)
    hue = np.select([d == 0, v == r, v == g], [0, 30 * (g - b) / safe, 60 + 30 * (b - r) / safe], 120 + 30 * (r - g) / safe) % 180
    s = np.where(v > 0, 255 * d / np.where(v > 0, v, 1), 0)
    cell = np.floor((np.floor(hue + 0.5) % 180) / 22.5) * 32 + np.floor(np.floor(s + 0.5) / 32) * 4 + np.floor(v / 64)
    image = np.repeat(np.arange(n), len(x) // max(n, 1))
    return np.bincount(image * 256 + cell.astype(np.int64), minlength=256 * n).reshape(n, 256).astype(np.float64)


def perceptual(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of images (image, height, width, 3): unit vectors of structure, hash and colour, and hash bits."""
    g = grey(bgr)
    bits = hash_bits(np.floor(area_resize(g, 32, 32) + 0.5))
    small = np.floor(area_resize(g, 24, 24) + 0.5).reshape(len(g), -1)
    parts = [0.62 * unit_rows(small - small.mean(1, keepdims=True)), 0.62 * unit_rows(bits * 2.0 - 1.0), 0.22 * unit_rows(hsv_histogram(bgr))]
    return unit_rows(np.concatenate(parts, axis=1)).astype(np.float32), bits


def eye_band(bgr: np.ndarray, eyes: tuple[float, float, float, float]) -> float | None:
    """Sharpness of the band around both eyes at a width of 160; null if too small."""
    rx, ry, lx, ly = eyes
    d = float(np.hypot(lx - rx, ly - ry))
    if d < 6:
        return None
    cx, cy = (rx + lx) / 2, (ry + ly) / 2
    h, w = bgr.shape[:2]
    x0, x1, y0, y1 = int(max(0, cx - 1.25 * d)), int(min(w, cx + 1.25 * d)), int(max(0, cy - 0.55 * d)), int(min(h, cy + 0.55 * d))
    if x1 - x0 < 4 or y1 - y0 < 4:
        return None
    g = grey(bgr[y0:y1, x0:x1])
    return float(laplacian_variance(np.floor(area_resize(g, max(4, int(g.shape[0] * 160 / g.shape[1])), 160) + 0.5)))


def face_crop(bgr: np.ndarray, box: tuple[int, int, int, int]) -> float:
    """Sharpness of the box, its corner moved into the frame, at 256 x 256."""
    x, y, w, h = box
    x, y = max(0, x), max(0, y)
    crop = bgr[y : y + h, x : x + w]
    return float(laplacian_variance(np.floor(area_resize(grey(crop), 256, 256) + 0.5))) if crop.size else 0.0


def measure_stack(bgr: np.ndarray, faces: list[dict | None], t: QualityLimits = LIMITS) -> dict[str, list]:
    """Metrics of images of one shape (image, height, width, 3), by column. faces: x, y, w, h and eyes rx, ry, lx, ly, score in pixels of the image as given, or None."""
    n, height, width = bgr.shape[:3]
    x = shrink(bgr, t.processing_long_side)
    ratio = x.shape[2] / width
    g = grey(x)
    feat, bits = perceptual(x)
    out = {
        "width": [width] * n,
        "height": [height] * n,
        "global_sharpness": laplacian_variance(grey(shrink(x, t.sharpness_long_side))).tolist(),
        "mean_luma": g.mean(axis=(1, 2)).tolist(),
        "clip_frac": ((g < 6) | (g > 249)).mean(axis=(1, 2)).tolist(),
        "face_detected": [f is not None for f in faces],
        "face_area_frac": [0.0] * n,
        "face_conf": [0.0] * n,
        "face_sharpness": [0.0] * n,
        "perceptual": list(feat),
        "hash": [pack(b) for b in bits],
    }
    for k, face in enumerate(faces):
        if face is not None:
            box = tuple(int(face[c] * ratio) for c in ("x", "y", "w", "h"))
            out["face_area_frac"][k] = box[2] * box[3] / (x.shape[1] * x.shape[2])
            out["face_conf"][k] = float(face["score"])
            sharp = eye_band(x[k], tuple(float(face[c]) * ratio for c in ("rx", "ry", "lx", "ly"))) if face.get("rx") is not None else None
            out["face_sharpness"][k] = sharp if sharp is not None else face_crop(x[k], box)
    return out


def measure_pixels(bgr: np.ndarray, face: dict | None, t: QualityLimits = LIMITS) -> dict:
    """Metrics of one image."""
    return {k: v[0] for k, v in measure_stack(bgr[None], [face], t).items()}


MEASURED = (
    "path string, width int, height int, global_sharpness double, mean_luma double, clip_frac double, face_detected boolean,"
    " face_area_frac double, face_conf double, face_sharpness double, perceptual array<float>, hash array<bigint>"
)


#: Bytes of pixels that are measured at once, and of arrays beside them: for each image those of its hash and vector, for each pixel those of its colours.
STACK, WORK, OF_IMAGE, OF_PIXEL = 1 << 24, 1 << 25, 96 << 10, 160


def measure_images(images: DataFrame, detections: DataFrame | None = None, t: QualityLimits = LIMITS) -> DataFrame:
    """Metrics of rows of the `image` source that could be read. detections: path, x, y, w, h, rx, ry, lx, ly, score.

    Images of one shape in an Arrow batch are stacked, up to STACK bytes and WORK bytes of arrays made of them, and measured together; only faces are cropped one by one.
    """
    rows = images.where("image.height > 0").select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    kinds = "struct<x:double,y:double,w:double,h:double,rx:double,ry:double,lx:double,ly:double,score:double>"
    if detections is None:
        rows = rows.withColumn("face", F.lit(None).cast(kinds))
    else:
        rows = rows.join(largest_face(detections, ["path"]).select("path", F.struct(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "rx", "ry", "lx", "ly", "score"))).alias("face")), "path", "left")
    fields = [c.split() for c in MEASURED.split(", ")]
    kind = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32()), "array<bigint>": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = np.stack([batch.column(c).to_numpy() for c in (1, 2, 3)], axis=1)
            for shape in np.unique(shapes, axis=0):
                same = np.flatnonzero((shapes == shape).all(1))
                height, width, channels = shape.tolist()
                for part in np.array_split(same, max(-(-len(same) * height * width * channels // STACK), -(-len(same) * (OF_IMAGE + OF_PIXEL * height * width) // WORK))):
                    some = batch.take(pa.array(part))
                    x = np.frombuffer(b"".join(some.column(4).to_pylist()), np.uint8).reshape(len(part), height, width, channels)
                    x = np.repeat(x, 3, 3) if channels == 1 else x[..., :3]
                    found = measure_stack(x, some.column(5).to_pylist(), t)
                    yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(found[c], kind[k]) for c, k in fields[1:])], names=[c for c, _ in fields])

    return rows.mapInArrow(run, MEASURED)


# --- columns --------------------------------------------------------------


def largest_face(detections: DataFrame, keys: list[str]) -> DataFrame:
    """The detection of greatest area for each key; of equal ones the first (`box_no`, else by position)."""
    no = "box_no" if "box_no" in detections.columns else "x"
    order = F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col(no)).alias("no"))
    rest = [c for c in detections.columns if c not in keys]
    return detections.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("d")).select(*keys, "d.*")


def face_area(w: Column, h: Column, width: Column, height: Column) -> Column:
    """Area of the box as given, by the frame's."""
    return (w * h).cast("double") / (width * height).cast("double")


def eye_band_box(rx: Column, ry: Column, lx: Column, ly: Column, width: Column, height: Column) -> Column:
    """struct(x0, y0, x1, y1) of the band around the eyes, or null if the eyes are near or the band is small."""
    d = F.sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry))
    cx, cy = (rx + lx) / 2.0, (ry + ly) / 2.0
    x0, x1 = F.greatest(F.lit(0.0), cx - d * 1.25).cast("int"), F.least(width.cast("double"), cx + d * 1.25).cast("int")
    y0, y1 = F.greatest(F.lit(0.0), cy - d * 0.55).cast("int"), F.least(height.cast("double"), cy + d * 0.55).cast("int")
    return F.when((d >= 6) & (x1 - x0 >= 4) & (y1 - y0 >= 4), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def face_sharpness_choice(eye: Column, crop: Column) -> Column:
    return F.coalesce(eye, crop, F.lit(0.0))


def grid_exposure(pixels: Column) -> tuple[Column, Column]:
    """Mean and clipped share of a grey grid given as an array of whole numbers."""
    n = F.size(pixels)
    total = F.aggregate(pixels, F.lit(0).cast("bigint"), lambda a, x: a + x)
    clipped = F.size(F.filter(pixels, lambda x: (x < 6) | (x > 249)))
    return total / n, clipped / n


def grid_halved(pixels: Column, side: int) -> Column:
    """Sums of 2 x 2 blocks (four times their mean)."""
    half = side // 2
    at = lambda r, c: F.get(pixels, r * side + c)
    return F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), lambda k: sum((at(F.floor(k / half) * 2 + i, (k % half) * 2 + j) for i in (0, 1) for j in (0, 1)), F.lit(0)))


def grid_laplacian_variance(pixels: Column, side: int, scale: int = 1) -> Column:
    """laplacian_variance of a grid of whole numbers, each `scale` times the pixel."""
    mirror = lambda i: F.when(i < 0, 1).when(i >= side, side - 2).otherwise(i)
    at = lambda r, c: F.get(pixels, (mirror(r) * side + mirror(c)).cast("int"))

    def lap(k: Column) -> Column:
        r, c = F.floor(k / side), k % side
        return (at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * at(r, c)).cast("bigint")

    n = side * side
    values = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lap)
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("q"))
    return F.aggregate(values, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), lambda a: (n * a["q"] - a["s"] * a["s"]) / F.lit(float(n * n * scale * scale)))


def dct_weights(side: int, keep: int) -> list[list[float]]:
    """For each of the keep x keep lowest frequencies the weights of a grid's pixels."""
    m = dct_matrix(side)
    return [np.outer(m[u], m[v]).ravel().tolist() for u in range(keep) for v in range(keep)]


def grid_hash_bits(df: DataFrame, side: int = 8, keep: int = 4) -> DataFrame:
    """Adds hash_bits of the grids in `pixels`, as text of 0 and 1."""
    pixels = F.col("pixels")
    dots = [F.aggregate(F.zip_with(pixels, F.lit(w), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) for w in dct_weights(side, keep)]
    inner = F.array_sort(F.filter(F.transform("_low", lambda x, i: F.when((i >= keep) & (i % keep > 0), x)), lambda x: x.isNotNull()))
    n = (keep - 1) ** 2
    median = (F.get(inner, (n - 1) // 2) + F.get(inner, n // 2)) / 2
    text = F.array_join(F.transform("_low", lambda x: F.when(x > median, "1").otherwise("0")), "")
    return df.withColumn("_low", F.array(*dots)).withColumn("hash_bits", text).drop("_low")
