"""Faces and boxes: anchors, decoding, suppression, quality, geometry. A box is an array [left, top, right, bottom] of fractions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAPS = (32, 16, 8, 4, 2, 1)
#: Limits of the published quality policy (fixed values).
LIMITS = {"pixels": 80, "side": 0.12, "border": 0.01, "yaw": 35.0, "pitch": 35.0, "roll": 30.0, "covered": 0.8}
BLOCKS_LIVENESS = ("MULTIPLE_FACES", "FACE_TOO_SMALL", "FACE_CUTOFF")


def anchor_shapes() -> list[list[tuple[float, float]]]:
    """(height, width) of the anchors of each feature map: three fixed ones on the finest, six by scale and ratio on the others."""
    scales = [*np.linspace(0.2, 0.95, len(MAPS)).tolist(), 1.0]
    out = [[(0.1, 0.1), (0.2 / math.sqrt(2), 0.2 * math.sqrt(2)), (0.2 * math.sqrt(2), 0.2 / math.sqrt(2))]]
    for a, b in zip(scales[1:-1], scales[2:], strict=True):
        out.append([(a, a), (math.sqrt(a * b),) * 2, *((a / math.sqrt(r), a * math.sqrt(r)) for r in (2.0, 0.5, 3.0, 1 / 3))])
    return out


def anchors(spark: SparkSession) -> DataFrame:
    """anchor (from 0), cy, cx, h, w: 5118 rows, row by row of each map. A dimension of fixed size."""
    rows = [(m, n, k, h, w) for m, (n, shapes) in enumerate(zip(MAPS, anchor_shapes(), strict=True)) for k, (h, w) in enumerate(shapes)]
    shapes = spark.createDataFrame(rows, "m int, n int, k int, h double, w double")
    firsts, at = {}, 0
    for m, (n, s) in enumerate(zip(MAPS, anchor_shapes(), strict=True)):
        firsts[m], at = at, at + n * n * len(s)
    first = F.element_at(F.create_map(*(F.lit(x) for pair in firsts.items() for x in pair)), F.col("m"))
    per = F.when(F.col("m") == 0, 3).otherwise(6)
    cells = shapes.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return cells.select((first + (F.col("row") * F.col("n") + F.col("col")) * per + F.col("k")).cast("int").alias("anchor"), ((F.col("row") + 0.5) / F.col("n")).alias("cy"), ((F.col("col") + 0.5) / F.col("n")).alias("cx"), "h", "w")


def decoded_box(code: Column, cy: Column, cx: Column, h: Column, w: Column) -> Column:
    """An encoding (centre y and x over 10, log height and width over 5) against its anchor."""
    y, x = code[0] / 10 * h + cy, code[1] / 10 * w + cx
    height, width = F.exp(code[2] / 5) * h, F.exp(code[3] / 5) * w
    return F.array(x - width / 2, y - height / 2, x + width / 2, y + height / 2)


def area(box: Column) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    both = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return F.coalesce(F.try_divide(both, F.nullif(area(a) + area(b) - both, F.lit(0.0))), F.lit(0.0))


def suppressed(detections: Column, threshold: float = 0.5) -> Column:
    """Greedy suppression over an array of structs (score, seq, box): by falling score, the lower seq first, each kept unless it
    overlaps a kept one by more than the threshold (as much as the threshold is kept)."""
    ordered = F.array_sort(F.transform(detections, lambda d: F.struct((-d["score"]).alias("neg"), d["seq"].alias("seq"), d["box"].alias("box"))))
    kept = F.aggregate(ordered, F.filter(ordered, lambda d: F.lit(False)), lambda acc, d: F.when(F.exists(acc, lambda k: overlap(k["box"], d["box"]) > threshold), acc).otherwise(F.concat(acc, F.array(d))))
    return F.transform(kept, lambda d: F.struct((-d["neg"]).alias("score"), d["seq"].alias("seq"), d["box"].alias("box")))


def plausible_face(box: Column, score: Column) -> Column:
    width, height = box[2] - box[0], box[3] - box[1]
    return (score >= 0.5) & (width >= 0.08) & (height >= 0.08) & F.coalesce(F.try_divide(width, height).between(0.5, 1.5), F.lit(False))


def clipped(box: Column) -> Column:
    return F.transform(box, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def quality_warnings(box: Column, width: Column, height: Column, yaw: Column, pitch: Column, roll: Column, faces: Column, covered: Column, limits: dict = LIMITS) -> Column:
    """Warnings with their codes, always in the same order."""
    w, h = box[2] - box[0], box[3] - box[1]
    small = (F.least(w * width, h * height) < limits["pixels"]) | (F.least(w, h) < limits["side"])
    m = limits["border"]
    cut = (box[0] <= m) | (box[1] <= m) | (box[2] >= 1 - m) | (box[3] >= 1 - m)
    pose = (F.abs(yaw) > limits["yaw"]) | (F.abs(pitch) > limits["pitch"]) | (F.abs(roll) > limits["roll"])
    told = ((faces > 1, "MULTIPLE_FACES", -500), (small, "FACE_TOO_SMALL", -100), (cut, "FACE_CUTOFF", -200), (pose, "EXCESSIVE_POSE", -300), (F.coalesce(covered >= limits["covered"], F.lit(False)), "COVERED_FACE", -400))
    return F.filter(F.array(*(F.when(is_so, F.struct(F.lit(name).alias("code"), F.lit(code).alias("legacyCode"))) for is_so, name, code in told)), lambda x: x.isNotNull())


def liveness_eligible(warnings: Column) -> Column:
    return ~F.exists(warnings, lambda x: x["code"].isin(*BLOCKS_LIVENESS))


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """Pixels, rounded half to even and held within the image."""
    at = lambda k, size: F.least(F.greatest(F.bround(box[k] * size).cast("int"), F.lit(0)), size.cast("int"))
    return F.array(at(0, width), at(1, height), at(2, width), at(3, height))


def turned_back(box: Column, rotation: Column) -> Column:
    """A box of an image that was turned by 0, 90, 180 or 270 degrees, in the image before; null for other angles."""
    l, t, r, b = (box[k] for k in range(4))
    return F.when(rotation == 0, box).when(rotation == 90, F.array(1 - b, l, 1 - t, r)).when(rotation == 180, F.array(1 - r, 1 - b, 1 - l, 1 - t)).when(rotation == 270, F.array(t, 1 - r, b, 1 - l))


def source_box(box: Column, corners: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A box of the rectified image in the photograph: its corners between the document's four (clockwise from top left), and the upright box around them."""
    return F.get(F.transform(F.array(turned_back(box, rotation)), lambda b: _upright(b, corners, width, height)), F.lit(0))


def _upright(b: Column, corners: Column, width: Column, height: Column) -> Column:
    def axis(k: int, size: Column) -> tuple[Column, Column]:
        def point(x: Column, y: Column) -> Column:
            return (1 - x) * (1 - y) * corners[0][k] + x * (1 - y) * corners[1][k] + x * y * corners[2][k] + (1 - x) * y * corners[3][k]

        at = [point(b[i], b[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))]
        hold = lambda v: F.least(F.greatest(v / size, F.lit(0.0)), F.lit(1.0))
        return hold(F.least(*at)), hold(F.greatest(*at))

    (l, r), (t, d) = axis(0, width), axis(1, height)
    return F.when(b.isNotNull(), F.array(l, t, r, d))


def landmark_points(values: Column, box: Column, width: Column, height: Column, padding: float = 0.15) -> Column:
    """68 pairs, relative to the padded face box, in three systems: crop, image, pixel."""
    w, h = box[2] - box[0], box[3] - box[1]
    l, t = F.greatest(box[0] - padding * w, F.lit(0.0)), F.greatest(box[1] - padding * h, F.lit(0.0))
    r, b = F.least(box[2] + padding * w, F.lit(1.0)), F.least(box[3] + padding * h, F.lit(1.0))

    def one(i: Column) -> Column:
        x, y = F.element_at(values, 2 * i + 1), F.element_at(values, 2 * i + 2)
        u, v = l + x * (r - l), t + y * (b - t)
        return F.struct(i.alias("index"), F.array(x, y).alias("crop"), F.array(u, v).alias("image"), F.array(u * width, v * height).alias("pixel"))

    return F.transform(F.sequence(F.lit(0), (F.size(values) / 2).cast("int") - 1), one)


#: Six points of a generic head, as numbered among 68 landmarks: nose tip, chin, outer eye corners, mouth corners (fixed values).
HEAD = {30: (0.0, 0.0, 0.0), 8: (0.0, -330.0, -65.0), 36: (-225.0, 170.0, -135.0), 45: (225.0, 170.0, -135.0), 48: (-150.0, -150.0, -125.0), 54: (150.0, -150.0, -125.0)}


def pose(points: np.ndarray) -> tuple[float, float, float] | None:
    """Yaw, pitch, roll in degrees under weak perspective: the linear map from head to image by least squares, its two rows made
    orthonormal, a third one across them. None if the points are degenerate."""
    head = np.array(list(HEAD.values()))
    seen = (points - points.mean(0)) * (1, -1)
    a, b = np.linalg.lstsq(head - head.mean(0), seen, rcond=None)[0].T
    if np.linalg.norm(a) <= 1e-8:
        return None
    a = a / np.linalg.norm(a)
    b = b - (a @ b) * a
    if np.linalg.norm(b) <= 1e-8:
        return None
    b = b / np.linalg.norm(b)
    c = np.cross(a, b)
    angles = math.atan2(-c[0], math.hypot(a[0], b[0])), math.atan2(c[1], c[2]), math.atan2(b[0], a[0])
    return tuple(map(math.degrees, angles))


@F.pandas_udf(T.StructType([T.StructField(x, T.DoubleType()) for x in ("yaw", "pitch", "roll")]))
def head_pose(points: pd.Series) -> pd.DataFrame:
    """From the twelve pixel coordinates of the points of HEAD, in its order; null angles where the points are degenerate."""
    told = [None if p is None or len(p) != 12 else pose(np.asarray(p, float).reshape(6, 2)) for p in points]
    return pd.DataFrame([t or (None, None, None) for t in told], columns=["yaw", "pitch", "roll"], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def similarity_transform(points: pd.Series, target: pd.Series) -> pd.Series:
    """[a, -b, tx, b, a, ty] that takes points to target with least squared error; null where there are fewer than two points."""

    def one(p, q):
        if p is None or q is None or len(p) != len(q) or len(p) < 4:
            return None
        p, q = np.asarray(p, float).reshape(-1, 2), np.asarray(q, float).reshape(-1, 2)
        rows = np.zeros((2 * len(p), 4))
        rows[0::2] = np.column_stack([p[:, 0], -p[:, 1], np.ones(len(p)), np.zeros(len(p))])
        rows[1::2] = np.column_stack([p[:, 1], p[:, 0], np.zeros(len(p)), np.ones(len(p))])
        a, b, x, y = np.linalg.lstsq(rows, q.ravel(), rcond=None)[0]
        return [a, -b, x, b, a, y]

    return pd.Series([one(p, q) for p, q in zip(points, target, strict=True)])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def template_decode(payload: pd.Series) -> pd.Series:
    """float32 little-endian; null where the bytes are no whole number of them."""
    return payload.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))


@F.pandas_udf(T.BinaryType())
def template_encode(vector: pd.Series) -> pd.Series:
    return vector.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())
