import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.functions.faces import HEAD, pose
from attest.operators import landmarks


def turned(yaw, pitch, roll, scale=0.3, shift=(320, 240)):
    """Pixels of the six points of the head, turned by known angles."""
    y, p, r = (math.radians(x) for x in (yaw, pitch, roll))
    about_x = np.array([[1, 0, 0], [0, math.cos(p), -math.sin(p)], [0, math.sin(p), math.cos(p)]])
    about_y = np.array([[math.cos(y), 0, math.sin(y)], [0, 1, 0], [-math.sin(y), 0, math.cos(y)]])
    about_z = np.array([[math.cos(r), -math.sin(r), 0], [math.sin(r), math.cos(r), 0], [0, 0, 1]])
    seen = (about_z @ about_y @ about_x @ np.array(list(HEAD.values())).T).T[:, :2] * scale
    return {i: (float(x + shift[0]), float(shift[1] - v)) for i, (x, v) in zip(HEAD, seen, strict=True)}


POINT = "face string, index int, pixel_x double, pixel_y double"


def test_pose_recovers_known_turns(spark):
    known = {f"{y},{p},{r}": (y, p, r) for y, p, r in ((0, 0, 0), (20, -10, 5), (-35, 12, -20), (8, 30, 44))}
    rows = [(name, i, x, y) for name, angles in known.items() for i, (x, y) in turned(*angles).items()]
    rows += [("none", 99, 1.0, 1.0), ("part", 30, 1.0, 2.0), *(("flat", i, 5.0, 5.0) for i in HEAD), *(("null", i, None if i == 8 else 1.0, 2.0) for i in HEAD)]
    random.Random(2).shuffle(rows)
    got = {r.face: r for r in landmarks.head_poses(spark.createDataFrame(rows, POINT).repartition(4), "face").collect()}
    for name, angles in known.items():
        assert (got[name].yaw, got[name].pitch, got[name].roll) == pytest.approx(angles, abs=1e-6) and got[name].problem is None
        assert pose(np.array([turned(*angles)[i] for i in HEAD])) == pytest.approx(angles, abs=1e-6)
    assert {k: got[k].problem for k in ("none", "part", "flat", "null")} == {"none": "missing_landmarks", "part": "missing_landmarks", "flat": "degenerate_landmarks", "null": "missing_landmarks"}
    assert got["flat"].yaw is None and got["part"].roll is None


def test_pose_of_a_line_is_degenerate(spark):
    rows = [("line", i, 10.0 * k[0], 0.0) for i, k in HEAD.items()]
    assert landmarks.head_poses(spark.createDataFrame(rows, POINT), "face").first().problem == "degenerate_landmarks"


def test_similarities_are_least_squares(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(12):
        p, q = r.normal(0, 50, (3 + g, 2)), r.normal(0, 50, (3 + g, 2))
        rows += [(g, *map(float, x), *map(float, y)) for x, y in zip(p, q, strict=True)]
        table = np.concatenate([[[x, -y, 1, 0], [y, x, 0, 1]] for x, y in p])
        fit, left, *_ = np.linalg.lstsq(table, q.ravel(), rcond=None)
        want[g] = (*fit, left[0] / len(p))
    rows += [(100, 1.0, 2.0, 3.0, 4.0), (101, None, 2.0, 3.0, 4.0), *[(102, 7.0, 7.0, float(k), 1.0) for k in range(4)]]
    got = {x.g: x for x in landmarks.similarities(spark.createDataFrame(rows, "g int, x double, y double, u double, v double"), "g").collect()}
    for g, (a, b, tx, ty, error) in want.items():
        assert (got[g].a, got[g].b, got[g].tx, got[g].ty, got[g].error) == pytest.approx((a, b, tx, ty, error)) and got[g].problem is None
    assert [(got[g].n, got[g].a, got[g].problem) for g in (100, 101, 102)] == [(1, None, "degenerate"), (0, None, "degenerate"), (4, None, "degenerate")]


def test_alignment_maps_points_and_back(spark):
    a, b, tx, ty = 0.4, 0.1, 12.0, -7.0
    back = np.linalg.inv(np.array([[a, -b, tx], [b, a, ty], [0, 0, 1]]))
    places = {0: range(36, 42), 1: range(42, 48), 2: [30], 3: [48], 4: [54]}
    rows = [("whole", i, *map(float, (back @ [*uv, 1])[:2])) for k, uv in enumerate(landmarks.TEMPLATE) for i in places[k]]
    rows += [("part", i, 1.0, 2.0) for i in range(36, 42)] + [("none", 1, 1.0, 2.0)]
    got = {x.face: x for x in landmarks.alignments(spark.createDataFrame(rows, POINT), "face").collect()}
    one = got["whole"]
    assert (one.a, one.b, one.tx, one.ty, one.error) == pytest.approx((a, b, tx, ty, 0), abs=1e-9)
    assert one.back == pytest.approx(back[:2].ravel().tolist())
    assert [(got[k].problem, got[k].a, got[k].back) for k in ("part", "none")] == [("missing_landmarks", None, None)] * 2


def test_landmarks_in_three_systems_and_back(spark):
    values = [k / 68 for k in range(68)] + [1 - k / 68 for k in range(68)]
    box = [0.1, 0.2, 0.5, 0.9]
    rows = [(1, values, box, 640, 480), (2, values[:-1], box, 640, 480), (3, None, box, 640, 480), (4, [None, *values[1:]], [0.0, 0.0, 1.0, 1.0], 100, 50)]
    df = spark.createDataFrame(rows, "k int, values array<double>, box array<double>, width int, height int")
    told = landmarks.landmarks(df, "k", ("box", "width", "height"))
    x, y = landmarks.back_in_crop(F.col("image_x"), F.col("image_y"), F.col("box"), F.col("width"), F.col("height"))
    got = {(r.k, r["index"]): r for r in told.withColumns({"bx": x, "by": y}).collect()}
    assert {k for k, _ in got} == {1, 4} and len(got) == 136
    left, top, right, bottom = 0.04 * 640, 0.095 * 480, 0.56 * 640, 1.0 * 480
    for i in range(68):
        r = got[1, i]
        px, py = left + values[i] * (right - left), top + values[68 + i] * (bottom - top)
        assert (r.image_x, r.image_y) == pytest.approx((px / 640, py / 480)) and (r.pixel_x, r.pixel_y) == (round(px), round(py))
        assert (r.bx, r.by) == pytest.approx((r.crop_x, r.crop_y))
    assert got[4, 0].pixel_x is None and got[4, 0].pixel_y == 50
