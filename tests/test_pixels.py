import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.functions import mrz
from attest.operators import imaging, pixels


def table(spark, images):
    """name -> array of grays, as lines in any order."""
    rows = [(k, y, [int(v) for v in line]) for k, image in images.items() for y, line in enumerate(image)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "image string, y int, values array<int>").repartition(5)


def looked(image, reference, bounds):
    """Every place of one patch by plain loops: (score, -place), box."""
    h, w = image.shape
    left, top, right, bottom = bounds
    out = []
    place = -1
    for s in pixels.SCALES:
        for dx in pixels.SHIFTS:
            for dy in pixels.SHIFTS:
                place += 1
                cx, cy = ((left + right) / 2 + dx * (right - left)) * w, ((top + bottom) / 2 + dy * (bottom - top)) * h
                bw, bh = (right - left) * w * s, (bottom - top) * h * s
                box = [max(0, round(cx - bw / 2)), max(0, round(cy - bh / 2)), min(w, round(cx + bw / 2)), min(h, round(cy + bh / 2))]
                if box[2] - box[0] < 2 or box[3] - box[1] < 2:
                    continue
                part = np.floor(imaging.resized(image[box[1] : box[3], box[0] : box[2]], *reference.shape) + 0.5)
                a, b = reference.astype(float), part

                def alike(x, y):
                    x, y = x - x.mean(), y - y.mean()
                    size = np.sqrt((x * x).sum() * (y * y).sum())
                    return float(np.allclose(x, y)) if size < 1e-6 else (x * y).sum() / size

                steep = lambda x: np.hypot(*np.gradient(x))
                score = 0.35 * (alike(a, b) + 1) / 2 + 0.45 * (alike(steep(a), steep(b)) + 1) / 2 + 0.2 * (1 - np.abs(a - b).mean() / 255)
                out.append((round(score, 9), -place, box))
    return out


def test_patches_are_brute_force(spark):
    r = np.random.default_rng(5)
    sizes = {"a": (40, 50), "b": (23, 61), "c": (30, 30), "d": (12, 9), "flat": (20, 20)}
    images = {k: np.floor(imaging.resized(r.integers(0, 255, (max(2, h // 4), max(2, w // 4))).astype(float), h, w)).astype(int) for k, (h, w) in sizes.items()}
    images["flat"][:] = 90
    known = {"p": (0.2, 0.3, 0.6, 0.7), "q": (0.0, 0.0, 0.5, 0.4), "thin": (0.5, 0.5, 0.51, 0.9)}
    parts = {"p": images["a"][12:28, 10:30], "q": r.integers(0, 255, (7, 11)), "thin": r.integers(0, 255, (4, 4))}
    patches = table(spark, parts).withColumnRenamed("image", "patch")
    bounds = spark.createDataFrame([("one", k, list(b)) for k, b in known.items()], "layout string, patch string, bounds array<double>")
    df = spark.createDataFrame([(k, "one", h, w) for k, (h, w) in sizes.items()] + [("other", "two", 9, 9)], "image string, layout string, height int, width int")
    got = {(x.image, x.patch): x for x in pixels.matched_patches(df, table(spark, images), bounds, patches).collect()}
    for k, image in images.items():
        for name, box in known.items():
            every = looked(image, parts[name], box)
            if not every:
                assert (k, name) not in got
                continue
            score, place, where = max(every)
            one = got[k, name]
            assert (one.score, one.place, one.box, one.candidates) == (pytest.approx(score, abs=2e-9), -place, where, len(every)), (k, name)
    assert ("other", "p") not in got
    exact = got["a", "p"]
    assert exact.score == 1.0 and (exact.scale, exact.dx, exact.dy, exact.intensity) == (1.0, 0.0, 0.0, pytest.approx(1.0))
    assert got["flat", "p"].place == 0  # all places agree: the first counts


def test_a_visible_change_lowers_the_score(spark):
    y, x = np.mgrid[:60, :80]
    image = (x * 3 + y * 2) % 256
    changed = image.copy()
    changed[20:40, 20:50] = 255 - changed[20:40, 20:50] // 3
    df = spark.createDataFrame([("same", "l", 60, 80), ("changed", "l", 60, 80)], "image string, layout string, height int, width int")
    bounds = spark.createDataFrame([("l", "p", [0.25, 0.3, 0.65, 0.7])], "layout string, patch string, bounds array<double>")
    patches = table(spark, {"p": image[18:42, 20:52]}).withColumnRenamed("image", "patch")
    got = {r.image: r.score for r in pixels.matched_patches(df, table(spark, {"same": image, "changed": changed}), bounds, patches).collect()}
    assert got["same"] > 0.999 and got["changed"] < 0.9


def wanted(spark, names, rows=2, shape=(None, None)):
    df = spark.createDataFrame([(k, *shape) for k in names], "image string, width_ratio double, height_ratio double")
    return df.select("image", F.lit(rows).alias("rows"), mrz.search_ratios(F.col("height_ratio"), rows).alias("ratios"), "width_ratio", "height_ratio")


def page(height, width, zones, strokes=0, seed=0):
    """A light page with two lines of dark strokes for each zone (top, left, right), and loose strokes elsewhere."""
    image = np.full((height, width), 240)
    r = np.random.default_rng(seed)
    for _ in range(strokes):
        a, b = r.integers(0, height - 6), r.integers(0, width - 12)
        image[a : a + 3, b : b + 9] = 40
    for top, left, right in zones:
        for line in (top, top + height // 12):
            for x in range(left, right - 4, 8):
                image[line : line + height // 20, x : x + 4] = 20
    return image


def test_zones_lie_where_they_were_drawn(spark):
    r = random.Random(3)
    images, truth = {}, {}
    for k in range(12):
        h, w = r.choice([(200, 300), (320, 240), (151, 333)])
        top = r.randrange(0, h - h // 6)
        truth[f"i{k}"] = (top / h, (top + h // 12 + h // 20) / h)
        images[f"i{k}"] = page(h, w, [(top, 10, w - 10)], strokes=10, seed=k)
    images["blank"] = np.full((100, 100), 7)
    images["narrow"] = page(200, 300, [(100, 120, 200)])
    images["two"] = page(300, 300, [(30, 10, 290), (200, 10, 290)])
    images["low"] = images["i0"][:19]
    got = {x.image: x.boxes for x in pixels.zones(table(spark, images), wanted(spark, [*images, "absent"])).collect()}
    for k, (top, bottom) in truth.items():
        left, t, right, b = got[k][0]
        assert t <= top + 0.01 and b >= bottom - 0.01 and b - t < bottom - top + 0.12 and left < 0.1 and right > 0.9, k
    assert got["blank"] == got["narrow"] == got["low"] == got["absent"] == []
    middles = sorted((b[1] + b[3]) / 2 for b in got["two"])
    assert len(middles) == 2 and middles[0] < 0.3 and middles[1] > 0.6
    assert len(pixels.zones(table(spark, {"two": images["two"]}), wanted(spark, ["two"]), most=1).first().boxes) == 1


def test_an_expected_shape_decides(spark):
    image = page(300, 400, [(40, 100, 395)])
    image[200:230] = page(300, 400, [(200, 10, 395)])[200:230]
    tall = pixels.zones(table(spark, {"x": image}), wanted(spark, ["x"], shape=(0.74, 0.14))).first().boxes
    assert tall and abs((tall[0][1] + tall[0][3]) / 2 - 0.2) < 0.1


def test_lines_of_images(spark):
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    df = spark.createDataFrame([(1, 2, 4, bytearray(image.tobytes())), (2, 0, 0, None), (3, 1, 1, bytearray(b"\x10\x10\x10"))], "k int, height int, width int, data binary")
    got = {(r.image, r.y): r["values"] for r in imaging.gray_lines(df, "k").collect()}
    assert got == {(1, 0): imaging.luminance(image)[0].tolist(), (1, 1): imaging.luminance(image)[1].tolist(), (3, 0): [16]}


def test_rows_are_numbered_in_many_tasks(spark):
    from attest.plans import pixel_tables
    from attest.sources.tables import numbered

    assert "OVER (ORDER BY" not in pixel_tables._LINES  # Spark would put all rows into one task
    keys = [k * 7919 % 1000 for k in range(1000)]
    df = spark.createDataFrame([(k, str(k)) for k in keys], "key long, text string")
    rows = numbered(df, "key").collect()
    assert sorted((r.k, r.key, r.text) for r in rows) == [(n, k, str(k)) for n, k in enumerate(sorted(keys))]
    assert numbered(df.where("false"), "key").count() == 0


def test_strokes_are_brute_force(spark):
    r = random.Random(3)
    images = {k: [[r.choice([None, 0, 3, 90, 200, 255]) for _ in range(r.randint(0, 12))] for _ in range(9)] for k in "abc"}
    images["flat"] = [[7] * 5, []]
    rows = [(k, y, line) for k, image in images.items() for y, line in enumerate(image)]
    got = {(x.image, x.y): (x.width, x.n, x.first, x.last) for x in pixels.line_strokes(spark.createDataFrame(rows, "image string, y int, values array<int>")).collect()}
    for k, y, line in rows:
        grays = [v for own in images[k] for v in own if v is not None]
        least = max(1.0, (max(grays) - min(grays)) * pixels.STROKE)
        at = [i for i in range(1, len(line) - 1) if None not in (line[i - 1], line[i + 1]) and abs(line[i + 1] - line[i - 1]) >= least]
        width, n, first, last = got[k, y]
        assert (width, n) == (len(line), len(at)) and (not at or (first, last) == (at[0], at[-1]))
    assert len(got) == len(rows)
