"""Faces as tables of points: landmarks in three systems, the pose of a head, the map that brings a face to a template.

Points are rows, and fits are normal equations: sums of products of a face's points, each an aggregate with a partial sum, solved in
column expressions afterwards. No face is ever gathered in one place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.faces import HEAD

#: Points of a face, how far its box is grown before they are sought, and what counts as no extent.
POINTS, PADDING, NONE = 68, 0.15, 1e-8
#: Five points of an aligned face (both eyes, nose, corners of the mouth) in an image of 112 by 112.
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


def crop_box(box: Column, width: Column, height: Column, padding: float = PADDING) -> Column:
    """The part of an image that landmarks are sought in, in pixels with fractions: a face's box grown on all sides, held within the image."""
    w, h = box[2] - box[0], box[3] - box[1]
    zero = F.lit(0.0)
    return F.array(
        F.greatest(zero, (box[0] - w * padding) * width), F.greatest(zero, (box[1] - h * padding) * height),
        F.least(width.cast("double"), (box[2] + w * padding) * width), F.least(height.cast("double"), (box[3] + h * padding) * height),
    )


def landmarks(faces: DataFrame, key: str, keep: tuple[str, ...] = (), points: int = POINTS, padding: float = PADDING) -> DataFrame:
    """key, the columns `keep` of faces, index, crop_x, crop_y, image_x, image_y (fractions of the crop and of the image), pixel_x, pixel_y (whole pixels, halves to even).

    faces: key, values (what a detector tells: the x of all points, then their y, as fractions of the crop), box, width, height. A face
    whose values are missing or not twice as many as there are points gives no rows; a null value gives a point without that coordinate.
    """
    whole = faces.where(F.size("values") == 2 * points).select(key, *(F.col(c).alias(f"_keep_{c}") for c in keep), "values", "width", "height", crop_box(F.col("box"), F.col("width"), F.col("height"), padding).alias("_crop"))
    kept = [f"_keep_{c}" for c in keep]
    each = whole.select(key, *kept, "width", "height", "_crop", F.posexplode(F.slice("values", 1, points)).alias("index", "crop_x"), F.slice("values", points + 1, points).alias("_ys")).withColumn("crop_y", F.get("_ys", F.col("index")))
    at = lambda k, c: F.col("_crop")[k] + F.col(c) * (F.col("_crop")[k + 2] - F.col("_crop")[k])
    each = each.withColumns({"_x": at(0, "crop_x"), "_y": at(1, "crop_y")})
    return each.select(key, *(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), "index", "crop_x", "crop_y", (F.col("_x") / F.col("width")).alias("image_x"), (F.col("_y") / F.col("height")).alias("image_y"), F.bround("_x").cast("int").alias("pixel_x"), F.bround("_y").cast("int").alias("pixel_y"))


def back_in_crop(x: Column, y: Column, box: Column, width: Column, height: Column, padding: float = PADDING) -> tuple[Column, Column]:
    """A place of the image (fractions) as fractions of a face's crop: the way back; null for a crop without extent."""
    crop = crop_box(box, width, height, padding)
    one = lambda v, size, k: F.try_divide(v * size - crop[k], crop[k + 2] - crop[k])
    return one(x, width, 0), one(y, height, 1)


def _dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def head_poses(points: DataFrame, key: str) -> DataFrame:
    """key, yaw, pitch, roll in degrees, problem: under weak perspective, from six of the points (index, pixel_x, pixel_y).

    The linear map from a generic head to the image is a least-squares fit: its normal matrix is that of the head alone, so that three sums of
    products for each axis of the image tell it. Its rows are made orthonormal, and a third one stands across them. problem is
    missing_landmarks or degenerate_landmarks, and the angles are null then; of repeated points of one index the mean counts.
    """
    head = np.array(list(HEAD.values()))
    head = head - head.mean(0)
    inverse = np.linalg.inv(head.T @ head)
    model = F.create_map(*(F.lit(x) for index, row in zip(HEAD, head.tolist(), strict=True) for x in (index, F.array(*map(F.lit, row)))))
    some = points.where(F.col("index").isin(*HEAD)).groupBy(key, "index").agg(F.avg("pixel_x").alias("x"), (-F.avg("pixel_y")).alias("y"))
    some = some.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("m", model[F.col("index")])
    sums = some.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(F.col("m")[k] * F.col(d)).alias(f"{d}{k}") for d in "xy" for k in range(3)))
    known = points.select(key).distinct().join(sums, key, "left")
    solved = {f"{d}row": F.array(*(sum((float(inverse[i, k]) * F.col(f"{d}{k}") for k in range(3)), F.lit(0.0)) for i in range(3))) for d in "xy"}
    known = known.withColumns(solved)
    vector = lambda c: [F.col(c)[k] for k in range(3)]
    unit = lambda c: F.when(F.sqrt(_dot(vector(c), vector(c))) > NONE, F.transform(c, lambda v: v / F.sqrt(_dot(vector(c), vector(c)))))
    known = known.withColumn("a", unit("xrow"))
    along = _dot(vector("yrow"), vector("a"))
    known = known.withColumn("_rest", F.zip_with("yrow", "a", lambda y, a: y - along * a)).withColumn("b", unit("_rest"))
    a, b = vector("a"), vector("b")
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    whole = F.coalesce(F.col("n"), F.lit(0)) == len(HEAD)
    angle = lambda y, x: F.when(whole, F.degrees(F.atan2(y, x)))
    flat = F.col("a").isNull() | F.col("b").isNull()
    return known.select(
        key, angle(-c[0], F.sqrt(a[0] * a[0] + b[0] * b[0])).alias("yaw"), angle(c[1], c[2]).alias("pitch"), angle(b[0], a[0]).alias("roll"),
        F.when(~whole, "missing_landmarks").when(flat, "degenerate_landmarks").alias("problem"),
    )


def five_points(points: DataFrame, key: str) -> DataFrame:
    """key, place (0 to 4), x, y: the middles of both eyes, the nose and the corners of the mouth, of the points (index, pixel_x, pixel_y)."""
    i = F.col("index")
    place = F.when(i.between(36, 41), 0).when(i.between(42, 47), 1).when(i == 30, 2).when(i == 48, 3).when(i == 54, 4)
    return points.where(place.isNotNull()).groupBy(key, place.alias("place")).agg(F.avg("pixel_x").alias("x"), F.avg("pixel_y").alias("y"))


def similarities(pairs: DataFrame, key: str) -> DataFrame:
    """key, n, a, b, tx, ty, error: the turn, growth and shift (x, y) -> (a x - b y + tx, b x + a y + ty) nearest to (u, v), and the mean squared distance left.

    pairs: key, x, y, u, v; pairs with a null are left out. a to error are null (problem: degenerate) where the points have no extent, as fewer than two have.
    """
    x, y, u, v = (F.col(c) for c in "xyuv")
    some = pairs.where(x.isNotNull() & y.isNotNull() & u.isNotNull() & v.isNotNull())
    total = {"sx": x, "sy": y, "su": u, "sv": v, "same": x * u + y * v, "cross": x * v - y * u, "size": x * x + y * y, "goal": u * u + v * v}
    sums = some.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in total.items()))
    s = {k: F.col(k) for k in ("n", *total)}
    extent = s["size"] - (s["sx"] * s["sx"] + s["sy"] * s["sy"]) / s["n"]
    fit = F.when(extent > NONE, extent)
    a, b = (s["same"] - (s["sx"] * s["su"] + s["sy"] * s["sv"]) / s["n"]) / fit, (s["cross"] - (s["sx"] * s["sv"] - s["sy"] * s["su"]) / s["n"]) / fit
    told = pairs.select(key).distinct().join(sums.withColumns({"a": a, "b": b}), key, "left")
    told = told.withColumns({"tx": (s["su"] - F.col("a") * s["sx"] + F.col("b") * s["sy"]) / s["n"], "ty": (s["sv"] - F.col("b") * s["sx"] - F.col("a") * s["sy"]) / s["n"]})
    # What is left of the goal's extent when the part that the map reaches is taken away.
    left = s["goal"] - (s["su"] * s["su"] + s["sv"] * s["sv"]) / s["n"] - (F.col("a") * F.col("a") + F.col("b") * F.col("b")) * extent
    return told.select(key, F.coalesce("n", F.lit(0)).alias("n"), "a", "b", "tx", "ty", F.when(F.col("a").isNotNull(), F.greatest(left / s["n"], F.lit(0.0))).alias("error"), F.when(F.col("a").isNull(), "degenerate").alias("problem"))


def inverse_map(a: Column, b: Column, tx: Column, ty: Column) -> Column:
    """Six numbers of the way back, (c0 u + c1 v + c2, c3 u + c4 v + c5): where each pixel of the aligned image comes from; null if all falls on one point."""
    size = F.nullif(a * a + b * b, F.lit(0.0))
    return F.when(size.isNotNull(), F.array(a / size, b / size, -(a * tx + b * ty) / size, -b / size, a / size, (b * tx - a * ty) / size))


def alignments(points: DataFrame, key: str, template: tuple = TEMPLATE) -> DataFrame:
    """key, n, a, b, tx, ty, error, problem, back: how each face's five points come to the template's, and the map back. A face without one of the five points is a problem (missing_landmarks)."""
    goal = F.create_map(*(F.lit(x) for k, uv in enumerate(template) for x in (k, F.array(*map(F.lit, uv)))))
    pairs = five_points(points, key).withColumn("_g", goal[F.col("place")])
    told = points.select(key).distinct().join(similarities(pairs.select(key, "x", "y", F.col("_g")[0].alias("u"), F.col("_g")[1].alias("v")), key), key, "left")
    whole = F.coalesce(F.col("n") == len(template), F.lit(False))
    told = told.select(key, F.coalesce("n", F.lit(0)).alias("n"), *(F.when(whole, F.col(c)).alias(c) for c in ("a", "b", "tx", "ty", "error")), F.when(~whole, "missing_landmarks").otherwise(F.col("problem")).alias("problem"))
    return told.withColumn("back", inverse_map(F.col("a"), F.col("b"), F.col("tx"), F.col("ty")))
