"""Named queries over faces as tables of points, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.faces import HEAD
from ..operators import landmarks
from ..sources.tables import table


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as what a detector of landmarks tells: 136 values around the middle, with a box and an image's size; every 17th face has all its points in one place."""
    k = F.col("vec_id")
    value = lambda i: F.when(k % 17 == 0, F.lit(0.5)).otherwise(F.lit(0.5) + F.get("embedding", ((i * 7 + 3) % 64).cast("int")).cast("double"))
    box = F.array((k % 10) / 20, (k % 7) / 20, (k % 10) / 20 + 0.4, (k % 7) / 20 + 0.5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(135)), value).alias("values"), box.alias("box"), (F.lit(640) + k % 3 * 100).cast("int").alias("width"), (F.lit(480) + k % 4 * 50).cast("int").alias("height"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landmarks of faces; every 19th face lacks the tip of its nose, every 23rd the corners of its mouth."""
    lost = ((F.col("vec_id") % 19 == 0) & (F.col("index") == 30)) | ((F.col("vec_id") % 23 == 0) & F.col("index").isin(48, 54))
    return landmarks.landmarks(faces(spark, sf_dir), "vec_id").where(~lost)


def face_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """68 points of each face in the crop, the image and whole pixels, and back in the crop."""
    rows = landmarks.landmarks(faces(spark, sf_dir), "vec_id", ("box", "width", "height"))
    x, y = landmarks.back_in_crop(F.col("image_x"), F.col("image_y"), F.col("box"), F.col("width"), F.col("height"))
    return rows.select("vec_id", F.col("index").cast("int").alias("index"), *(F.round(c, 7).alias(c) for c in ("crop_x", "crop_y", "image_x", "image_y")), "pixel_x", "pixel_y", F.round(x + 2e-10, 6).alias("back_x"), F.round(y + 2e-10, 6).alias("back_y"))  # what is exactly between two roundings goes up on both ways


def head_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = landmarks.head_poses(points(spark, sf_dir), "vec_id")
    return rows.select("vec_id", *(F.round(c, 5).alias(c) for c in ("yaw", "pitch", "roll")), "problem")


def face_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity that brings each face to the template, and where the aligned image's corners come from."""
    rows = landmarks.alignments(points(spark, sf_dir), "vec_id")
    back = lambda k, u, v: F.round(F.col("back")[k] * u + F.col("back")[k + 1] * v + F.col("back")[k + 2], 4)
    return rows.select("vec_id", "n", *(F.round(c, 6).alias(c) for c in ("a", "b", "tx", "ty")), F.round("error", 5).alias("error"), "problem", back(0, 0, 0).alias("left"), back(3, 0, 0).alias("top"), back(0, 112, 112).alias("right"), back(3, 112, 112).alias("bottom"))


QUERIES = {f.__name__: f for f in (face_landmarks, head_poses, face_alignments)}

_POINTS = """
f AS (SELECT vec_id AS id, embedding AS e, vec_id % 10 / 20 AS l, vec_id % 7 / 20 AS t, 640 + vec_id % 3 * 100 AS w, 480 + vec_id % 4 * 50 AS h FROM embeddings),
g AS (SELECT *, greatest(0, (l - 0.4 * 0.15) * w) AS x0, greatest(0, (t - 0.5 * 0.15) * h) AS y0, least(w, (l + 0.4 + 0.4 * 0.15) * w) AS x1, least(h, (t + 0.5 + 0.5 * 0.15) * h) AS y1 FROM f),
i AS (SELECT unnest(range(68)) AS i),
c AS (SELECT g.*, i.i, CASE WHEN id % 17 = 0 THEN 0.5 ELSE 0.5 + e[(i.i * 7 + 3) % 64 + 1]::DOUBLE END AS cx, CASE WHEN id % 17 = 0 THEN 0.5 ELSE 0.5 + e[((i.i + 68) * 7 + 3) % 64 + 1]::DOUBLE END AS cy FROM g, i),
p AS (SELECT *, x0 + cx * (x1 - x0) AS x, y0 + cy * (y1 - y0) AS y FROM c),
q AS (SELECT id, i, round_even(x, 0)::INT AS px, round_even(y, 0)::INT AS py FROM p WHERE NOT ((id % 19 = 0 AND i = 30) OR (id % 23 = 0 AND i IN (48, 54))))"""
_HEAD = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in HEAD.items())
_GOAL = ", ".join(f"({k}, {u}::DOUBLE, {v}::DOUBLE)" for k, (u, v) in enumerate(landmarks.TEMPLATE))

#: The affine fit by Cramer's rule, from sums over the points themselves.
_POSE = f"""WITH {_POINTS},
m AS (SELECT i, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, c - avg(c) OVER () AS c FROM (VALUES {_HEAD}) AS v(i, a, b, c)),
s AS (SELECT id, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * px) AS ax, sum(b * px) AS bx, sum(c * px) AS cx, sum(a * -py) AS ay, sum(b * -py) AS bz, sum(c * -py) AS cy FROM q JOIN m USING (i) GROUP BY id HAVING count(*) = 6),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
r AS (SELECT id, (ax * (bb * cc - bc * bc) - ab * (bx * cc - bc * cx) + ac * (bx * bc - bb * cx)) / det AS u1, (aa * (bx * cc - bc * cx) - ax * (ab * cc - bc * ac) + ac * (ab * cx - bx * ac)) / det AS u2, (aa * (bb * cx - bx * bc) - ab * (ab * cx - bx * ac) + ax * (ab * bc - bb * ac)) / det AS u3,
             (ay * (bb * cc - bc * bc) - ab * (bz * cc - bc * cy) + ac * (bz * bc - bb * cy)) / det AS v1, (aa * (bz * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - bz * ac)) / det AS v2, (aa * (bb * cy - bz * bc) - ab * (ab * cy - bz * ac) + ay * (ab * bc - bb * ac)) / det AS v3 FROM d),
n AS (SELECT *, sqrt(u1 * u1 + u2 * u2 + u3 * u3) AS size FROM r),
o AS (SELECT id, u1 / size AS u1, u2 / size AS u2, u3 / size AS u3, v1, v2, v3 FROM n WHERE size > 1e-8),
t AS (SELECT *, u1 * v1 + u2 * v2 + u3 * v3 AS k FROM o),
w AS (SELECT id, u1, u2, u3, v1 - k * u1 AS v1, v2 - k * u2 AS v2, v3 - k * u3 AS v3 FROM t),
x AS (SELECT *, sqrt(v1 * v1 + v2 * v2 + v3 * v3) AS size FROM w),
y AS (SELECT id, u1, u2, u3, v1 / size AS v1, v2 / size AS v2, v3 / size AS v3 FROM x WHERE size > 1e-8)
SELECT f.id AS vec_id, round(degrees(atan2(-(u2 * v3 - u3 * v2), sqrt(u1 * u1 + v1 * v1))), 5) AS yaw, round(degrees(atan2(u3 * v1 - u1 * v3, u1 * v2 - u2 * v1)), 5) AS pitch, round(degrees(atan2(v1, u1)), 5) AS roll,
       CASE WHEN s.id IS NULL THEN 'missing_landmarks' WHEN y.id IS NULL THEN 'degenerate_landmarks' END AS problem
FROM f LEFT JOIN s ON s.id = f.id LEFT JOIN y ON y.id = f.id"""

#: The fit by covariances around the means.
_ALIGN = f"""WITH {_POINTS},
z AS (SELECT id, CASE WHEN i BETWEEN 36 AND 41 THEN 0 WHEN i BETWEEN 42 AND 47 THEN 1 WHEN i = 30 THEN 2 WHEN i = 48 THEN 3 WHEN i = 54 THEN 4 END AS place, px, py FROM q),
five AS (SELECT id, place, avg(px) AS x, avg(py) AS y FROM z WHERE place IS NOT NULL GROUP BY ALL),
j AS (SELECT id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, u - avg(u) OVER w AS u, v - avg(v) OVER w AS v, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(u) OVER w AS mu, avg(v) OVER w AS mv FROM five JOIN (VALUES {_GOAL}) AS g(place, u, v) USING (place) WINDOW w AS (PARTITION BY id)),
k AS (SELECT id, count(*) AS n, sum(x * x + y * y) AS s, sum(x * u + y * v) AS c, sum(x * v - y * u) AS d, sum(u * u + v * v) AS g, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv FROM j GROUP BY id),
l AS (SELECT *, CASE WHEN n = 5 AND s > 1e-8 THEN c / s END AS a, CASE WHEN n = 5 AND s > 1e-8 THEN d / s END AS b FROM k),
m AS (SELECT *, mu - a * mx + b * my AS tx, mv - b * mx - a * my AS ty FROM l)
SELECT f.id AS vec_id, coalesce(n, 0) AS n, round(a, 6) AS a, round(b, 6) AS b, round(tx, 6) AS tx, round(ty, 6) AS ty, round((g - (a * a + b * b) * s) / n, 5) AS error,
       CASE WHEN coalesce(n, 0) < 5 THEN 'missing_landmarks' WHEN a IS NULL THEN 'degenerate' END AS problem,
       round((a * (0 - tx) + b * (0 - ty)) / (a * a + b * b), 4) AS "left", round((a * (0 - ty) - b * (0 - tx)) / (a * a + b * b), 4) AS top, round((a * (112 - tx) + b * (112 - ty)) / (a * a + b * b), 4) AS "right", round((a * (112 - ty) - b * (112 - tx)) / (a * a + b * b), 4) AS bottom
FROM f LEFT JOIN m ON m.id = f.id"""

ORACLES = {
    "face_landmarks": f"""WITH {_POINTS} SELECT id AS vec_id, i::INT AS "index", round(cx, 7) AS crop_x, round(cy, 7) AS crop_y, round(x / w, 7) AS image_x, round(y / h, 7) AS image_y, round_even(x, 0)::INT AS pixel_x, round_even(y, 0)::INT AS pixel_y, round(cx + 2e-10::DOUBLE, 6) AS back_x, round(cy + 2e-10::DOUBLE, 6) AS back_y FROM p""",
    "head_poses": _POSE,
    "face_alignments": _ALIGN,
}
