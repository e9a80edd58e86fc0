"""Named queries over images as tables of lines, and their SQL. The lines are texts that one SQL text makes in both engines: a character is a gray."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels
from ..sources.tables import numbered, table
from .payloads import dice, made, pick, quoted, view

_ZONE, _PLAIN = "o_orderkey", "p_partkey"
#: 40 orders are an image of 40 lines of 96 grays: dark strokes in two bands of five lines, at a height and with edges that depend on the image; marks and noise elsewhere.
_IMAGE = "CAST(floor(k / 40) AS BIGINT)"
_LINES = f"""SELECT image, y, CASE WHEN style > 0 AND ((y >= z AND y < z + 5) OR (y >= z + 7 AND y < z + 12)) THEN substr(concat(repeat('~', edge), repeat(stroke, 24), repeat('~', 96)), 1, 96)
    WHEN mark = 0 THEN concat(repeat('~', 30 + z), '##~#', repeat('~', 62 - z)) WHEN mark = 1 THEN repeat('n~n', 32) ELSE repeat('~', 96) END AS grays
  FROM (SELECT {_IMAGE} AS image, k % 40 AS y, {dice('k', 'm', 9)} AS mark, {dice(_IMAGE, 'z', 27)} AS z, {dice(_IMAGE, 'e', 12)} AS edge, {dice(_IMAGE, 's', 5)} AS style, {pick(quoted(['#~~#', '#~', '##~~', '#~~~']), _IMAGE, 't')} AS stroke
    FROM {{numbered}} AS o) AS p"""
PAGES = _LINES.replace("{numbered}", f"(SELECT row_number() OVER (ORDER BY {_ZONE}) - 1 AS k FROM {{orders}})")
#: 20 parts are an image of 20 lines of 20 grays; those of layout k are looked at for a patch of image k, 6 lines of 8.
TILES = f"SELECT CAST(floor(({_PLAIN} - 1) / 20) AS BIGINT) AS image, ({_PLAIN} - 1) % 20 AS y, substr(md5(CAST({_PLAIN} AS STRING)), 1, 20) AS grays FROM {{part}}"
BOUNDS = (0.25, 0.3, 0.65, 0.6)
RATIOS = (0.3, 0.4, 0.45)


def grays(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))))


def gray_lines(rows: DataFrame) -> DataFrame:
    """image, y, values, of rows (image, y, grays as a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(2).fill_null("").to_pylist()
            values = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
            ends = np.append(0, np.cumsum(np.fromiter(map(len, text), np.int64, len(text)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["image", "y", "values"])

    return rows.select("image", F.col("y").cast("int").alias("y"), "grays").mapInArrow(run, f"image {rows.schema['image'].dataType.simpleString()}, y int, values array<int>")


def zone_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where zones of two lines may lie: heights to try, and the expected shape for every other image."""
    rows = spark.sql(_LINES, numbered=numbered(table(spark, sf_dir, "orders").select(_ZONE), _ZONE))
    lines = gray_lines(rows)
    known = F.col("image") % 2 == 0
    wanted = rows.select("image").distinct().select("image", F.lit(2).alias("rows"), F.array(*map(F.lit, RATIOS)).alias("ratios"), F.when(known, 0.8).alias("width_ratio"), F.when(known, 0.3).alias("height_ratio"))
    found = pixels.zones(lines, wanted).select("image", F.posexplode("boxes").alias("place", "b"))
    return found.select("image", F.col("place").cast("int").alias("place"), *(F.round(F.col("b")[k], 6).alias(name) for k, name in enumerate(("left", "top", "right", "bottom"))))


def patch_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place most like the patch of each image's layout, among 75, with what was compared."""
    lines = made(spark, sf_dir, TILES).select("image", F.col("y").cast("int").alias("y"), grays(F.col("grays")).alias("values"))
    images = lines.groupBy("image").agg(F.max(F.size("values")).alias("width"), F.count("*").cast("int").alias("height")).withColumn("layout", F.col("image") % 3)
    patches = lines.where((F.col("image") < 3) & F.col("y").between(6, 11)).select(F.col("image").alias("patch"), (F.col("y") - 6).alias("y"), F.slice("values", 6, 8).alias("values"))
    bounds = patches.select(F.col("patch").alias("layout"), "patch").distinct().withColumn("bounds", F.array(*map(F.lit, BOUNDS)))
    found = pixels.matched_patches(images, lines, bounds, patches)
    return found.select("image", "patch", "candidates", "place", "scale", "dx", "dy", F.array_join(F.transform("box", lambda x: x.cast("string")), ",").alias("box"), *(F.round(c, 7).alias(c) for c in ("score", "intensity", "gradient", "near")))


QUERIES = {f.__name__: f for f in (zone_regions, patch_matches)}

_ZONES = f"""WITH l AS (SELECT image, y, [ascii(substr(grays, i, 1)) for i in range(1, 97)] AS v FROM ({view(PAGES)})),
r AS (SELECT image, greatest((max(list_max(v)) - min(list_min(v))) * {pixels.STROKE}::DOUBLE, 1) AS least, count(*) AS h FROM l GROUP BY image),
c AS (SELECT image, y, h, [abs(v[i + 2] - v[i]) >= least for i in range(1, 95)] AS c FROM l JOIN r USING (image)),
n AS (SELECT image, y, h, len(list_filter(c, lambda x: x)) AS n, list_position(c, true) AS a, 95 - list_position(list_reverse(c), true) + 1 AS z FROM c),
b AS (SELECT *, n > 0 AND n >= {pixels.BUSY}::DOUBLE * 96 AS busy FROM n),
t AS (SELECT image, h, greatest(16, round_even(h * ratio, 0)::INT) AS tall, image % 2 = 0 AS known FROM r, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in RATIOS)}]) AS ratio) WHERE h >= 20),
w AS (SELECT DISTINCT image, h, known, unnest(range(0, h - tall + 1)) AS top, tall FROM t WHERE tall < h),
s AS (SELECT w.image, w.h, known, top, top + tall AS bottom, sum(n) FILTER (y >= top AND y < top + tall) AS n, count(*) FILTER (busy AND y >= top AND y < top + tall) AS busy, sum(a) FILTER (busy AND y >= top AND y < top + tall) AS a, sum(z) FILTER (busy AND y >= top AND y < top + tall) AS z, sum(n) AS around
  FROM w JOIN b ON b.image = w.image AND y >= top - tall // 2 AND y < top + tall + tall // 2 GROUP BY ALL),
m AS (SELECT *, a / busy AS l, z / busy AS r, busy / (bottom - top) AS dense, n / around AS held FROM s WHERE busy > 0),
e AS (SELECT *, (r - l) / 96 AS cover, (bottom - top) / h AS high FROM m),
f AS (SELECT *, round(dense * held * held * cover * CASE WHEN known THEN 1 - least(1, abs(cover - 0.8::DOUBLE) / 0.8::DOUBLE) / 2 ELSE 1 END * CASE WHEN known THEN 1 - least(1, abs(high - 0.3::DOUBLE) / 0.3::DOUBLE) / 2 ELSE 1 END, 9) AS worth, (top + bottom) / 2 / h AS middle FROM e WHERE cover >= {pixels.SPAN}),
g AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY worth DESC, bottom DESC, top) AS k FROM f),
one AS (SELECT * FROM g WHERE k = 1),
two AS (SELECT g.*, row_number() OVER (PARTITION BY g.image ORDER BY g.k) AS j FROM g JOIN one ON one.image = g.image WHERE abs(g.middle - one.middle) >= {pixels.APART}::DOUBLE),
u AS (SELECT image, 0 AS place, l, top, r, bottom, h FROM one UNION ALL SELECT image, 1, l, top, r, bottom, h FROM two WHERE j = 1)
SELECT image, place::INT AS place, round(greatest(0, l / 96 - {pixels.MARGIN}::DOUBLE), 6) AS "left", round(greatest(0, top / h - {pixels.MARGIN}::DOUBLE), 6) AS top, round(least(1, r / 96 + {pixels.MARGIN}::DOUBLE), 6) AS "right", round(least(1, bottom / h + {pixels.MARGIN}::DOUBLE), 6) AS bottom FROM u"""

_list = lambda values: "[" + ", ".join(f"{x}::DOUBLE" for x in values) + "]"
_tap = "greatest(least(({0} + 0.5::DOUBLE) * {1} / {2} - 0.5::DOUBLE, ({1} - 1)::DOUBLE), 0::DOUBLE)"
_corr = "CASE WHEN sqrt(greatest(n * {0}aa - {0}a * {0}a, 0) * greatest(n * {0}bb - {0}b * {0}b, 0)) / n <= 1e-6 THEN {0}same::INT::DOUBLE ELSE greatest(-1, least(1, (n * {0}ab - {0}a * {0}b) / sqrt((n * {0}aa - {0}a * {0}a) * (n * {0}bb - {0}b * {0}b)))) END"
_PATCHES = f"""WITH l AS (SELECT image, y, [ascii(substr(grays, i, 1)) for i in range(1, 21)] AS v FROM ({view(TILES)})),
i AS (SELECT image, count(*) AS h, 20 AS w, image % 3 AS patch FROM l GROUP BY image),
t AS (SELECT image AS patch, y - 6 AS p, q, v[q + 6] AS v FROM l, (SELECT unnest(range(8)) AS q) WHERE image < 3 AND y BETWEEN 6 AND 11),
k AS (SELECT a * 25 + b * 5 + c AS place, {_list(pixels.SCALES)}[a + 1] AS scale, {_list(pixels.SHIFTS)}[b + 1] AS dx, {_list(pixels.SHIFTS)}[c + 1] AS dy FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(5)) AS b), (SELECT unnest(range(5)) AS c)),
b AS (SELECT i.*, k.*, {_list(BOUNDS)} AS b FROM i, k),
m AS (SELECT *, ((b[1] + b[3]) / 2 + dx * (b[3] - b[1])) * w AS mx, ((b[2] + b[4]) / 2 + dy * (b[4] - b[2])) * h AS my, (b[3] - b[1]) * w * scale AS lx, (b[4] - b[2]) * h * scale AS ly FROM b),
x AS (SELECT image, patch, place, scale, dx, dy, greatest(0, round_even(mx - lx / 2, 0)::INT) AS l, greatest(0, round_even(my - ly / 2, 0)::INT) AS t, least(w, round_even(mx + lx / 2, 0)::INT) AS r, least(h, round_even(my + ly / 2, 0)::INT) AS d FROM m),
z AS (SELECT * FROM x WHERE r - l >= 2 AND d - t >= 2),
g AS (SELECT z.*, p, q, t.v AS ref, {_tap.format('p', '(d - z.t)', 6)} AS fy, {_tap.format('q', '(r - l)', 8)} AS fx FROM z JOIN t ON t.patch = z.patch),
o AS (SELECT g.*, floor(fy)::INT AS y0, least(floor(fy)::INT + 1, d - g.t - 1) AS y1, floor(fx)::INT AS x0, least(floor(fx)::INT + 1, r - g.l - 1) AS x1 FROM g),
s AS (SELECT o.image, o.patch, place, scale, dx, dy, o.l, o.t, r, d, p, q, ref, floor((1 - (fy - y0)) * ((1 - (fx - x0)) * a.v[o.l + x0 + 1] + (fx - x0) * a.v[o.l + x1 + 1]) + (fy - y0) * ((1 - (fx - x0)) * e.v[o.l + x0 + 1] + (fx - x0) * e.v[o.l + x1 + 1]) + 0.5)::INT AS own
  FROM o JOIN l AS a ON a.image = o.image AND a.y = o.t + y0 JOIN l AS e ON e.image = o.image AND e.y = o.t + y1),
u AS (SELECT *, (coalesce(lead(ref) OVER h, ref) - coalesce(lag(ref) OVER h, ref)) / CASE WHEN q IN (0, 7) THEN 1 ELSE 2 END AS rx, (coalesce(lead(ref) OVER v, ref) - coalesce(lag(ref) OVER v, ref)) / CASE WHEN p IN (0, 5) THEN 1 ELSE 2 END AS ry,
  (coalesce(lead(own) OVER h, own) - coalesce(lag(own) OVER h, own)) / CASE WHEN q IN (0, 7) THEN 1 ELSE 2 END AS ox, (coalesce(lead(own) OVER v, own) - coalesce(lag(own) OVER v, own)) / CASE WHEN p IN (0, 5) THEN 1 ELSE 2 END AS oy FROM s
  WINDOW h AS (PARTITION BY image, place, p ORDER BY q), v AS (PARTITION BY image, place, q ORDER BY p)),
c AS (SELECT *, sqrt(rx * rx + ry * ry) AS ga, sqrt(ox * ox + oy * oy) AS gb FROM u),
n AS (SELECT image, patch, place, scale, dx, dy, l, t, r, d, count(*) AS n, sum(ref) AS ia, sum(own) AS ib, sum(ref * ref) AS iaa, sum(own * own) AS ibb, sum(ref * own) AS iab, bool_and(ref = own) AS isame, sum(ga) AS ga, sum(gb) AS gb, sum(ga * ga) AS gaa, sum(gb * gb) AS gbb, sum(ga * gb) AS gab, bool_and(ga = gb) AS gsame, sum(abs(ref - own)) AS off FROM c GROUP BY ALL),
j AS (SELECT *, {_corr.format('i')} AS intensity, {_corr.format('g')} AS gradient, 1 - off / n / 255 AS near FROM n),
y AS (SELECT *, round(greatest(0, least(1, {pixels.INTENSITY} * (intensity + 1) / 2 + {pixels.GRADIENT} * (gradient + 1) / 2 + {pixels.DIFFERENCE} * near)), 9) AS score, count(*) OVER (PARTITION BY image) AS candidates FROM j),
best AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, place) AS k FROM y)
SELECT image, patch, candidates, place::INT AS place, scale, dx, dy, concat_ws(',', l, t, r, d) AS box, round(score, 7) AS score, round(intensity, 7) AS intensity, round(gradient, 7) AS gradient, round(near, 7) AS near FROM best WHERE k = 1"""

ORACLES = {"zone_regions": _ZONES, "patch_matches": _PATCHES}
