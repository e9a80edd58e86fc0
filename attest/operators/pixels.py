"""Images as tables of lines (image, y, values: gray pixels of one line): zones by running sums, patches by sums and cross sums.

A line is what a row holds; images of any height are spread over rows, and what must meet, meets by the image's key. Decisions over an image
are sums over its lines, so that each line is read once and shuffles carry numbers, not pixels, wherever pixels do not have to meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.let import let, settled

# --- zones ---

#: A stroke is a change over two pixels of this part of the image's range; a line is busy from this many strokes a pixel on; a zone spans this much of the width.
STROKE, BUSY, SPAN = 0.2, 0.03, 0.5
#: Windows down an image; the smallest image looked at (height, width); margin of a box and distance of two boxes, in parts of the image.
STEPS, SMALLEST, MARGIN, APART = 100, (20, 80), 0.015, 0.08


def line_changes(lines: DataFrame) -> DataFrame:
    """image, y, width, low, high, changes: the range of grays of a line, and its changes over two pixels by their size (by, from 1 on): how many there are, and where the first and last of them are."""
    image = lines.schema["image"].dataType.simpleString()
    names = ["image", "y", "width", "low", "high", "changes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(2)
            width = np.array(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), width)
            # A missing gray is nan, and so is a change from or to it.
            own = flat[np.isfinite(flat)]
            of = row[np.isfinite(flat)]
            low, high = np.full(b.num_rows, np.inf), np.full(b.num_rows, -np.inf)
            np.minimum.at(low, of, own)
            np.maximum.at(high, of, own)
            by = np.abs(flat[2:] - flat[:-2])
            at = np.flatnonzero((row[2:] == row[:-2]) & (by >= 1))
            place = at - (np.cumsum(width) - width)[row[at]] + 1
            sizes, kind = np.unique(by[at], return_inverse=True)
            key = row[at] * max(len(sizes), 1) + kind
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.diff(key[order], prepend=-1))
            end = np.append(start[1:], len(order))[: len(start)]
            parts = [pa.array(x) for x in (sizes[kind[order[start]]], end - start, place[order[start]], place[order[end - 1]])]
            ends = np.append(0, np.cumsum(np.bincount(row[at][order[start]], minlength=b.num_rows))).astype(np.int32)
            changes = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=["by", "n", "first", "last"]))
            bare = low > high
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(width.astype(np.int32)), pa.array(low, mask=bare), pa.array(high, mask=bare), changes], names=names)

    kind = f"image {image}, y {lines.schema['y'].dataType.simpleString()}, width int, low double, high double, changes array<struct<by double, n bigint, first bigint, last bigint>>"
    return lines.select("image", "y", "values").mapInArrow(run, kind)


def line_strokes(lines: DataFrame) -> DataFrame:
    """image, y, width, n, first, last: the changes of a line that count as strokes, by the range of grays of its image, and where the first and last of them are. Pixels are not shuffled, but counts of changes."""
    whole = Window.partitionBy("image")
    own = line_changes(lines).withColumns({"low": F.min("low").over(whole), "high": F.max("high").over(whole)})
    least = F.greatest((F.col("high") - F.col("low")) * STROKE, F.lit(1.0))
    own = own.select("image", "y", "width", F.explode(F.array(F.filter("changes", lambda c: c["by"] >= least))).alias("c"))
    pick = lambda name, of: F.coalesce(of(F.transform("c", lambda c: c[name])), F.lit(0))
    return own.select("image", "y", "width", F.aggregate("c", F.lit(0).cast("bigint"), lambda s, c: s + c["n"]).alias("n"), pick("first", F.array_min).alias("first"), pick("last", F.array_max).alias("last"))


def zones(lines: DataFrame, wanted: DataFrame, most: int = 2) -> DataFrame:
    """image, boxes: where a machine-readable zone may lie, the likeliest first and none within APART of a better one; boxes of fractions, at most `most`.

    lines: image, y (0, 1, ..), values. wanted: image, rows (lines of the zone), ratios (heights to try, see mrz.search_ratios), width_ratio and height_ratio of the
    expected zone, or null. A window is worth the part of its lines that are busy, times the square of the part of the strokes around it (half its
    height on both sides) that lie inside, times the part of the width that its busy lines span: a zone is dense, wide, and ends where the window
    does. An expected shape takes off up to half for each side that differs. Images under SMALLEST, and those without lines, have no boxes.

    Running sums of strokes, busy lines and their edges tell any window from four places, so that all windows of an image cost one pass.
    """
    busy = (F.col("n") > 0) & (F.col("n") >= BUSY * F.col("width"))
    down = Window.partitionBy("image").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"ns": F.col("n"), "busy": busy.cast("int"), "lefts": F.when(busy, F.col("first")).otherwise(0), "rights": F.when(busy, F.col("last") + 1).otherwise(0)}
    running = line_strokes(lines).withColumns({k: F.sum(c).over(down) for k, c in sums.items()})
    image = running.groupBy("image").agg(F.max("width").alias("w"), F.count("*").cast("int").alias("h"), F.array_sort(F.collect_list(F.struct("y", *sums))).alias("s"))
    rows = settled(wanted.select("image", "rows", "ratios", "width_ratio", "height_ratio").join(image, "image", "left"))
    h, w = F.col("h"), F.col("w")

    def until(y: Column, what: str) -> Column:
        """The sum over the lines before y."""
        return F.coalesce(F.get("s", y.cast("int") - 1)[what], F.lit(0))

    def window(top: Column, bottom: Column) -> Column:
        """What lies in a window and around it: numbers alone go on from here, no sums of the image."""
        half = F.floor((bottom - top) / 2).cast("int")
        inside = [(until(bottom, what) - until(top, what)).alias(name) for what, name in (("ns", "n"), ("busy", "busy"), ("lefts", "lefts"), ("rights", "rights"))]
        return F.struct(top.alias("top"), bottom.alias("bottom"), *inside, (until(F.least(h, bottom + half), "ns") - until(F.greatest(F.lit(0), top - half), "ns")).alias("around"))

    def windows(tall: Column) -> Column:
        return F.when(tall < h, F.transform(F.sequence(F.lit(0), h - tall, F.greatest(F.lit(1), F.floor(h / STEPS).cast("int"))), lambda top: window(top, top + tall)))

    fits = (h >= SMALLEST[0]) & (w >= SMALLEST[1])
    talls = F.array_distinct(F.transform("ratios", lambda ratio: F.greatest(F.col("rows") * 8, F.bround(h * ratio).cast("int"))))
    each = rows.where(fits).select("image", "h", "w", "width_ratio", "height_ratio", F.explode(F.flatten(F.array_compact(F.transform(talls, windows)))).alias("at"))
    told = each.select("image", "h", "w", "width_ratio", "height_ratio", "at.*").where(F.col("busy") > 0)
    top, bottom = F.col("top"), F.col("bottom")
    told = told.select("image", "h", "w", "width_ratio", "height_ratio", top.alias("top"), bottom.alias("bottom"), (F.col("lefts") / F.col("busy")).alias("left"), (F.col("rights") / F.col("busy")).alias("right"), (F.col("busy") / (bottom - top)).alias("dense"), (F.col("n") / F.col("around")).alias("held"))
    cover, height = (F.col("right") - F.col("left")) / F.col("w"), (F.col("bottom") - F.col("top")) / F.col("h")
    near = lambda found, expected: F.coalesce(1 - F.least(F.lit(1.0), F.abs(found - expected) / expected) / 2, F.lit(1.0))
    worth = F.col("dense") * F.col("held") * F.col("held") * cover * near(cover, F.col("width_ratio")) * near(height, F.col("height_ratio"))
    needed = F.coalesce(F.col("width_ratio") * SPAN / 0.8, F.lit(SPAN))
    box = F.array(F.greatest(F.lit(0.0), F.col("left") / F.col("w") - MARGIN), F.greatest(F.lit(0.0), F.col("top") / F.col("h") - MARGIN), F.least(F.lit(1.0), F.col("right") / F.col("w") + MARGIN), F.least(F.lit(1.0), F.col("bottom") / F.col("h") + MARGIN))
    found = told.where(cover >= needed).groupBy("image").agg(F.array_sort(F.collect_list(F.struct((-F.round(worth, 9)).alias("neg"), (-F.col("bottom")).alias("low"), "top", ((F.col("top") + F.col("bottom")) / 2 / F.col("h")).alias("middle"), box.alias("box")))).alias("all"))
    apart = lambda kept, x: F.forall(kept, lambda k: F.abs(k["middle"] - x["middle"]) >= APART)
    chosen = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when((F.size(kept) < most) & apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    none = F.array().cast("array<array<double>>")
    return wanted.select("image").join(found.select("image", F.transform(chosen, lambda x: x["box"]).alias("boxes")), "image", "left").select("image", F.coalesce("boxes", none).alias("boxes"))


# --- patches ---

#: Scales and shifts (in parts of the box) at which a patch is looked for, in this order, and the weights of what is compared (fixed values).
SCALES, SHIFTS = (0.9, 1.0, 1.1), (-0.2, -0.1, 0.0, 0.1, 0.2)
INTENSITY, GRADIENT, DIFFERENCE = 0.35, 0.45, 0.20
KEY = ("image", "patch")


def patch_places(rows: DataFrame) -> DataFrame:
    """rows (with bounds, height and width of the image) times the boxes in whole pixels at which a patch is looked for: place (from 0), scale, dx, dy, box; those under two pixels are left out."""
    looks = [(k, s, x, y) for k, (s, x, y) in enumerate((s, x, y) for s in SCALES for x in SHIFTS for y in SHIFTS)]
    each = rows.withColumn("_p", F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(s).alias("scale"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for k, s, x, y in looks))))
    p, b = F.col("_p"), F.col("bounds")

    def side(k: int, shift: str, size: Column) -> tuple[Column, Column]:
        middle = ((b[k] + b[k + 2]) / 2 + p[shift] * (b[k + 2] - b[k])) * size
        long = (b[k + 2] - b[k]) * size * p["scale"]
        return F.greatest(F.lit(0), F.bround(middle - long / 2).cast("int")), F.least(size.cast("int"), F.bround(middle + long / 2).cast("int"))

    (l, r), (t, d) = side(0, "dx", F.col("width")), side(1, "dy", F.col("height"))
    each = settled(each.select(*rows.columns, "_p.*", F.array(l, t, r, d).alias("box")))
    return each.where((F.col("box")[2] - F.col("box")[0] >= 2) & (F.col("box")[3] - F.col("box")[1] >= 2))


def _taps(i: Column, size: Column, goal: Column) -> Column:
    """Where pixel i of `goal` lies among `size` pixels whose middles are aligned: the two pixels around it and the second one's weight."""
    at = F.greatest(F.least((i + 0.5) * size / goal - 0.5, (size - 1).cast("double")), F.lit(0.0))
    return let(at, lambda x: F.struct(F.floor(x).cast("int").alias("a"), F.least(F.floor(x).cast("int") + 1, size - 1).alias("b"), (x - F.floor(x)).alias("f")))


def patch_lines(places: DataFrame, lines: DataFrame, patches: DataFrame) -> DataFrame:
    """image, patch, place, p, reference, candidate: line p of a patch, and what the image has there, brought to the patch's size (bilinear, to whole grays).

    Two lines of the image make one; they meet by image and y, so that an image is never held whole.
    """
    sizes = patches.groupBy("patch").agg(F.count("*").cast("int").alias("_h"), F.max(F.size("values")).alias("_w"))
    each = places.join(sizes, "patch").select(*KEY, "place", "box", "_w", "_h", F.explode(F.sequence(F.lit(0), F.col("_h") - 1)).alias("p"))
    each = settled(each.withColumn("_t", _taps(F.col("p"), F.col("box")[3] - F.col("box")[1], F.col("_h"))))
    upper = lines.select("image", F.col("y").alias("_ya"), F.col("values").alias("_va"))
    lower = lines.select("image", F.col("y").alias("_yb"), F.col("values").alias("_vb"))
    each = each.withColumns({"_ya": F.col("box")[1] + F.col("_t.a"), "_yb": F.col("box")[1] + F.col("_t.b")})
    met = each.join(upper, ["image", "_ya"]).join(lower, ["image", "_yb"])
    left, wide = F.col("box")[0], F.col("box")[2] - F.col("box")[0]
    across = lambda v, t: (1 - t["f"]) * F.get(v, left + t["a"]) + t["f"] * F.get(v, left + t["b"])
    blend = lambda t: F.floor((1 - F.col("_t.f")) * across("_va", t) + F.col("_t.f") * across("_vb", t) + 0.5).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda q: let(_taps(q, wide, F.col("_w")), blend))
    met = met.select(*KEY, "place", "p", made.alias("candidate"))
    return met.join(patches.select("patch", F.col("y").alias("p"), F.col("values").alias("reference")), ["patch", "p"]).select(*KEY, "place", "p", "reference", "candidate")


def _slopes(own: str, above: str, below: str) -> Column:
    """How steep a line's pixels are: half the difference of the neighbours both ways, whole at an edge."""
    n = F.size(own)

    def one(v: Column, i: Column) -> Column:
        left, right = F.coalesce(F.get(own, i - 1), v), F.coalesce(F.get(own, i + 1), v)
        up, down = F.coalesce(F.get(above, i), v), F.coalesce(F.get(below, i), v)
        x = (right - left) / F.when((i == 0) | (i == n - 1), 1.0).otherwise(2.0)
        y = (down - up) / F.when(F.col(above).isNull() | F.col(below).isNull(), 1.0).otherwise(2.0)
        return F.sqrt(x * x + y * y)

    return F.transform(own, one)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def correlation(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column, same: Column) -> Column:
    """From sums and cross sums; where one side is flat, 1 if all are the same and 0 if not."""
    size = F.sqrt(F.greatest(aa - a * a / n, F.lit(0.0)) * F.greatest(bb - b * b / n, F.lit(0.0)))
    return F.when(size <= 1e-6, same.cast("double")).otherwise(F.least(F.greatest((ab - a * b / n) / size, F.lit(-1.0)), F.lit(1.0)))


def patch_scores(rows: DataFrame) -> DataFrame:
    """Of patch_lines(): image, patch, place, score, intensity, gradient, near. A line gives its sums, and a place is told from the sums of its lines."""
    w = Window.partitionBy(*KEY, "place").orderBy("p")
    for side in ("reference", "candidate"):
        rows = rows.withColumns({f"_{side}_up": F.lag(side).over(w), f"_{side}_down": F.lead(side).over(w)})
    slopes = {f"_{s}": _slopes(s, f"_{s}_up", f"_{s}_down") for s in ("reference", "candidate")}
    steep = settled(rows.select(*KEY, "place", "reference", "candidate", *(v.alias(k) for k, v in slopes.items())))
    product = lambda a, b: _total(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))
    one = {"n": F.size("reference")}
    for mark, a, b in (("i", "reference", "candidate"), ("g", "_reference", "_candidate")):
        one |= {f"{mark}a": _total(F.col(a)), f"{mark}b": _total(F.col(b)), f"{mark}aa": product(a, a), f"{mark}bb": product(b, b), f"{mark}ab": product(a, b), f"{mark}same": (F.col(a) == F.col(b)).cast("int")}
    one["off"] = _total(F.zip_with("reference", "candidate", lambda x, y: F.abs(x - y).cast("double")))
    sums = steep.groupBy(*KEY, "place").agg(*((F.min(c) if k.endswith("same") else F.sum(c)).alias(k) for k, c in one.items()))
    c = F.col
    told = {m: correlation(c("n"), c(f"{m}a"), c(f"{m}b"), c(f"{m}aa"), c(f"{m}bb"), c(f"{m}ab"), c(f"{m}same")) for m in "ig"}
    out = sums.select(*KEY, "place", told["i"].alias("intensity"), told["g"].alias("gradient"), (1 - c("off") / c("n") / 255).alias("near"))
    score = INTENSITY * (c("intensity") + 1) / 2 + GRADIENT * (c("gradient") + 1) / 2 + DIFFERENCE * c("near")
    return out.withColumn("score", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 9))


def matched_patches(images: DataFrame, lines: DataFrame, bounds: DataFrame, patches: DataFrame) -> DataFrame:
    """image, patch, candidates, place, scale, dx, dy, box, score, intensity, gradient, near: the place most like each patch of an image's layout, the first of those that agree to nine digits.

    images: image, layout, height, width. lines: image, y, values. bounds: layout, patch, bounds (fractions). patches: patch, y, values. A patch whose
    bounds give no box of two pixels either way has no row.
    """
    places = patch_places(images.join(bounds, "layout").select("image", "patch", "bounds", "height", "width"))
    scores = patch_scores(patch_lines(places, lines, patches))
    best = scores.groupBy(*KEY).agg(F.count("*").alias("candidates"), F.max_by(F.struct("place", "score", "intensity", "gradient", "near"), F.struct("score", -F.col("place"))).alias("b"))
    return best.select(*KEY, "candidates", "b.*").join(places.select(*KEY, "place", "scale", "dx", "dy", "box"), [*KEY, "place"])
