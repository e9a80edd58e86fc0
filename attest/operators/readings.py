"""Readings and the specifications they are made from: which crops to read, which model reads them, which reading counts.

A reading has doc_id, no (its place among those of the document), lines, confidences. Specifications are small tables, joined
to documents and handed to `observe`; what comes back is ranked here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mrz, national, vectors
from ..functions.policy import same_person, verification_decision
from ..sources.tables import written


def total(confidences: Column) -> Column:
    return F.aggregate(confidences, F.lit(0.0), lambda s, x: s + x)


def best_readings(readings: DataFrame, name: str) -> DataFrame:
    """Of a document's readings of one format: most valid checks, then lines of exact length, then the greatest confidence, then the first. Columns are those of readings, and checks."""
    f = mrz.FORMATS[name]
    lines = mrz.normalised(F.col("lines"), three=f.lines == 3)
    scored = readings.withColumns({"checks": mrz.score(lines, name), "_exact": ((F.size(lines) == f.lines) & F.forall(lines, lambda x: F.length(x) == f.width)).cast("int"), "_sum": total(F.col("confidences"))})
    keep = [*readings.columns, "checks"]
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct(*(c for c in keep if c != "doc_id")), F.struct("checks", "_exact", "_sum", -F.col("no"))).alias("b"))
    return best.select("doc_id", "b.*")


def best_two_line(readings: DataFrame) -> DataFrame:
    """As best_readings, whichever two-line format a reading fits best; with valid, whether all its checks hold."""
    lines = mrz.normalised(F.col("lines"), three=False)
    scored = readings.withColumns({"checks": mrz.two_line_score(lines), "_sum": total(F.col("confidences")), "valid": mrz.fully_valid(lines)})
    keep = [*readings.columns, "checks", "valid"]
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct(*(c for c in keep if c != "doc_id")), F.struct("checks", "_sum", -F.col("no"))).alias("b"))
    return best.select("doc_id", "b.*")


def staged(documents: DataFrame, stages: list, best) -> DataFrame:
    """Best readings of documents, stage by stage: each stage (a function of open documents to readings) runs only for documents that no stage before has read fully valid; of all stages' best the one with most checks counts, the earlier of equal ones."""
    found, left = None, documents
    for k, stage in enumerate(stages):
        own = best(stage(left)).withColumn("stage", F.lit(k))
        found = own if found is None else found.unionByName(own)
        left = left.join(own.where(F.col("valid")).select("doc_id"), "doc_id", "left_anti")
    rest = [c for c in found.columns if c != "doc_id"]
    return found.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct("checks", -F.col("stage"))).alias("b")).select("doc_id", "b.*")


#: Where a passport's lines are looked for down the page (fixed values): tops and heights of the first, how far below it and how high the second is, and where a band must end.
FIRST_TOPS, FIRST_HEIGHTS = (0.72, 0.75, 0.78, 0.81, 0.84, 0.87, 0.90), (0.045, 0.055, 0.065)
SECOND_OFFSETS, SECOND_HEIGHTS, SECOND_END = (0.055, 0.065, 0.075, 0.085), (0.055, 0.065), 0.995


def first_line_specs(documents: DataFrame, tops: tuple[float, ...] = FIRST_TOPS, heights: tuple[float, ...] = FIRST_HEIGHTS) -> DataFrame:
    """doc_id, no, top, height: the bands that a document's first line is looked for in."""
    every = [(float(t), float(h)) for t in tops for h in heights]
    bands = F.array(*(F.struct(F.lit(k).alias("no"), F.lit(t).alias("top"), F.lit(h).alias("height")) for k, (t, h) in enumerate(every)))
    return documents.select("doc_id", F.inline(bands))


def first_line_bands(readings: DataFrame, keep: int = 4) -> DataFrame:
    """The likeliest first lines of a passport zone: one that begins with P, of a length near 44, with most fillers, read surest, of the lowest and then the highest band."""
    x = F.replace(F.upper("text"), F.lit(" "), F.lit("<"))
    fillers = F.length(x) - F.length(F.replace(x, F.lit("<"), F.lit("")))
    w = Window.partitionBy("doc_id").orderBy(F.desc(x.startswith("P").cast("int")), F.abs(F.length(x) - 44), F.desc(fillers), F.desc("confidence"), F.desc("top"), F.desc("height"), "no")
    return readings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def second_line_specs(first: DataFrame, offsets: tuple[float, ...] = SECOND_OFFSETS, heights: tuple[float, ...] = SECOND_HEIGHTS, end: float = SECOND_END, also: tuple[str, ...] = ()) -> DataFrame:
    """Bands to read a second line in, below each first line (doc_id, place, top, height, and columns named beside them): four offsets by its own and two other heights, within the page."""
    rows = first.select("doc_id", "place", *also, "top", F.col("height").alias("own"), F.explode(F.array(*map(F.lit, offsets))).alias("offset"))
    rows = rows.select("doc_id", "place", *also, F.round(F.col("top") + F.col("offset"), 6).alias("top"), F.explode(F.array(F.col("own"), *map(F.lit, heights))).alias("height"))
    return rows.where(F.round(F.col("top") + F.col("height"), 6) <= end)


def adaptive_lines(documents: DataFrame, read, keep: int = 4, mend=None) -> DataFrame:
    """doc_id, lines, confidences, checks, top, second_top, bands: the passport zone that a search in two stages reads best.

    read: a function of bands (doc_id, top, height, and columns that it keeps) to the same with text and confidence. The likeliest first lines make the bands
    that second lines are read in; a band that several of them ask for is read once. Of the pairs the one with most valid checks counts, then of exact lengths, then read
    surest, then of the likelier first line, then of the upper second band; equal lines are checked once. mend: what repairs a pair (a column of two lines) before it is
    checked. bands: how many second bands were read. A document whose first lines leave no band has no row.
    """
    first = written(first_line_bands(read(first_line_specs(documents)), keep).select("doc_id", "place", "top", "height", "text", "confidence"), "first-lines")
    # A document's rows stay in one task from here to its result; bands carry the first lines that ask for them, so that nothing is joined again.
    dealt = first.repartition("doc_id").withColumn("first", F.struct("place", "top", "text", "confidence"))
    specs = second_line_specs(dealt, also=("first",)).groupBy("doc_id", "top", "height").agg(F.collect_set("first").alias("firsts"))
    second = read(specs)
    pairs = second.select("doc_id", F.col("top").alias("second_top"), F.col("text").alias("_text"), F.col("confidence").alias("_confidence"), F.explode("firsts").alias("f"))
    pairs = pairs.select("doc_id", "second_top", "_text", "_confidence", "f.*")
    lines = F.array("text", "_text")
    pairs = pairs.select("doc_id", "place", "top", "second_top", (mend(lines) if mend else lines).alias("lines"), F.array("confidence", "_confidence").alias("confidences"))
    surest = F.struct(total(F.col("confidences")), -F.col("place"), -F.col("second_top"))
    one = pairs.groupBy("doc_id", "lines").agg(F.max_by(F.struct("confidences", "top", "second_top", "place"), surest).alias("b"), F.max(surest).alias("sure"))
    shown = mrz.normalised(F.col("lines"))
    exact = F.forall(shown, lambda x: F.length(x) == 44).cast("int")
    one = one.select("doc_id", "lines", "b", F.struct(mrz.score(shown, "TD3").alias("checks"), exact.alias("exact"), "sure").alias("key"))
    best = one.groupBy("doc_id").agg(F.max_by(F.struct("lines", "b", "key"), "key").alias("r"))
    bands = specs.groupBy("doc_id").agg(F.count("*").alias("bands"))
    return best.join(bands.hint("merge"), "doc_id").select("doc_id", "r.lines", "r.b.confidences", "r.key.checks", "r.b.top", "r.b.second_top", "bands")


def crop_grid(spark: SparkSession, **axes: list[float]) -> DataFrame:
    """Every combination of a few values on each axis, numbered in order: a specification table of fixed size."""
    out = spark.range(1).select(F.lit(0).alias("_"))
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(float(v)) for v in values))))
    return out.drop("_").withColumn("no", F.row_number().over(Window.orderBy(*axes)) - 1)  # as many rows as the product of the axes


#: Where a voter card's CURP and its three lines of names are looked for (fixed values): grids of edges, and bands with the shifts of their edges.
CURP_GRID = {"left": [0.31, 0.33, 0.35], "right": [0.62, 0.68, 0.74], "top": [0.79, 0.805, 0.82], "bottom": [0.855, 0.875, 0.895], "contrast": [0.0, 1.0]}
NAME_BANDS = [[0.34, 0.345, 0.58, 0.397], [0.34, 0.388, 0.58, 0.438], [0.34, 0.425, 0.62, 0.48]]
NAME_SHIFTS = {"left": [-0.03, -0.015, 0.0, 0.015], "right": [0.0, 0.025, 0.05], "down": [-0.012, 0.0, 0.012]}
#: A line of a name, and the places of the initials that a personal number tells (fixed values).
NAME_LINE, INITIALS = "^[A-ZÁÉÍÓÚÜÑ ]{2,40}$", (1, 3, 4)


def curp_crops(spark: SparkSession) -> DataFrame:
    """no, left, right, top, bottom, contrast (1 for a crop of stretched grays): 162 rows."""
    return crop_grid(spark, **CURP_GRID)


def name_crops(spark: SparkSession, shifted: bool = True) -> DataFrame:
    """line (0 to 2), no, left, top, right, bottom: the bands of names, each as it is, or with its edges shifted in 36 ways."""
    bands = spark.createDataFrame([(k, *b) for k, b in enumerate(NAME_BANDS)], "line int, l double, t double, r double, b double")
    shifts = crop_grid(spark, **NAME_SHIFTS) if shifted else crop_grid(spark, left=[0.0], right=[0.0], down=[0.0])
    met = bands.crossJoin(shifts)  # three rows by at most 36
    return met.select("line", "no", (F.col("l") + F.col("left")).alias("left"), (F.col("t") + F.col("down")).alias("top"), (F.col("r") + F.col("right")).alias("right"), (F.col("b") + F.col("down")).alias("bottom"))


def curp_of_grid(readings: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, curp, confidence: of readings (doc_id, no, text, confidence, voter_key) the valid CURP that was read surest, the one read first of equal ones; its birth date must be that of an elector key of 18 characters."""
    value = national.compact(F.col("text"))
    agrees = (F.coalesce(F.length("voter_key"), F.lit(0)) != 18) | (F.substring("value", 5, 6) == F.substring("voter_key", 7, 6))
    some = readings.withColumn("value", value).where((F.col("confidence") >= least) & national.curp_valid(F.col("value")) & agrees)
    values = some.groupBy("doc_id", "value").agg(F.max("confidence").alias("c"), F.min("no").alias("first"))
    best = values.groupBy("doc_id").agg(F.max_by(F.struct("value", "c"), F.struct("c", -F.col("first"))).alias("b"))
    return best.select("doc_id", F.col("b.value").alias("curp"), F.col("b.c").alias("confidence"))


def names_of_grid(readings: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, names (three, empty where none fits), confidences: of readings (doc_id, line, no, text, confidence, personal_number) of a line those that are a
    name with the initial that the number tells; the longest (without spaces), then the surest, then the first read."""
    value = F.trim(F.regexp_replace(F.upper("text"), r"\s+", " "))
    initial = F.element_at(F.transform(F.array(*map(F.lit, INITIALS)), lambda k: F.substring(F.col("personal_number"), k, F.lit(1))), F.col("line") + 1)
    some = readings.withColumn("value", value).where((F.col("confidence") >= least) & F.col("value").startswith(initial) & F.col("value").rlike(NAME_LINE))
    values = some.groupBy("doc_id", "line", "value").agg(F.max("confidence").alias("c"), F.min("no").alias("first"))
    best = values.groupBy("doc_id", "line").agg(F.max_by(F.struct("value", "c"), F.struct(F.length(F.replace("value", F.lit(" "), F.lit(""))), "c", -F.col("first"))).alias("b"))
    lines = best.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("line", "b"))).alias("m"))
    docs = readings.select("doc_id").distinct().join(lines, "doc_id", "left")
    at = lambda k: F.try_element_at("m", F.lit(k))
    return docs.select("doc_id", F.array(*(F.coalesce(at(k)["value"], F.lit("")) for k in range(3))).alias("names"), F.array(*(F.coalesce(at(k)["c"], F.lit(0.0)) for k in range(3))).alias("confidences"))


def by_value(readings: DataFrame, least: float = 0.9) -> DataFrame:
    """Of a document's readings of one field, as text: the value that was read surest, the lexicographically first of equal ones, if sure enough."""
    values = readings.where(F.length("text") > 0).groupBy("doc_id", "text").agg(F.max("confidence").alias("c"), F.count("*").alias("n"))
    best = values.groupBy("doc_id").agg(F.min_by(F.struct("text", "c", "n"), F.struct(-F.col("c"), "text")).alias("b"))
    return best.where(F.col("b.c") >= least).select("doc_id", F.col("b.text").alias("text"), F.col("b.c").alias("confidence"), F.col("b.n").alias("readings"))


def best_template(readings: DataFrame, key_fields: tuple[str, ...]) -> DataFrame:
    """Of card templates (doc_id, template, name, text, confidence): the one whose key fields were read with the greatest confidence together, the first of equal ones."""
    own = F.when(F.col("name").isin(*key_fields) & (F.length("text") > 0), F.col("confidence")).otherwise(0.0)
    sums = readings.groupBy("doc_id", "template").agg(F.sum(own).alias("score"))
    return sums.groupBy("doc_id").agg(F.max_by(F.struct("template", "score"), F.struct("score", -F.col("template"))).alias("b")).select("doc_id", "b.*")


ROTATIONS = (90, 270, 0, 180)


def td1_backs(readings: DataFrame, issuer: str = "MEX") -> DataFrame:
    """Backs read by their TD1 zone, over images and rotations (doc_id, image, rotation, lines, confidences): the first fully valid reading in the order they were made, else the one with most checks and confidence; taken only if fully valid and of the issuer."""
    order = F.array_position(F.array(*map(F.lit, ROTATIONS)), F.col("rotation"))
    lines = mrz.normalised(F.col("lines"), three=True)
    s = readings.withColumns({"checks": mrz.score(lines, "TD1"), "_sum": total(F.col("confidences")), "_order": -(F.col("image") * 10 + order), "issuer": F.substring(F.get(lines, F.lit(0)), 3, 3)})
    key = F.struct("checks", F.when(F.col("checks") == 4, F.col("_order").cast("double")).otherwise(F.col("_sum")), "_order")
    best = s.groupBy("doc_id").agg(F.max_by(F.struct("image", "rotation", "lines", "checks", "issuer"), key).alias("b"))
    return best.where((F.col("b.checks") == 4) & (F.col("b.issuer") == issuer)).select("doc_id", "b.image", "b.rotation", "b.lines")


def model_locale(fields: DataFrame, models: DataFrame) -> DataFrame:
    """fields (with locale) and the model that reads each: models (locale, model), 0 for a locale that none names."""
    return fields.join(models.select(F.col("locale").alias("_l"), "model"), F.col("locale") == F.col("_l"), "left").drop("_l").withColumn("model", F.coalesce("model", F.lit(0)))


def text_orientations(orientation: Column) -> Column:
    """Turns to try for a field's text, in order."""
    d = F.pmod(F.coalesce(orientation, F.lit(0)).cast("int"), F.lit(360))
    return F.when(d == 180, F.array(F.lit(180))).when(d.isin(90, 270), F.array(F.pmod(360 - d, F.lit(360)), d)).otherwise(F.array(F.lit(0)))


def text_variants(low_contrast: Column, remove_background: Column) -> Column:
    hard = F.coalesce(low_contrast, F.lit(False)) | F.coalesce(remove_background, F.lit(False))
    return F.when(hard, F.array(F.lit("original"), F.lit("catalog_contrast_normalization"))).otherwise(F.array(F.lit("original")))


def guided_regions(relations: DataFrame, regions: DataFrame) -> DataFrame:
    """Barcode regions of related layouts: where to look for symbols on the other side. relations: doc_id, related array of (place, identifier, name)."""
    r = relations.select("doc_id", F.explode("related").alias("r")).select("doc_id", F.col("r.identifier").alias("identifier"))
    return r.join(regions, "identifier")


def five_points(landmarks: Column) -> Column:
    """Ten coordinates from 68 points: both eyes' middles, nose tip, mouth corners."""
    def middle(a: int, b: int, k: int) -> Column:
        return F.aggregate(F.slice(landmarks, a + 1, b - a), F.lit(0.0), lambda s, p: s + p[k]) / (b - a)

    point = lambda i: [landmarks[i][0], landmarks[i][1]]
    return F.array(middle(36, 42, 0), middle(36, 42, 1), middle(42, 48, 0), middle(42, 48, 1), *point(30), *point(48), *point(54))


PORTRAIT_FACE = 0.2


def portrait_presence(regions: DataFrame, detections: DataFrame, threshold: float = PORTRAIT_FACE) -> DataFrame:
    """Regions where a face is expected: how many there are, how sure the surest is, pass or review."""
    faces = detections.where(F.col("score") >= threshold).groupBy("doc_id", "region").agg(F.count("*").alias("count"), F.max("score").alias("confidence"))
    out = regions.where(F.col("face_expected")).join(faces, ["doc_id", "region"], "left")
    return out.select("doc_id", "region", F.coalesce("count", F.lit(0)).alias("count"), "confidence", F.when(F.col("count") > 0, "pass").otherwise("review").alias("status"))


def portrait_comparison(portraits: DataFrame, selfies: DataFrame, threshold: float) -> DataFrame:
    """doc_id, score, decision, verification: document portraits (doc_id, score, vector, capture; the surest face counts) against selfies (doc_id, vector, liveness)."""
    face = portraits.where(F.col("score") >= PORTRAIT_FACE).groupBy("doc_id").agg(F.max_by(F.struct("vector", "capture"), "score").alias("p"))
    met = face.join(selfies, "doc_id")
    s = vectors.similarity(F.col("p.vector"), F.col("vector"))
    rows = met.select("doc_id", s.alias("score"), "liveness", F.col("p.capture").alias("capture"))
    decision = F.when(same_person(F.col("score"), threshold), "same_person").otherwise("different_person")
    return rows.select("doc_id", "score", decision.alias("decision"), verification_decision(decision, F.col("liveness"), F.col("capture")).alias("verification"))
