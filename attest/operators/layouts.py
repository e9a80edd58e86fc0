"""Declarative layouts: regions, page roles, relations, field dependencies, candidate windows, selection and assembly of readings.

A layout has identifier, caption, child_documents and paired_pages arrays, and arrays of fields, graphics, barcodes and assemblies
(see sources.catalogs.LAYOUT).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import forget, written


def visible(light: Column, layer: Column) -> Column:
    """Printed so that plain light shows it, on no layer of its own."""
    return F.coalesce(light.isin(6, 24), F.lit(False)) & (F.coalesce(layer, F.lit(0)) == 0)


def regions(layouts: DataFrame, array: str, key: list[str], names: list[str] | None = None) -> DataFrame:
    """The visible entries of an array of definitions, one row each with its place; of entries with equal keys the first stays."""
    rows = layouts.select("identifier", F.posexplode(array).alias("seq", "d")).where(visible(F.col("d.lightType"), F.col("d.layer")))
    if names is not None:
        rows = rows.where(F.col("d.name").isin(names))
    first = Window.partitionBy("identifier", *(F.col(f"d.{k}") for k in key)).orderBy("seq")
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).select("identifier", "seq", "d.*")


def text_regions(layouts: DataFrame) -> DataFrame:
    return regions(layouts, "fields", ["number", "name", "bounds"])


def graphic_regions(layouts: DataFrame, names: list[str] | None = None) -> DataFrame:
    return regions(layouts, "graphics", ["name", "bounds"], names)


def barcode_regions(layouts: DataFrame) -> DataFrame:
    return regions(layouts, "barcodes", ["bounds"])


def first_of_name(rows: DataFrame) -> DataFrame:
    """The first region of each name of a layout."""
    w = Window.partitionBy("identifier", "name").orderBy("seq")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def patches_without_data(layouts: DataFrame) -> DataFrame:
    return layouts.withColumn("reference_patches", F.transform("reference_patches", lambda p: p.withField("image", p["image"].dropFields("data"))))


def relations(layouts: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) to children, paired pages and parents."""
    one = lambda column, kind: layouts.select(F.col("identifier").alias("src"), F.explode(column).alias("dst"), F.lit(kind).alias("kind"))
    return one("child_documents", "child").unionByName(one("paired_pages", "paired_page")).unionByName(layouts.where(F.col("parent_identifier").isNotNull()).select(F.col("identifier").alias("src"), F.col("parent_identifier").alias("dst"), F.lit("parent").alias("kind")))


#: What a catalog's hints ask for, by group: output key=key of the hints (fixed values).
REQUIREMENTS = {
    "capture": "requiredLightMask=dNecessaryLights uvExposure=dUVExp opticallyVariableExposure=dOVIExp hologramTiltType=hologramTiltType backgroundDeltaExpectation=dBackgroundDeltaExpectation backgroundDeltaThreshold=dBackgroundDeltaST backgroundLightExpectation=dBackgroundLightExpectation backgroundLightThreshold=dBackgroundLightST",
    "recognition": "ocrSearchToleranceX=dOCRSTX ocrSearchToleranceY=dOCRSTY ocrExpectationX=dOCRExpectationX ocrExpectationY=dOCRExpectationY tag=recognTag barcodeType=dBarcode mrzType=dMRZ mrzHeight=dMRZHeight mrzHeightTolerance=dMRZHeightDiff mrzWidth=dMRZWidth mrzWidthTolerance=dMRZWidthDiff mrzSymbolPosition=dMRZSymbolPos mrzSymbolPositionTolerance=dMRZSymbolPosDiff mrzLineDistance=dMRZDistanceBetweenLines mrzFontIdentifier=dMRZFontID mrzFormat=dMRZFormat filterMask=recognFilterMask cyrillicConversion=dCyrilicConvert handwrittenOption=dHandwrittenOption textIdentifier=textID",
    "electronicDocument": "chipPage=chipPage dataSetIdentifiers=dFDSID certificateValidityPeriodDisabled=dDisableDSCertificateValidityPeriod",
    "sourceReferences": "authenticationSourceType=AuthSourceType authenticationDocumentIdentifier=AuthSourceDocumentID hologramDocumentIdentifier=HoloSourceDocumentID",
    "authenticityConfiguration": "checkMask=dAuthenticity",
    "authenticityConfiguration.authenticity": "uvDullPaper=uvDullPaper photoEmbedType=photoEmbedType checkPhotoEmbedType=checkPhotoEmbedType photoReplacementCheck=photoReplacementCheck wholePageLuminescence=dWholePageLuminescense checkFalseLuminescence=dCheckFalseLuminescense hasDynamicObjects=dHaveDynamicObjects checkFalseWatermarks=dCheckFalseWatermarks checkBlankCaptions=dCheckBlankCaptions checkPhotoHalo=dCheckPhotoHalo checkFaceCount=dCheckFaceCount kinegramModelType=kinegramModelType fibers=fibers",
}


def requirements(hints: Column) -> Column:
    """From a layout's hints, a JSON text: a map of groups to maps of what they ask for, in the words of JSON. What is not stated is left out."""
    groups = []
    for path, names in REQUIREMENTS.items():
        entries = [F.struct(F.lit(k).alias("k"), F.get_json_object(hints, f"$.{path}.{source}").alias("v")) for k, _, source in (x.partition("=") for x in names.split())]
        groups.append(F.struct(F.lit("parameters" if "." in path else path).alias("g"), F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull())).alias("m")))
    return F.map_from_entries(F.array(*groups))


def descriptor(layouts: DataFrame) -> DataFrame:
    """identifier and what a layout says of itself, under the names of responses; flags that are not stated are false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return layouts.select("identifier", F.col("caption").alias("name"), "country", F.coalesce("iso_codes", F.array().cast("array<string>")).alias("countryCodes"), F.col("document_type").alias("type"), F.col("document_format").alias("format"), F.col("year").alias("edition"), "orientation", flag("two_sided").alias("twoSided"), flag("main_document").alias("mainDocument"))


def _ordinal(token: Column) -> Column:
    t = F.upper(token)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int")).when(t != "", F.ascii(t) - 64)


def caption_role(caption: Column) -> Column:
    """(role, ordinal) that a caption states; null if it states none."""
    c = F.coalesce(caption, F.lit(""))
    page = F.regexp_extract(c, r"(?i)\bpage\s*([0-9]+|[A-Z])\b", 1)
    role = (
        F.when(c.rlike(r"(?i)\bfront\s+cover\b"), "front_cover").when(c.rlike(r"(?i)\bback\s+cover\b"), "back_cover").when(c.rlike(r"(?i)\b(?:front|side\s*A)\b"), "front")
        .when(c.rlike(r"(?i)\b(?:back|reverse|rear|side\s*B)\b"), "back").when(page != "", "numbered_page")
    )
    return F.when(role.isNotNull(), F.struct(role.alias("role"), F.when(role == "numbered_page", _ordinal(page)).alias("ordinal")))


def page_roles(layouts: DataFrame) -> DataFrame:
    """identifier, role, ordinal, method, related: as the caption says; else front if a child is a back; else primary page if a paired page has a number over one; else unknown."""
    own = layouts.select("identifier", caption_role(F.col("caption")).alias("r"))
    edges = relations(layouts).where(F.col("kind") != "parent").join(own.select(F.col("identifier").alias("dst"), "r"), "dst")
    told = edges.groupBy(F.col("src").alias("identifier")).agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") == "child") & F.col("r.role").isin("back", "back_cover"), F.col("dst")))).alias("backs"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == "paired_page") & (F.col("r.role") == "numbered_page") & (F.coalesce("r.ordinal", F.lit(1)) > 1), F.col("dst")))).alias("pages"),
    )
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    m = own.join(told, "identifier", "left")
    stated, front, primary = F.col("r").isNotNull(), some("backs"), some("pages")
    return m.select(
        "identifier",
        F.when(stated, F.col("r.role")).when(front, "front").when(primary, "primary_page").otherwise("unknown").alias("role"),
        F.when(stated, F.col("r.ordinal")).when(front, None).when(primary, 1).alias("ordinal"),
        F.when(stated, "caption_marker").when(front, "related_back_layout").when(primary, "related_numbered_page").otherwise("unavailable").alias("method"),
        F.when(~stated & front, F.col("backs")).when(~stated & primary, F.col("pages")).alias("related"),
    )


def declared_ordinal(caption: Column) -> Column:
    """The number or letter after page or side and white space; 1 without one; null for number 0."""
    token = F.regexp_extract(F.coalesce(caption, F.lit("")), r"(?i)\b(?:page|side)\s+([0-9]+|[A-Z])\b", 1)
    n = _ordinal(token)
    return F.when(token == "", 1).when(n > 0, n)


def dependencies(requested: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, name): what each requested name needs, itself included, over edges (name, needs); with an identifier in both tables, within each layout, and the identifier is told too.

    Steps by joins: the names that a step has found new meet the edges, and what their needs add to a root's names is new in the next one, so
    that cycles end when nothing is new, and each name comes once. No task holds more than one root's names; a layout, and the graph, may be of any size.
    """
    of = ["identifier"] if "identifier" in requested.columns and "identifier" in edges.columns else []
    key = [*of, "root"]
    needs = written(edges.where(F.col("name") != F.col("needs")).select(*of, "name", "needs").distinct(), "needs")
    walk = written(requested.groupBy(*key).agg(F.collect_set("name").alias("found")).withColumn("fresh", F.col("found")), "found")
    while not walk.where(F.size("fresh") > 0).isEmpty():
        met = walk.select(*key, F.explode("fresh").alias("name")).join(needs, [*of, "name"])
        told = met.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.collect_set("needs").alias("next"))
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key))
        more = F.when(F.col("next").isNull(), F.slice("found", 1, 0)).otherwise(F.array_except("next", "found"))
        last, walk = walk, written(walk.join(told, same, "left").select(*key, "found", more.alias("fresh")).select(*key, F.concat("found", "fresh").alias("found"), "fresh"), "found")
        forget(last)
    forget(needs)
    return walk.select(*key, F.explode("found").alias("name"))


def field_edges(layouts: DataFrame) -> DataFrame:
    """(identifier, name, needs): an assembly's target needs the fields, and the targets of other assemblies, that have the type (and locale, if stated) of one of its parts."""
    rules = layouts.select("identifier", F.explode("assemblies").alias("a")).select("identifier", F.col("a.target").alias("t"), F.explode("a.parts").alias("p")).where(F.col("p.kind") == "field")
    fields = layouts.select(F.col("identifier").alias("i"), F.explode("fields").alias("d")).select("i", F.col("d.type").alias("type"), F.col("d.lcid").alias("locale"), F.col("d.name").alias("needs"))
    targets = layouts.select(F.col("identifier").alias("i"), F.explode("assemblies").alias("a")).select("i", F.col("a.target.type").alias("type"), F.col("a.target.locale").alias("locale"), F.col("a.target.name").alias("needs"))
    sources = fields.unionByName(targets)
    met = (F.col("identifier") == F.col("i")) & (F.col("p.type") == F.col("type")) & (F.col("p.locale").isNull() | F.col("p.locale").eqNullSafe(F.col("locale")))
    return rules.join(sources, met).select("identifier", F.col("t.name").alias("name"), "needs").distinct()


def candidate_windows(bounds: Column, text_height: Column) -> Column:
    """Boxes to read a field in: as high as its text and a half, 3 to 10 of them down the region, the nearest to its middle first."""
    left, top, right, bottom = (bounds[k] for k in range(4))
    region = bottom - top
    text = F.coalesce(F.nullif(text_height, F.lit(0.0)), region)
    height = F.least(region, F.greatest(text * 1.5, region / 8))
    close = region <= height * 1.8
    start, end = F.when(close, top - text * 0.5).otherwise(top), F.when(close, bottom + text * 0.5).otherwise(bottom)
    span = end - start
    steps = F.greatest(F.lit(3), F.least(F.lit(10), F.bround(span / F.greatest(text * 0.55, F.lit(0.001))).cast("int")))
    boxes = F.transform(F.sequence(F.lit(0), steps - 1), lambda i: F.struct(i.alias("i"), (start + (span - height) * i / (steps - 1)).alias("y")))
    near = F.transform(boxes, lambda b: F.struct(F.abs((b["y"] + b["y"] + height) / 2 - (top + bottom) / 2).alias("far"), b["i"].alias("i"), b["y"].alias("y")))
    return F.transform(F.array_sort(near), lambda b: F.array(left, b["y"], right, b["y"] + height))


def selected_lines(readings: Column, text_height: Column, limit: Column, least: float = 0.18) -> Column:
    """From structs (score, seq, text, centre, confidence): the best line first, others if they lie 0.7 text heights from all
    taken, up to the limit; joined top to bottom, with their mean confidence. If no reading is sure enough, the best one alone; null without readings."""
    every = F.array_sort(F.transform(F.filter(readings, lambda r: r["text"] != ""), lambda r: F.struct((-r["score"]).alias("neg"), r["seq"].alias("seq"), r["text"].alias("text"), r["centre"].alias("centre"), r["confidence"].alias("confidence"))))
    sure = F.filter(every, lambda r: r["confidence"] >= least)
    ordered = F.when(F.size(sure) > 0, sure).otherwise(F.slice(every, 1, 1))
    taken = F.aggregate(ordered, F.filter(ordered, lambda r: F.lit(False)), lambda acc, r: F.when((F.size(acc) >= limit) | F.exists(acc, lambda k: F.abs(k["centre"] - r["centre"]) < 0.7 * text_height), acc).otherwise(F.concat(acc, F.array(r))))
    down = F.array_sort(F.transform(taken, lambda r: F.struct(r["centre"].alias("centre"), r["text"].alias("text"))))
    mean = F.aggregate(taken, F.lit(0.0), lambda s, r: s + r["confidence"]) / F.size(taken)
    return F.when(F.size(taken) > 0, F.struct(F.array_join(F.transform(down, lambda r: r["text"]), "\n").alias("value"), mean.alias("confidence")))


def assembled(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """Fields put together from others: doc_id, rule, type, name, value, confidence, bounds, derived_from.

    readings: doc_id, pos, type, name, value, confidence, locale, bounds. rules: rule, target struct (type, name, locale), parts
    array of (kind, type, locale, value). A rule rests if its target was read. Of the readings of a part the surest counts, the
    first of equal ones. Literals stand between neighbours that are both there; where a field between them is missing, only the last
    literal without a slash does. Rules do not see what other rules assemble. A rule without any part found gives no row.
    """
    some = readings.where(F.length("value") > 0)
    docs = readings.select("doc_id").distinct()
    targets = rules.select("rule", F.col("target.type").alias("tt"), F.col("target.locale").alias("tl"))
    done = some.join(targets, (F.col("type") == F.col("tt")) & (F.col("tl").isNull() | F.col("locale").eqNullSafe(F.col("tl")))).select("doc_id", "rule").distinct()
    parts = rules.select("rule", F.posexplode("parts").alias("part", "p"))
    fields = parts.where(F.col("p.kind") == "field").select("rule", "part", F.col("p.type").alias("pt"), F.col("p.locale").alias("pl"))
    found = some.join(fields, (F.col("type") == F.col("pt")) & (F.col("pl").isNull() | F.col("locale").eqNullSafe(F.col("pl"))))
    best = found.groupBy("doc_id", "rule", "part").agg(F.max_by(F.struct("name", "value", "confidence", "bounds"), F.struct("confidence", -F.col("pos"))).alias("s"))
    by_rule = best.groupBy("doc_id", "rule").agg(F.array_sort(F.collect_list(F.struct("part", "s"))).alias("found"))
    out = by_rule.join(rules, "rule").join(done, ["doc_id", "rule"], "left_anti")

    def between(a: Column, b: Column) -> Column:
        gap = F.slice(F.col("parts"), a + 2, b - a - 1)
        literals = F.transform(F.filter(gap, lambda p: p["kind"] == "literal"), lambda p: p["value"])
        safe = F.filter(literals, lambda x: ~F.contains(x, F.lit("/")))
        return F.when(F.exists(gap, lambda p: p["kind"] == "field"), F.coalesce(F.try_element_at(safe, F.lit(-1)), F.lit(""))).otherwise(F.array_join(literals, ""))

    f = F.col("found")
    joined = F.aggregate(f, F.struct(F.lit(-1).alias("at"), F.lit("").alias("text")), lambda acc, x: F.struct(x["part"].alias("at"), F.concat(acc["text"], F.when(acc["at"] >= 0, between(acc["at"], x["part"])).otherwise(""), x["s"]["value"]).alias("text")))
    value = F.regexp_replace(joined["text"], "^[ ,/]+|[ ,/]+$", "")
    edge = lambda k, pick: pick(F.transform(f, lambda x: x["s"]["bounds"][k]))
    mean = F.aggregate(f, F.lit(0.0), lambda s, x: s + x["s"]["confidence"]) / F.size(f)
    out = out.select("doc_id", "rule", "target.type", "target.name", value.alias("value"), mean.alias("confidence"), F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max)).alias("bounds"), F.transform(f, lambda x: x["s"]["name"]).alias("derived_from"))
    return out.where(F.col("value") != "").join(docs, "doc_id", "left_semi")


def recognised_layout(readings: DataFrame, rules: DataFrame, edges: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """doc_id, name, type, value, confidence, derived: what a layout's fields gave, read and put together; of requested names only, if any are.

    readings as for assembled(), edges (name, needs) as of field_edges(). With names requested, only the fields that they need are
    taken into account, through the rules that put them together; a field that was read is not put together. Empty readings give nothing.
    """
    spark, some = readings.sparkSession, readings.where(F.length("value") > 0)
    if requested is not None:
        wanted = spark.createDataFrame([(x, x) for x in requested], "root string, name string")
        needed = dependencies(wanted, edges).select("name").distinct()  # names of one layout
        some = some.join(needed, "name", "left_semi")
    made = assembled(some, rules)
    shown = ("doc_id", "name", "type", "value", "confidence")
    out = some.select(*shown, F.lit(False).alias("derived")).unionByName(made.select(*shown, F.lit(True).alias("derived")))
    return out if requested is None else out.where(F.col("name").isin(*requested))


def field_values(readings: DataFrame) -> DataFrame:
    """(doc_id, name, value, confidence): the surest non-empty reading of each name; of equal ones the later, then the greater."""
    return readings.where(F.length("value") > 0).groupBy("doc_id", "name").agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", "pos", "value")).alias("b")).select("doc_id", "name", "b.*")


IDENTITY_FIELDS = ("documentNumber", "surnameAndGivenNames", "surname", "givenNames", "personalNumber", "dateOfBirth")


def has_identity_evidence(readings: DataFrame, names: tuple[str, ...] = IDENTITY_FIELDS, least: float = 0.35) -> DataFrame:
    """doc_ids with a sure enough reading of one of the names."""
    return readings.where((F.length("value") > 0) & F.col("name").isin(*names) & (F.col("confidence") >= least)).select("doc_id").distinct()


def profile_name(identifier: Column) -> Column:
    return F.concat(F.lit("CATALOG-"), F.when(identifier < 0, F.concat(F.lit("N"), F.abs(identifier).cast("string"))).otherwise(F.concat(F.lit("P"), identifier.cast("string"))))


#: Fields that hold persons' names, regional models of Latin script, and how sure a reading is that ends a search.
PERSON_NAMES = ("surnameAndGivenNames", "surname", "firstSurname", "secondSurname", "givenNames", "fathersName", "mothersName")
REGIONAL_MODELS, SURE = (1034, 1050, 1055, 1061, 1066), 0.995


def reading_score(name: Column, mask_score: Column, value: Column, confidence: Column, wanted_model: Column, model: Column) -> Column:
    """What a reading is worth: its confidence, how well it fits the field's mask (masks.compatibility), that a name has no digit, and, for
    fields of a regional model, which model read it: the general one, or the regional one that found letters beyond ASCII."""
    named = F.when(name.isin(*PERSON_NAMES), F.when(value.rlike(r"\p{Nd}"), -0.4).otherwise(0.05)).otherwise(F.lit(0.0))
    regional = F.when(F.coalesce(model, F.lit(0)) == 0, 0.2).when(value.rlike(r"^[\x00-\x7f]*$"), -0.2).otherwise(0.05)
    return confidence + mask_score + named + F.when(F.coalesce(wanted_model.isin(*REGIONAL_MODELS), F.lit(False)), regional).otherwise(F.lit(0.0))


def line_limit(mask_lines: Column, height: Column, text_height: Column) -> Column:
    """How many lines a field may have: as its mask says, else as many as its region holds, one to six."""
    fits = F.bround(height / F.greatest(text_height * 1.8, F.lit(0.001))).cast("int")
    return F.coalesce(mask_lines, F.greatest(F.lit(1), F.least(F.lit(6), fits)))


def recognised_fields(readings: DataFrame) -> DataFrame:
    """doc_id, field, value, confidence: what was read of each field.

    readings: doc_id, field, limit, text_height, window (in the order that they are tried), seq, text, centre, confidence, score, mask_score. A
    field of one line ends with the first window whose best reading is as sure as SURE and fits its mask: that reading counts. Others
    take their lines from all windows.
    """
    r = readings.withColumn("text", F.regexp_replace("text", "^[ <]+|[ <]+$", "")).where(F.col("text") != "")
    best = r.groupBy("doc_id", "field", "window").agg(F.max("limit").alias("limit"), F.max_by(F.struct("text", "confidence", "score", "mask_score"), F.struct("score", -F.col("seq"))).alias("b"))
    ends = best.where((F.col("limit") == 1) & (F.col("b.confidence") >= SURE) & (F.col("b.score") >= SURE) & (F.col("b.mask_score") >= 0))
    early = ends.groupBy("doc_id", "field").agg(F.min_by("b", "window").alias("early"))
    lines = r.groupBy("doc_id", "field").agg(F.max("limit").alias("limit"), F.max("text_height").alias("height"), F.collect_list(F.struct("score", "seq", "text", "centre", "confidence")).alias("all"))  # a field has some hundred readings at most
    told = lines.join(early, ["doc_id", "field"], "left").select("doc_id", "field", "early", F.explode(F.array(selected_lines(F.col("all"), F.col("height"), F.col("limit")))).alias("s"))
    return told.select("doc_id", "field", F.coalesce("early.text", "s.value").alias("value"), F.coalesce("early.confidence", "s.confidence").alias("confidence"))


#: Parts of an address, in order.
ADDRESS = ("addressStreet", "addressHouse", "addressBuilding", "addressFlat", "addressCity", "addressState", "addressPostalCode")


def visual_result(values: Column, voter: Column) -> Column:
    """A struct of a holder's data from a map of field values: name, surnames, given names, address lines, and for a Mexican voter
    card (voter) names of three lines or more, compacted numbers, a four-digit section and a registration year."""
    get = lambda k: F.coalesce(F.try_element_at(values, F.lit(k)), F.lit(""))
    trimmed = lambda x: F.filter(F.transform(F.split(x, "\n"), lambda v: F.trim(v)), lambda v: v != "")
    both, lines = get("surnameAndGivenNames"), trimmed(get("surnameAndGivenNames"))
    three = voter & (F.size(lines) >= 3)
    parts = F.filter(F.array(*map(get, ADDRESS)), lambda x: x != "")
    address = F.when(F.size(trimmed(get("address"))) > 0, trimmed(get("address"))).otherwise(parts)
    address = F.when(voter, F.transform(address, lambda x: F.regexp_replace(x, r"\bSN\b", "S/N"))).otherwise(address)
    surname = F.when(three, F.array_join(F.slice(lines, 1, 2), " ")).otherwise(get("surname"))
    given = F.when(three, F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), " ")).otherwise(get("givenNames"))
    plain = lambda k: F.regexp_replace(F.upper(get(k)), r"[^\p{L}\p{N}]", "")
    digits = F.regexp_replace(get("section"), "[^0-9]", "")
    name = F.coalesce(F.nullif(F.regexp_replace(both, "\n", " "), F.lit("")), F.array_join(F.filter(F.array(surname, given), lambda x: x != ""), " "))
    fields = {
        "name": name, "surname": surname, "given_names": given, "first_surname": F.when(three, F.get(lines, F.lit(0))).otherwise(F.try_element_at(values, F.lit("firstSurname"))), "second_surname": F.when(three, F.get(lines, F.lit(1))).otherwise(F.try_element_at(values, F.lit("secondSurname"))),
        "address": F.array_join(address, ", "), "address_lines": address, "personal_number": F.when(voter, plain("personalNumber")).otherwise(F.try_element_at(values, F.lit("personalNumber"))), "elector_key": F.when(voter, plain("voterKey")), "curp": F.when(voter, plain("personalNumber")),
        "registration_year": F.when(voter, F.nullif(F.regexp_extract(get("dateOfRegistration"), "((?:19|20)[0-9]{2})", 1), F.lit(""))), "section": F.when(voter & (F.length(digits) == 4), digits).when(~voter, F.try_element_at(values, F.lit("section"))),
    }
    return F.struct(*(v.alias(k) for k, v in fields.items()))
