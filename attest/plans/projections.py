"""Closed projections of results into the responses of a document, a face analysis, a liveness check, a comparison and a template.

A projection is stated as data: groups, and in each the output key and the result column that it takes. Results are tables in
snake case, of which any columns may be missing; only what a projection names reaches a response, cleaned of empties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import table
from .payloads import dice, made, pick, quoted, view
from .responses import without_empties

#: Output key=column where they differ by more than case; a plain column gives its own name in camel case.
GROUPS = {
    "document": "recognized name=document_name country class_code=document_class number=document_number status=document_status issuing_state_code=issuing_state source profile layout_identifier=requested page_role requested_fields classification",
    "holder": "name=holder_name first_surname second_surname surname given_names sex nationality nationality_code height",
    "dates": "birth=date_of_birth issue=issued expiry=expires",
    "address": "full=address lines=address_lines city state=region municipality locality postal_code",
    "identifiers": "personal_number folio_number elector_key curp document_discriminator registration_year section optional_data credential_identifier query_identifier barcode_number",
    "details": "authority place_of_birth observations",
    "machineReadable": "type=machine_type code=mrz_code checks barcodes verification",
    "regions": "",
    "images": "",
    "pairing": "decision=pair_decision checks=pair_checks relation_type expected_related_documents related_side_barcode_count=related_barcodes sides",
    "pages": "decision=pages_decision page_count matched_page_count=matched_pages ordering comparisons items",
    "validation": "structural spoofing_decision=capture liveness_decision fields=field_validation",
}
#: Regions that a response may show.
SHOWN_REGIONS = ("portrait", "ghostPortrait", "signature", "portraitOfChild")
STRUCTURAL = {1: "valid", 0: "invalid"}


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def pairs_of(group: str) -> list[tuple[str, str]]:
    return [(camel(k), c or k) for k, _, c in (x.partition("=") for x in GROUPS[group].split())]


def first_of(have: dict, *names: str) -> Column:
    """The first of some columns that is there and not an empty text."""
    found = [F.nullif(F.col(n), F.lit("")) for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def contradicted(have: dict) -> Column:
    """Whether the classified document (documentType, country) contradicts what a machine-readable zone says: a passport that is classed otherwise, or another country."""
    if not {"source", "candidate"} <= set(have):
        return F.lit(False)
    c = F.col("candidate")
    passport = (first_of(have, "document_name") == "Passport") & ~F.coalesce(c["type"].isin("Passport", "PassportPage"), F.lit(False))
    abroad = first_of(have, "country") != F.nullif(c["country"], F.lit(""))
    return F.coalesce(F.col("source") == "MRZ", F.lit(False)) & (F.coalesce(passport, F.lit(False)) | F.coalesce(abroad, F.lit(False)))


def document_response(results: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and data, a struct of the groups, with empties null at every depth (to_json leaves them out).

    Columns that steer: source, profile, status, mrz_code, candidate (struct name, country, type, confidence and any more), ine_qr (struct of
    qr_evidence), machine_barcodes (structs format, text), visual_regions (map of structs), extracted_images.
    """
    have = {f.name: f.dataType for f in results.schema}
    some = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    qr = (lambda c: F.col(f"ine_qr.{c}")) if "ine_qr" in have else (lambda c: F.lit(None).cast("string"))
    profile = F.coalesce(some("profile"), F.lit("UNSUPPORTED"))
    source = F.coalesce(some("source"), F.lit("NOT_AVAILABLE"))
    whole = F.concat_ws(" ", first_of(have, "surname"), first_of(have, "given_names"))
    texts = F.transform(F.filter("machine_barcodes", lambda b: ~b["text"].eqNullSafe(qr("verification_url"))), lambda b: F.struct(b["format"].alias("format"), b["text"].alias("value"))) if "machine_barcodes" in have else F.lit(None).cast("array<struct<format:string,value:string>>")
    shown = F.coalesce(F.size(texts) > 0, F.lit(False))
    has_zone = F.coalesce(F.length(some("mrz_code")) > 0, F.lit(False))
    has_qr = F.col("ine_qr").isNotNull() if "ine_qr" in have else F.lit(False)
    derived = {
        "profile": profile, "source": source, "recognized": profile != "UNSUPPORTED", "structural": F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in STRUCTURAL.items() for x in p)), some("status").cast("int")), F.lit("not_available")),
        "holder_name": F.coalesce(first_of(have, "name", "surname_and_given_names"), whole), "issued": first_of(have, "date_of_issue", "issue_year"), "expires": first_of(have, "date_of_expiry", "validity"), "region": first_of(have, "state", "jurisdiction_code"),
        **{k: F.coalesce(first_of(have, k), qr(k)) for k in ("credential_identifier", "query_identifier", "barcode_number")},
        "machine_type": F.when(has_zone, F.replace(F.coalesce(some("machine_profile"), profile), F.lit("ICAO-"), F.lit(""))).when(source == "BARCODE", F.coalesce(some("barcode_format"), F.lit("PDF417"))).when(shown | has_qr, F.lit("BARCODE")),
        "mrz_code": F.when(has_zone, some("mrz_code")), "barcodes": F.when(shown, texts),
    }
    if "checks" in have:
        derived["checks"] = F.when(has_zone, F.col("checks"))
    if "ine_qr" in have:
        derived["verification"] = F.when(has_qr, F.struct(*(qr(c).alias(camel(c)) for c in ("issue_date", "credential_type", "query_identifier", "verification_url"))))
    if "candidate" in have:
        derived["classification"] = F.when(F.col("candidate.name").isNotNull() & ~contradicted(have), F.col("candidate"))
    rows = results.withColumns({f"_d_{k}": v for k, v in derived.items()})
    kinds = {f.name: f.dataType for f in rows.schema}
    place = lambda c: f"_d_{c}" if c in derived else c
    groups = []
    for group in GROUPS:
        if group == "regions" and "visual_regions" in have:
            groups.append((group, F.map_filter("visual_regions", lambda k, v: k.isin(*SHOWN_REGIONS)), kinds["visual_regions"]))
        elif group == "images" and "extracted_images" in have:
            groups.append((group, F.col("extracted_images"), kinds["extracted_images"]))
        elif parts := [(k, place(c)) for k, c in pairs_of(group) if place(c) in kinds]:
            groups.append((group, F.struct(*(F.col(c).alias(k) for k, c in parts)), T.StructType([T.StructField(k, kinds[c]) for k, c in parts])))
    return rows.select(*keys, F.struct(*(without_empties(v, kind).alias(g) for g, v, kind in groups)).alias("data"))


def answered(rows: DataFrame) -> DataFrame:
    """data as the text of a response."""
    return rows.withColumn("response", F.to_json(F.struct(F.lit("ok").alias("status"), "data"))).drop("data")


def _struct(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def head_pose(value: Column) -> Column:
    return F.when(value.isNotNull(), _struct(yaw=value["yaw"], pitch=value["pitch"], roll=value["roll"]))


def quality(value: Column) -> Column:
    return F.when(value.isNotNull(), _struct(status=value["status"], warnings=value["warnings"]))


def face_analysis(faces: Column) -> Column:
    """faces: structs confidence, box, landmarks (arrays of points), head_pose, quality."""
    shown = F.transform(faces, lambda f: _struct(confidence=f["confidence"], box=f["box"], landmarks=F.when(F.size(f["landmarks"]) > 0, f["landmarks"]), headPose=head_pose(f["head_pose"]), quality=quality(f["quality"])))
    return _struct(faceCount=F.size(faces), faces=F.when(F.size(faces) > 0, shown))


def liveness(result: Column, box: Column) -> Column:
    return _struct(decision=result["decision"], score=result["score"], threshold=result["threshold"], spoofThreshold=result["spoof_threshold"], face=_struct(box=box), headPose=head_pose(result["head_pose"]), quality=quality(result["quality"]))


def compared(result: Column) -> Column:
    return _struct(decision=result["decision"], score=result["score"], threshold=result["threshold"], faces=F.transform(result["face_boxes"], lambda b: _struct(box=b)))


def portrait_compared(result: Column, live: Column) -> Column:
    """A document's portrait against a selfie; live: the selfie's liveness, null without one."""
    portrait = _struct(box=result["portrait_box"], faceBox=result["document_face_box"], detectionConfidence=result["detection_confidence"], detectionThreshold=result["detection_threshold"])
    shown = F.when(live.isNotNull(), _struct(decision=live["decision"], score=live["score"], threshold=live["threshold"], spoofThreshold=live["spoof_threshold"], headPose=head_pose(live["head_pose"]), quality=quality(live["quality"])))
    return _struct(decision=result["decision"], score=result["score"], threshold=result["threshold"], verification=result["verification"], document=_struct(profile=result["profile"], layoutIdentifier=result["layout_identifier"], portrait=portrait), selfie=_struct(faceBox=result["selfie_box"], liveness=shown))


def template(result: Column) -> Column:
    return _struct(templateBase64=result["template"], format=F.lit("float32-le"), length=result["length"], byteLength=4 * result["length"], face=_struct(box=result["box"]))


# --- queries ---

RESULTS = f"""SELECT c_custkey AS doc_id, {pick(quoted(['Passport', 'Visa', 'Card']), 'c_custkey', 'a')} AS document_name, {pick(quoted(['Utopia', 'Sweden', '']), 'c_custkey', 'b')} AS country, {pick(quoted(['MRZ', 'VISUAL', 'BARCODE', None]), 'c_custkey', 'c')} AS source, {pick(quoted(['ICAO-TD3', 'CATALOG-P7', 'UNSUPPORTED', None]), 'c_custkey', 'd')} AS profile,
  CAST({dice('c_custkey', 'e', 3)} - 1 AS INT) AS status, {pick(["c_name", "''", "NULL"], 'c_custkey', 'f')} AS name, {pick(quoted(['DOE', '']), 'c_custkey', 'g')} AS surname, {pick(quoted(['JANE', '']), 'c_custkey', 'h')} AS given_names, {pick(quoted(['P<UTO', '']), 'c_custkey', 'i')} AS mrz_code, {pick(quoted(['2020-01-01', '', None]), 'c_custkey', 'j')} AS date_of_issue, {pick(quoted(['2020', '']), 'c_custkey', 'k')} AS issue_year,
  {pick(quoted(['TD1', None]), 'c_custkey', 'l')} AS machine_profile, {pick(quoted(['Passport', 'Visa', None]), 'c_custkey', 'm')} AS class_type, {pick(quoted(['Utopia', 'Sweden', '']), 'c_custkey', 'n')} AS class_country, {pick(quoted(['A thing', None]), 'c_custkey', 'o')} AS class_name, {pick(quoted(['', 'AZ']), 'c_custkey', 'p')} AS state, {pick(quoted(['NY', '']), 'c_custkey', 'q')} AS jurisdiction_code, 'secret' AS engine_file FROM {{customer}}"""
_PATHS = {"recognized": "document.recognized", "profile": "document.profile", "country": "document.country", "classified": "document.classification.name", "holder": "holder.name", "issued": "dates.issue", "region": "address.state", "machine": "machineReadable.type", "code": "machineReadable.code", "structural": "validation.structural", "expiry": "dates.expiry"}


def document_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What responses say at some of their paths; what is empty is not there."""
    rows = made(spark, sf_dir, RESULTS).withColumn("candidate", F.struct(F.col("class_name").alias("name"), F.col("class_country").alias("country"), F.col("class_type").alias("type"), F.lit(0.9).alias("confidence")))
    r = answered(document_response(rows.drop("class_name", "class_country", "class_type")))
    return r.select("doc_id", *(F.get_json_object("response", f"$.data.{p}").alias(k) for k, p in _PATHS.items()), F.contains("response", F.lit("secret")).cast("int").alias("leaks"), F.get_json_object("response", "$.data.identifiers").alias("identifiers"))


def face_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as faces: analysis, liveness and comparison at some of their paths."""
    e, some = F.col("embedding"), F.col("label") % 2 == 0
    at = lambda k: F.round(e[k].cast("double"), 4)
    box = F.array(at(0), at(1), at(2), at(3))
    pose = F.when(some, _struct(yaw=at(4), pitch=at(5), roll=F.lit(None).cast("double")))
    told = _struct(status=F.lit("review"), warnings=F.array(F.lit("FACE_CUTOFF")))
    face = _struct(confidence=at(6), box=box, landmarks=F.array().cast("array<array<double>>"), head_pose=pose, quality=F.when(some, told))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", face_analysis(F.when(F.col("vec_id") % 7 > 0, F.array(face)).otherwise(F.array().cast(T.ArrayType(T.StructType([T.StructField("confidence", T.DoubleType()), T.StructField("box", T.ArrayType(T.DoubleType())), T.StructField("landmarks", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("head_pose", T.StructType([T.StructField(x, T.DoubleType()) for x in ("yaw", "pitch", "roll")])), T.StructField("quality", T.StructType([T.StructField("status", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType()))]))]))))).alias("data"))
    r = answered(rows)
    paths = {"n": "faceCount", "confidence": "faces[0].confidence", "yaw": "faces[0].headPose.yaw", "status": "faces[0].quality.status", "landmarks": "faces[0].landmarks"}
    return r.select("vec_id", *(F.get_json_object("response", f"$.data.{p}").alias(k) for k, p in paths.items())).withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("confidence", "yaw")})


QUERIES = {f.__name__: f for f in (document_responses, face_responses)}
ORACLES = {
    "document_responses": f"""WITH r AS ({view(RESULTS)}), c AS (SELECT *, coalesce(profile, 'UNSUPPORTED') AS p, class_name IS NOT NULL AND NOT (coalesce(source, '') = 'MRZ' AND ((document_name = 'Passport' AND coalesce(class_type, '') <> 'Passport') OR (country <> '' AND class_country <> '' AND country <> class_country))) AS classed FROM r)
        SELECT doc_id, CASE WHEN p <> 'UNSUPPORTED' THEN 'true' ELSE 'false' END AS recognized, p AS profile, nullif(country, '') AS country, CASE WHEN classed THEN class_name END AS classified, nullif(coalesce(nullif(name, ''), trim(surname || ' ' || given_names)), '') AS holder, coalesce(nullif(date_of_issue, ''), nullif(issue_year, '')) AS issued, coalesce(nullif(state, ''), nullif(jurisdiction_code, '')) AS region,
          CASE WHEN mrz_code <> '' THEN replace(coalesce(machine_profile, p), 'ICAO-', '') WHEN source = 'BARCODE' THEN 'PDF417' END AS machine, nullif(mrz_code, '') AS code, CASE status WHEN 1 THEN 'valid' WHEN 0 THEN 'invalid' ELSE 'not_available' END AS structural, NULL::VARCHAR AS expiry, 0 AS leaks, NULL::VARCHAR AS identifiers FROM c""",
    "face_responses": """SELECT vec_id, CASE WHEN vec_id % 7 > 0 THEN '1' ELSE '0' END AS n, CASE WHEN vec_id % 7 > 0 THEN round(embedding[7]::DOUBLE, 4) END AS confidence, CASE WHEN vec_id % 7 > 0 AND label % 2 = 0 THEN round(embedding[5]::DOUBLE, 4) END AS yaw, CASE WHEN vec_id % 7 > 0 AND label % 2 = 0 THEN 'review' END AS status, NULL::VARCHAR AS landmarks FROM embeddings""",
}
