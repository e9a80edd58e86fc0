"""Named queries over single cards made from customers and orders: correlated symbols, results of barcodes, visual supplements, fields that were read.

Inputs are SQL texts that both engines run (see payloads); the oracles read them in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import barcodes, masks, national
from ..operators import imaging, layouts, readings
from .payloads import AAMVA, URLS, dice, made, pick, quoted, view

_O, _C = "o_orderkey", "c_custkey"

#: Orders as symbols of a customer's card.
SYMBOLS = f"""SELECT o_custkey AS doc_id, o_orderkey AS seq, {pick(quoted(['QRCode', 'QRCode', 'Code128', 'PDF417', 'Code128']), _O, 'fmt')} AS format, {pick(quoted(['zxing', 'zbar']), _O, 'dec')} AS decoder,
  CASE WHEN {dice(_O, 'txt', 4)} = 0 THEN CAST(o_orderkey * 17 AS STRING) WHEN {dice(_O, 'txt', 4)} = 1 THEN 'N' || CAST(o_orderkey AS STRING) ELSE url END AS text FROM {{orders}} JOIN ({URLS}) AS u ON o_orderkey = key"""


def symbol_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verification QR of a card with the number of its linear symbol."""
    rows = made(spark, sf_dir, SYMBOLS).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "format", "text", "decoder"))).alias("s"))  # the symbols of one card
    told = rows.select("doc_id", F.explode(F.array(barcodes.qr_result(barcodes.qr_evidence(F.col("s"))))).alias("e"))
    return told.select("doc_id", *(f"e.{c}" for c in ("document_number", "date_of_issue", "credential_type", "query_identifier", "barcode_number", "engine", "profile", "status")))


def aamva_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, AAMVA).select("key", F.explode(F.array(barcodes.aamva_result(barcodes.parsed_aamva(F.col("payload"))))).alias("r"))
    return rows.select("key", *(f"r.{c}" for c in ("document_name", "country", "document_number", "surname", "given_names", "surname_and_given_names", "status", "profile")))


PASSPORTS = f"""SELECT c_custkey AS key, {pick(quoted([' 709', '710', '709 ', '']), _C, 'a')} AS authority, {pick(quoted(['МИНСК', ' ГОМЕЛЬ ']), _C, 'b')} AS place, {pick(quoted(['21.03.2021', '31 02 2021', '210321', ' n/a ', '05/11/2019']), _C, 'c')} AS issued,
  {pick(quoted(['', 'sam i!', 'SAMITE', 'XSAMI', 'S A M I']), _C, 'd')} AS stamp, CAST({dice(_C, 'e', 2)} AS INT) AS status, {pick(quoted(['BLR', 'MEX', 'SWE', 'UTO', None]), _C, 'f')} AS issuer, {pick(quoted(['surname1', 'address2', 'curp', 'other', 'givenNames']), _C, 'g')} AS raw_key FROM {{customer}}"""


def belarus_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, PASSPORTS)
    told = national.belarus_visual(F.col("authority"), F.col("place"), F.col("issued"), F.col("stamp"), F.col("status"))
    return rows.select("key", told.alias("v"), national.country_name(F.col("issuer")).alias("issuer_name"), national.visual_key(F.col("raw_key")).alias("output_key")).select("key", "issuer_name", "output_key", *(f"v.{c}" for c in ("authority", "authority_name", "place_of_birth", "date_of_issue", "document_status", "status")))


VISUALS = f"""SELECT c_custkey AS key, rpad('P<MEX' || {pick(quoted(['GOMEZ<<ANA<MARIA', 'L0PEZ<DIAZ<<JUAN', 'SOLIS<<EVA']), _C, 'l')}, 44, '<') AS line, {pick(quoted(['GOMEZ', 'GOMES', 'LOPEZ DIAZ', 'L0PEZ', 'SOLIS', 'EXTRA']), _C, 'a')} AS surname, {pick(quoted(['ANA MARIA', 'ANA  MARLA', 'JUAN', 'EVA', '']), _C, 'b')} AS given,
  {pick(["0.9", "0.85", "0.8"], _C, 'c')} AS c1, {pick(["0.95", "0.85", "0.2"], _C, 'd')} AS c2, {pick(quoted(['MEXICANA', 'mexicana ', 'MEXICAN', 'OTRA']), _C, 'e')} AS n1, {pick(quoted(['MEXICANA', 'MEX1CANA', 'X']), _C, 'f')} AS n2, {pick(["0.5", "0.7"], _C, 'g')} AS k1, {pick(["0.6", "0.7"], _C, 'h')} AS k2,
  {pick(quoted(['GOMC8O0215HDFRRR09', 'GOMC 800215 HDFRRR 09', 'SHORT1']), _C, 'i')} AS number, {pick(quoted(['MEXIC0', ' cdmx ']), _C, 'j')} AS place, {pick(quoted(['12345', '12A45', '']), _C, 'k')} AS folio, {pick(quoted(['21/03/2020', '21 MAR 2020', '30/02/2020']), _C, 'm')} AS issued FROM {{customer}}"""


def mexican_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda text, c: F.struct(F.col(text).alias("text"), (F.col(c) if isinstance(c, str) else F.lit(c)).cast("double").alias("confidence"))
    values = F.struct(one("surname", "c1").alias("surname"), one("given", "c2").alias("givenNames"), one("n1", "k1").alias("nationality"), one("number", 0.5).alias("personalNumber"), one("place", 0.5).alias("placeOfBirth"), one("folio", 0.5).alias("folioNumber"), one("issued", 0.5).alias("dateOfIssue"))
    rows = made(spark, sf_dir, VISUALS).select("key", national.mexican_profile(F.array(one("n1", "k1"), one("n2", "k2"))).cast("int").alias("profile"), F.explode(F.array(national.mexican_visual(values, F.col("line")))).alias("v"))
    return rows.select("key", "profile", *(f"v.{c}" for c in ("surname", "given_names", "name", "nationality", "personal_number", "place_of_birth", "date_of_issue", "folio_number", "first_line")))


#: Six readings of each of two fields of a customer's card, in two windows.
READ = f"""SELECT c_custkey AS doc_id, f AS field, CASE WHEN f = 'surname' THEN 1 ELSE {dice("c_custkey || f", 'lim', 3)} + 1 END AS row_limit, CAST(floor(s / 3) AS INT) AS window_no, s AS seq,
  {pick(["substr(c_name, 1, 4 + s)", "'<' || c_mktsegment || ' <'", "'é' || c_mktsegment", "' < '", "'ABC'"], "c_custkey || f || CAST(s AS STRING)", 't')} AS said, CAST({pick(["0.1", "0.996", "0.5", "0.7", "0.17"], "c_custkey || f || CAST(s AS STRING)", 'c')} AS DOUBLE) AS confidence,
  CAST(floor(s / 2) AS DOUBLE) / 20 AS centre, {pick(["1034", "1033", "0"], "c_custkey || f", 'w')} AS wanted, {pick(["0", "1034"], "c_custkey || f || CAST(s AS STRING)", 'm')} AS model
  FROM {{customer}} CROSS JOIN (SELECT 'surname' AS f UNION ALL SELECT 'other') AS a CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) AS b"""


def field_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read of each field: readings are scored, those of one line end with a sure window, others are put together down the region."""
    r = made(spark, sf_dir, READ).withColumn("text", F.regexp_replace("said", "^[ <]+|[ <]+$", ""))
    folded = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    fits = masks.compatibility(F.lit("CCCCCC"), F.col("text"), folded)
    r = r.withColumn("mask_score", F.round(fits, 6)).withColumn("score", F.round(layouts.reading_score(F.col("field"), F.col("mask_score"), F.col("text"), F.col("confidence"), F.col("wanted"), F.col("model")), 6))
    rows = layouts.recognised_fields(r.select("doc_id", "field", F.col("row_limit").alias("limit"), F.lit(0.1).alias("text_height"), F.col("window_no").alias("window"), "seq", "text", "centre", "confidence", "score", "mask_score"))
    return rows.select("doc_id", "field", "value", F.round("confidence", 6).alias("confidence"))


HOLDERS = f"""SELECT c_custkey AS key, {dice(_C, 'v', 2)} = 1 AS voter, {pick(["'DOE' || chr(10) || 'ROE' || chr(10) || 'ANA' || chr(10) || 'MARIA'", "'DOE ANA'", "''", "' DOE ' || chr(10) || chr(10) || 'ANA'"], _C, 'a')} AS names, {pick(quoted(['SMITH', '']), _C, 'b')} AS surname, {pick(quoted(['JOHN', '']), _C, 'c')} AS given,
  {pick(["'C 1 SN' || chr(10) || ' COL X '", "''", "'AV SN 2'"], _C, 'd')} AS address, {pick(quoted(['STREET', '']), _C, 'e')} AS street, {pick(quoted(['TOWN', '']), _C, 'f')} AS city, {pick(quoted(['gomc-80 02', 'X1']), _C, 'g')} AS number, {pick(quoted(['key 1', '']), _C, 'h')} AS voter_key,
  {pick(quoted(['1999 00', 'in 2004', '1899', '']), _C, 'i')} AS registered, {pick(quoted(['12-34', '123', 'S 0001']), _C, 'j')} AS section FROM {{customer}}"""
_KEYS = {"names": "surnameAndGivenNames", "surname": "surname", "given": "givenNames", "address": "address", "street": "addressStreet", "city": "addressCity", "number": "personalNumber", "voter_key": "voterKey", "registered": "dateOfRegistration", "section": "section"}
_HELD = ("name", "surname", "given_names", "first_surname", "second_surname", "address", "personal_number", "elector_key", "curp", "registration_year", "section")


def visual_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A holder's data from the fields that a layout gave."""
    held = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for c, k in _KEYS.items())), lambda e: e["v"] != ""))
    rows = made(spark, sf_dir, HOLDERS).select("key", "voter", F.explode(F.array(held)).alias("m"))
    return rows.select("key", F.explode(F.array(layouts.visual_result(F.col("m"), F.col("voter")))).alias("r")).select("key", *(f"r.{c}" for c in _HELD))


OUTPUTS = f"""SELECT c_custkey AS key, CAST({dice(_C, 'a', 100)} AS DOUBLE) / 100 AS v1, CAST({dice(_C, 'b', 100)} AS DOUBLE) / 100 AS v2, {dice(_C, 'c', 3)} AS n FROM {{customer}}"""


def threshold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a model against the thresholds of its configuration; as many of both, or nothing is told."""
    outputs = F.slice(F.array("v1", "v2", "v1"), F.lit(1), F.col("n") + 1)
    rows = made(spark, sf_dir, OUTPUTS).select("key", imaging.threshold_results(outputs, F.array(F.lit(0.25), F.lit(0.5))).alias("r"))
    return rows.select("key", F.explode_outer("r").alias("x")).select("key", "x.index", "x.value", F.round("x.margin", 6).alias("margin"), F.col("x.above").cast("int").alias("above"))


_PART = lambda name, values, salt: f"""'"{name}":' || {pick(values, 'p_partkey', salt)}"""
HINTS = f"""SELECT p_partkey AS key, '{{{{"capture":{{{{' || {_PART('dUVExp', quoted(['3', 'null', '0']), 'a')} || ',"other":1}}}},"recognition":{{{{' || {_PART('recognTag', quoted(['"x y"', 'null']), 'b')} || ',' || {_PART('dMRZHeight', quoted(['55', 'false']), 'c')} || '}}}}' || {pick(quoted(['', ',"authenticityConfiguration":{"dAuthenticity":7,"authenticity":{"fibers":[1,2]}}']), 'p_partkey', 'd')} || '}}}}' AS hints FROM {{part}}"""


def layout_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What layouts ask for, from hints of which some parts are null or missing."""
    r = F.col("r")
    rows = made(spark, sf_dir, HINTS).select("key", layouts.requirements(F.col("hints")).alias("r"))
    get = lambda g, k: F.try_element_at(r[g], F.lit(k))
    return rows.select("key", get("capture", "uvExposure").alias("uv"), get("recognition", "tag").alias("tag"), get("recognition", "mrzHeight").alias("height"), get("authenticityConfiguration", "checkMask").alias("mask"), get("parameters", "fibers").alias("fibers"), F.size(r["capture"]).alias("n_capture"), F.size(r["recognition"]).alias("n_recognition"))


_R = "CAST(c_custkey AS STRING) || '.' || CAST(n AS STRING)"
#: Twelve readings of a CURP, and of lines of names, of each card.
GRID = f"""SELECT c_custkey AS doc_id, n AS no, n % 3 AS line, {pick(quoted(['GOMC800215HDFRRR0', 'gomc-800215-HDFRRR0', 'GOMC810215MDFRRRA', 'X']), _R, 'a')} || CAST({dice(_R, 'e', 10)} AS STRING) AS curp, {pick(["0.95", "0.9", "0.89", "0.99"], _R, 'b')} AS confidence, {pick(quoted(['ABCDEF800215XXXXXX', 'ABCDEF810215XXXXXX', 'short', None]), 'c_custkey', 'c')} AS voter_key,
  {pick(quoted(['GOMEZ', 'GOMEZ  DIAZ', 'gomez', 'MORA', 'MORALES', 'CARLA', 'CARLA M', 'G0MEZ', 'C']), _R, 'd')} AS name FROM {{customer}} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11) AS twelve"""


def voter_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card's CURP and names from readings of their grids."""
    rows = made(spark, sf_dir, GRID).withColumn("confidence", F.col("confidence").cast("double"))
    curp = readings.curp_of_grid(rows.select("doc_id", "no", F.col("curp").alias("text"), "confidence", "voter_key"))
    names = readings.names_of_grid(rows.select("doc_id", "line", "no", F.col("name").alias("text"), "confidence", F.lit("GOMC800215HDFRRR05").alias("personal_number")))
    return names.join(curp, "doc_id", "left").select("doc_id", F.array_join("names", "/").alias("names"), F.round(F.aggregate("confidences", F.lit(0.0), lambda s, x: s + x), 6).alias("sure"), "curp", "confidence")


QUERIES = {f.__name__: f for f in (voter_grids, layout_requirements, symbol_correlation, aamva_results, belarus_supplement, mexican_supplement, field_recognition, visual_results, threshold_checks)}

_MEND = "CASE WHEN contains(zone, {x}) THEN {x} ELSE coalesce((SELECT min(substr(zone, i, length({x}))) FROM range(1, greatest(length(zone) - length({x}) + 2, 1)) AS r(i) WHERE length({x}) > 0 AND hamming(substr(zone, i, length({x})), {x}) = 1), {x}) END"
_JSON = "nullif(json_extract(hints, '$.{0}')::VARCHAR, 'null')"
ORACLES = {
    "voter_grids": f"""WITH g AS ({view(GRID)}), c AS (SELECT doc_id, no, confidence::DOUBLE AS confidence, voter_key, line, upper(regexp_replace(curp, '[^A-Za-z0-9]', '', 'g')) AS x, trim(regexp_replace(upper(name), '\\s+', ' ', 'g')) AS v FROM g),
        s AS (SELECT *, list_sum([(instr('0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ', substr(x, i, 1)) - 1) * (19 - i) for i in range(1, 18)])::INT AS s FROM c),
        k AS (SELECT * FROM s WHERE confidence >= 0.9 AND regexp_full_match(x, '[A-Z][AEIOUX][A-Z]{{2}}[0-9]{{6}}[HM][A-Z]{{5}}[A-Z0-9][0-9]') AND (10 - s % 10) % 10 = TRY_CAST(substr(x, 18, 1) AS INT) AND (coalesce(length(voter_key), 0) <> 18 OR substr(x, 5, 6) = substr(voter_key, 7, 6))),
        u AS (SELECT doc_id, x, max(confidence) AS c, min(no) AS f FROM k GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) AS p FROM u),
        n AS (SELECT doc_id, line, v, max(confidence) AS c, min(no) AS f FROM c WHERE confidence >= 0.9 AND regexp_full_match(v, '[A-ZÁÉÍÓÚÜÑ ]{{2,40}}') AND starts_with(v, substr('GMC', line + 1, 1)) GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY length(replace(v, ' ', '')) DESC, c DESC, f) AS p FROM n),
        j AS (SELECT doc_id, coalesce(max(v) FILTER (line = 0), '') || '/' || coalesce(max(v) FILTER (line = 1), '') || '/' || coalesce(max(v) FILTER (line = 2), '') AS names, sum(c) AS sure FROM o WHERE p = 1 GROUP BY doc_id), d AS (SELECT DISTINCT doc_id FROM g)
        SELECT d.doc_id, coalesce(names, '//') AS names, round(coalesce(sure, 0), 6)::DOUBLE AS sure, w.x AS curp, w.c AS confidence FROM d LEFT JOIN j ON d.doc_id = j.doc_id LEFT JOIN w ON d.doc_id = w.doc_id AND w.p = 1""",
    "layout_requirements": f"""WITH h AS ({view(HINTS)}), v AS (SELECT key, {_JSON.format('capture.dUVExp')} AS uv, json_extract_string(hints, '$.recognition.recognTag') AS tag, {_JSON.format('recognition.dMRZHeight')} AS height, {_JSON.format('authenticityConfiguration.dAuthenticity')} AS mask, {_JSON.format('authenticityConfiguration.authenticity.fibers')} AS fibers FROM h)
        SELECT *, (uv IS NOT NULL)::INT AS n_capture, (tag IS NOT NULL)::INT + (height IS NOT NULL)::INT AS n_recognition FROM v""",
    "symbol_correlation": f"""WITH s AS ({view(SYMBOLS)}), p AS (SELECT *, regexp_extract(text, '^([A-Za-z]+)://([^/:]+)(?::[0-9]+)?/+([^/?#]+)/+([^/?#]+)/+([^/?#]+)/+([^/?#]+)/*(?:[?#].*)?$', ['scheme', 'host', 'a', 'b', 'c', 'd']) AS x FROM s),
        o AS (SELECT *, lower(x.scheme) IN ('http', 'https') AND lower(x.host) = 'qr.ine.mx' AND regexp_full_match(x.a, '[0-9]+') AND regexp_full_match(x.b, '[0-9]{{8}}') AND length(x.c) = 1 AND regexp_full_match(x.d, '[0-9]+') AND TRY_CAST(substr(x.b, 1, 4) || '-' || substr(x.b, 5, 2) || '-' || substr(x.b, 7, 2) AS DATE) IS NOT NULL AS ok FROM p),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM o WHERE ok AND format = 'QRCode') WHERE k = 1),
        n AS (SELECT doc_id, arg_min(text, seq) AS number FROM s WHERE format = 'Code128' AND regexp_full_match(text, '[0-9]+') GROUP BY doc_id), d AS (SELECT DISTINCT doc_id FROM s)
        SELECT d.doc_id, f.x.a AS document_number, substr(f.x.b, 1, 4) || '-' || substr(f.x.b, 5, 2) || '-' || substr(f.x.b, 7, 2) AS date_of_issue, f.x.c AS credential_type, f.x.d AS query_identifier, CASE WHEN f.doc_id IS NOT NULL THEN coalesce(n.number, '') END AS barcode_number, f.decoder AS engine, CASE WHEN f.doc_id IS NOT NULL THEN 'MEX-INE-QR' END AS profile, CASE WHEN f.doc_id IS NOT NULL THEN 1 END AS status
        FROM d LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "belarus_supplement": f"""WITH p AS ({view(PASSPORTS)}), d AS (SELECT *, regexp_replace(issued, '[^0-9]', '', 'g') AS n, starts_with(upper(regexp_replace(stamp, '[^A-Za-z]', '', 'g')), 'SAMI') AS specimen FROM p)
        SELECT key, CASE issuer WHEN 'BLR' THEN 'Belarus' WHEN 'MEX' THEN 'Mexico' WHEN 'SWE' THEN 'Sweden' END AS issuer_name, CASE raw_key WHEN 'surname1' THEN 'firstSurname' WHEN 'address2' THEN 'addressLine2' WHEN 'other' THEN NULL ELSE raw_key END AS output_key, trim(authority) AS authority, CASE WHEN trim(authority) = '709' THEN 'УВД АДМИНИСТРАЦИИ ФРУНЗЕНСКОГО РАЙОНА Г.МИНСКА' ELSE '' END AS authority_name, trim(place) AS place_of_birth,
          coalesce(CASE WHEN length(n) = 8 THEN TRY_CAST(substr(n, 5, 4) || '-' || substr(n, 3, 2) || '-' || substr(n, 1, 2) AS DATE)::VARCHAR END, trim(issued)) AS date_of_issue, CASE WHEN specimen THEN 'SPECIMEN' ELSE '' END AS document_status, CASE WHEN specimen THEN 0 ELSE status END AS status FROM d""",
    "mexican_supplement": f"""WITH v AS ({view(VISUALS)}), z AS (SELECT *, replace(translate(substr(line, 6), '0158', 'OISB'), '<', '') AS zone FROM v),
        w AS (SELECT key, zone, unnest(['s', 'g']) AS f, unnest([string_split(trim(regexp_replace(surname, '\\s+', ' ', 'g')), ' '), string_split(trim(regexp_replace(given, '\\s+', ' ', 'g')), ' ')]) AS l FROM z),
        x AS (SELECT key, zone, f, unnest(range(len(l))) AS k, unnest(l) AS w FROM w), n AS (SELECT key, zone, f, k, translate(upper(w), '0', 'O') AS w FROM x WHERE w <> ''), m AS (SELECT key, f, k, {_MEND.format(x='w')} AS w FROM n),
        j AS (SELECT key, coalesce(string_agg(w, ' ' ORDER BY k) FILTER (f = 's'), '') AS surname, coalesce(string_agg(w, ' ' ORDER BY k) FILTER (f = 'g'), '') AS given FROM m GROUP BY key),
        c AS (SELECT z.key, line, c1, c2, n1, n2, k1, k2, place, folio, issued, coalesce(j.surname, '') AS surname, coalesce(j.given, '') AS given, upper(regexp_replace(number, '[^A-Za-z0-9]', '', 'g')) AS x, regexp_replace(issued, '[^0-9]', '', 'g') AS d,
          translate(upper(trim(n1)), '0', 'O') = 'MEXICANA' AS m1, translate(upper(trim(n2)), '0', 'O') = 'MEXICANA' AS m2 FROM z LEFT JOIN j ON z.key = j.key)
        SELECT key, CASE WHEN (m2, k2) > (m1, k1) THEN 1 ELSE 0 END AS profile, surname, given AS given_names, trim(surname || ' ' || given) AS name, translate(upper(trim(n1)), '0', 'O') AS nationality,
          CASE WHEN length(x) = 18 THEN translate(substr(x, 1, 4), '0158', 'OISB') || translate(substr(x, 5, 6), 'OQILS', '00115') || translate(substr(x, 11, 6), '0158', 'OISB') || substr(x, 17, 2) ELSE x END AS personal_number, translate(upper(trim(place)), '0', 'O') AS place_of_birth,
          CASE WHEN length(d) = 8 THEN coalesce(TRY_CAST(substr(d, 5, 4) || '-' || substr(d, 3, 2) || '-' || substr(d, 1, 2) AS DATE)::VARCHAR, '') ELSE '' END AS date_of_issue, CASE WHEN regexp_full_match(folio, '[0-9]+') THEN folio ELSE '' END AS folio_number,
          CASE WHEN c1 >= 0.85 AND c2 >= 0.85 THEN rpad(substr(line, 1, 5) || replace(surname, ' ', '<') || '<<' || replace(given, ' ', '<'), 44, '<') ELSE line END AS first_line FROM c""",
    "field_recognition": f"""WITH RECURSIVE r AS ({view(READ)}), t AS (SELECT *, regexp_replace(said, '^[ <]+|[ <]+$', '', 'g') AS text FROM r), u AS (SELECT *, regexp_replace(text, '[^\\pL\\pN]', '', 'g') AS plain FROM t WHERE text <> ''),
        m AS (SELECT *, round(0.15 - 0.03 * abs(length(plain) - 6), 6) AS mask FROM u),
        s AS (SELECT *, round(confidence + mask + CASE WHEN field = 'surname' THEN CASE WHEN regexp_matches(text, '[0-9]') THEN -0.4 ELSE 0.05 END ELSE 0 END + CASE WHEN wanted <> 1034 THEN 0 WHEN model = 0 THEN 0.2 WHEN regexp_full_match(text, '[\\x00-\\x7f]*') THEN -0.2 ELSE 0.05 END, 6) AS score FROM m),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field, window_no ORDER BY score DESC, seq) AS k FROM s), e AS (SELECT doc_id, field, arg_min(text, window_no) AS text, arg_min(confidence, window_no) AS confidence FROM b WHERE k = 1 AND row_limit = 1 AND confidence >= 0.995 AND score >= 0.995 AND mask >= 0 GROUP BY doc_id, field),
        f AS (SELECT *, max(confidence >= 0.18) OVER (PARTITION BY doc_id, field) AS sure FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, seq) AS k FROM f WHERE confidence >= 0.18 OR NOT sure), q AS (SELECT * FROM o WHERE sure OR k = 1),
        g AS (SELECT doc_id, field, 0::BIGINT AS k, []::STRUCT(c DOUBLE, t VARCHAR, p DOUBLE)[] AS kept FROM q GROUP BY 1, 2
          UNION ALL SELECT g.doc_id, g.field, q.k, CASE WHEN len(kept) >= q.row_limit OR len(list_filter(kept, lambda x: abs(x.c - q.centre) < 0.1 * 0.7)) > 0 THEN kept ELSE list_append(kept, {{'c': q.centre, 't': q.text, 'p': q.confidence}}) END FROM g JOIN q ON g.doc_id = q.doc_id AND g.field = q.field AND q.k = g.k + 1),
        h AS (SELECT doc_id, field, list_sort(arg_max(kept, k)) AS kept FROM g GROUP BY doc_id, field)
        SELECT h.doc_id, h.field, coalesce(e.text, array_to_string([x.t for x in kept], chr(10))) AS value, round(coalesce(e.confidence, list_avg([x.p for x in kept])), 6) AS confidence FROM h LEFT JOIN e ON h.doc_id = e.doc_id AND h.field = e.field""",
    "visual_results": f"""WITH h AS ({view(HOLDERS)}), l AS (SELECT *, list_filter([trim(x) for x in string_split(names, chr(10))], lambda x: x <> '') AS ls, list_filter([trim(x) for x in string_split(address, chr(10))], lambda x: x <> '') AS a, list_filter([street, city], lambda x: x <> '') AS parts, regexp_replace(section, '[^0-9]', '', 'g') AS sd, upper(regexp_replace(number, '[^A-Za-z0-9]', '', 'g')) AS pn FROM h),
        n AS (SELECT *, voter AND len(ls) >= 3 AS three, CASE WHEN len(a) > 0 THEN a ELSE parts END AS lines FROM l),
        o AS (SELECT *, CASE WHEN three THEN ls[1] || ' ' || ls[2] ELSE surname END AS s, CASE WHEN three THEN array_to_string(ls[3:], ' ') ELSE given END AS g, CASE WHEN voter THEN [regexp_replace(x, '\\bSN\\b', 'S/N', 'g') for x in lines] ELSE lines END AS ad FROM n)
        SELECT key, CASE WHEN names <> '' THEN replace(names, chr(10), ' ') ELSE trim(s || ' ' || g) END AS name, s AS surname, g AS given_names, CASE WHEN three THEN ls[1] END AS first_surname, CASE WHEN three THEN ls[2] END AS second_surname, array_to_string(ad, ', ') AS address,
          CASE WHEN voter THEN pn ELSE number END AS personal_number, CASE WHEN voter THEN upper(regexp_replace(voter_key, '[^A-Za-z0-9]', '', 'g')) END AS elector_key, CASE WHEN voter THEN pn END AS curp, CASE WHEN voter THEN nullif(regexp_extract(registered, '((?:19|20)[0-9]{{2}})', 1), '') END AS registration_year,
          CASE WHEN voter THEN CASE WHEN length(sd) = 4 THEN sd END ELSE section END AS section FROM o""",
    "threshold_checks": f"""WITH o AS ({view(OUTPUTS)}), x AS (SELECT key, unnest(CASE WHEN n = 1 THEN [0, 1] ELSE [NULL] END) AS i, v1, v2 FROM o) SELECT key, i::INT AS index, CASE i WHEN 0 THEN v1 WHEN 1 THEN v2 END AS value, round(CASE i WHEN 0 THEN v1 - 0.25 WHEN 1 THEN v2 - 0.5 END, 6) AS margin, CASE i WHEN 0 THEN v1 >= 0.25 WHEN 1 THEN v2 >= 0.5 END::INT AS above FROM x""",
}


def _aamva_results() -> str:
    from .payloads import ORACLES as payloads

    inner = payloads["aamva_parse"]
    return f"""WITH p AS ({inner.replace("array_to_string(list_filter([DAG", "DAC AS given, array_to_string(list_filter([DAG")})
        SELECT key, 'Driver License' AS document_name, 'USA' AS country, "documentNumber" AS document_number, "familyName" AS surname, given AS given_names, trim("familyName" || ' ' || given) AS surname_and_given_names, CASE WHEN "headerValid" THEN 1 ELSE -1 END AS status, 'AAMVA-PDF417' AS profile FROM p"""


ORACLES["aamva_results"] = _aamva_results()
