"""Named queries over payloads, masks and uploads made from orders, customers, parts and pages.

Each input is made by one SQL text that both engines run, with variants chosen by a digest of the key, and told apart by nothing else.
The oracles read the same texts in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import barcodes, masks, national, text
from ..operators import layouts
from ..plans import router
from ..sources import images
from ..sources.tables import table


def dice(key: str, salt: str, n: int) -> str:
    """SQL: a number below n that depends on the key."""
    d = f"md5('{salt}' || CAST({key} AS STRING))"
    return f"((ascii(substr({d}, 1, 1)) * 37 + ascii(substr({d}, 2, 1)) * 11 + ascii(substr({d}, 3, 1))) % {n})"


def pick(values: list, key: str, salt: str) -> str:
    """SQL: one of the values (SQL texts, or None), by the key."""
    cases = " ".join(f"WHEN {k} THEN {'NULL' if v is None else v}" for k, v in enumerate(values))
    return f"CASE {dice(key, salt, len(values))} {cases} END"


def quoted(values: list) -> list:
    """SQL texts of strings. Braces are doubled: table names are put in by formatting."""
    return [None if v is None else "'" + v.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'" for v in values]


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = ("customer", "orders", "part", "pages")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names if f"{{{n}}}" in sql})


def view(sql: str) -> str:
    return sql.format(customer="customer", orders="orders", part="part", pages="pages")


_O, _C, _P = "o_orderkey", "c_custkey", "page_id"
_ISO = "substr(CAST(o_orderdate AS STRING), 1, 10)"
_YMD = f"replace({_ISO}, '-', '')"

URLS = f"""SELECT o_orderkey AS key, {pick(quoted(['https', 'http', 'HTTPS', 'ftp', 'https']), _O, 'a')} || '://' || {pick(quoted(['qr.ine.mx', 'qr.ine.mx', 'QR.ine.MX', 'qr.example.org', 'qr.ine.mx:443', 'xqr.ine.mx']), _O, 'b')}
  || {pick(quoted(['/', '/', '//']), _O, 'c')} || {pick(["CAST(o_orderkey AS STRING)", "CAST(o_orderkey AS STRING)", "'A' || CAST(o_orderkey AS STRING)"], _O, 'd')} || '/' || {pick([_YMD, _YMD, "'20231345'", "'2023011'", "'20230229'"], _O, 'e')}
  || '/' || {pick(quoted(['X', 'Y', '7', 'XY', '-']), _O, 'f')} || '/' || CAST(o_custkey AS STRING) || {pick(quoted(['', '', '/', '?x=1', '#top', '/more', 'b']), _O, 'g')} AS url FROM {{orders}}"""


def verification_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = barcodes.verification_url(F.col("url"))
    return made(spark, sf_dir, URLS).select("key", told["identifier"].alias("identifier"), told["issueDate"].alias("issue_date"), told["type"].alias("type"), told["queryIdentifier"].alias("query_identifier"))


_BORN = pick(["'03' || '21' || '1980'", "'1980' || '12' || '31'", "'13011980'", "'02301980'", "''", "'03-21-1980'"], _C, "b")
_LINE = lambda code, values, salt: f"CASE WHEN {dice(_C, salt + 'x', 6)} = 0 THEN '' ELSE {pick(quoted([f'{code}']), _C, salt)} || {pick(values, _C, salt + 'y')} || {pick(['chr(10)', 'chr(13)', 'chr(10) || chr(30)'], _C, salt + 'z')} END"
#: Records with an ANSI header or none, lines that are missing or come twice, in changing order, with blanks and record separators.
AAMVA = f"""SELECT c_custkey AS key, {pick(["'@' || chr(10) || chr(30) || chr(13) || 'ANSI 636000090002DL00410278ZV03190008DL'", "'@' || chr(10) || 'ANSI 636000090002DL'", "'ANSI 6360DL'", "''"], _C, 'h')}
  || 'DAQ' || CAST(c_custkey AS STRING) || chr(10) || {_LINE('DCS', ['c_name', "' ' || c_name || ' '"], 's')} || {_LINE('DAC', quoted(['JANE', 'ANA MARIA']), 'f')} || {_LINE('DBB', [_BORN], 'd')} || {_LINE('DBC', quoted(['1', '2', '9', '3']), 'c')}
  || {_LINE('DAG', quoted(['1 MAIN ST']), 'g')} || {_LINE('DAI', quoted(['TOWN', 'OTHER DAK']), 'i')} || {_LINE('DAJ', quoted(['AZ', 'NY']), 'j')} || {_LINE('DAK', quoted(['12345  ', '99']), 'k')} || {_LINE('DCS', quoted(['LAST']), 't')} || {_LINE('ZZZ', quoted(['none']), 'u')} AS payload FROM {{customer}}"""
_SHOWN = ("headerValid", "documentNumber", "familyName", "firstName", "dateOfBirth", "sex", "address")


def aamva_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, AAMVA).select("key", F.explode(F.array(barcodes.parsed_aamva(F.col("payload")))).alias("p"))
    return rows.select("key", *(f"p.{c}" for c in _SHOWN), F.array_join("p.availableDesignators", ",").alias("designators"))


EVIDENCE = f"""SELECT page_id AS key, {pick(["url", "url || '<NUL>'", "repeat('x', CAST(page_id % 700 AS INT))", "'ab' || repeat(chr(1), CAST(page_id % 3 AS INT))", "'  '", "repeat('word ', 30) || repeat(chr(2), CAST(page_id % 40 AS INT))", "url || '<U+0001>'"], _P, 'a')} AS said,
  {dice(_P, 'b', 5)} > 0 AS valid, {pick(quoted(['PDF417', 'QRCode', 'Code128']), _P, 'c')} AS symbology, {dice(_P, 'd', 2)} = 1 AS header, {dice(_P, 'e', 3)} AS designators FROM {{pages}}"""


def barcode_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, EVIDENCE).select("key", barcodes.is_evidence(F.col("said"), F.col("valid"), F.col("symbology"), F.col("header"), F.col("designators")).alias("evidence"))


ROUTING = f"""SELECT o_orderkey AS key, {pick(quoted(['auto_research', 'aamva_pdf417', 'icao_td1', 'auto_research']), _O, 'a')} AS profile, {pick(quoted([None, None, 'mex_ine', 'other', 'swe_id_2021']), _O, 'b')} AS layout, {pick(quoted([None, None, 'td1', 'td3', 'mrv', 'x']), _O, 'c')} AS zone FROM {{orders}}"""


def pdf417_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, ROUTING).select("key", barcodes.scan_pdf417(F.col("profile"), F.col("layout"), F.col("zone")).alias("scan"))


SEEN = f"""SELECT o_orderkey AS doc_id, {pick(quoted(['auto_research', 'auto_research', 'auto_research', 'mex_ine', 'aamva_pdf417', 'icao_td1', 'icao_td2', 'icao_td3', 'mex_passport', 'icao_mrv', 'swe_id_2021']), _O, 'a')} AS profile,
  {dice(_O, 'b', 9)} = 0 AS aamva_valid, {dice(_O, 'c', 7)} = 0 AS td1_shaped, {dice(_O, 'd', 4)} AS mrv_checks, {dice(_O, 'e', 5)} AS td2_checks, {dice(_O, 'f', 6)} AS td3_checks, {pick(quoted([None, None, 'mex_ine', 'swe_id_2021']), _O, 'g')} AS layout_hint,
  {pick(quoted([None, None, None, 'td3', 'mrv']), _O, 'h')} AS mrz_hint, {dice(_O, 'i', 4)} = 0 AS ine_accepted, {dice(_O, 'j', 8)} = 0 AS swe_accepted, {dice(_O, 'k', 6)} = 0 AS ine_qr, {dice(_O, 'l', 3)} = 0 AS catalog_evidence FROM {{orders}}"""


def document_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which route each order's image takes, from what was observed of it."""
    seen = made(spark, sf_dir, SEEN)
    return seen.select("doc_id", router.route(seen).alias("route"))


CURPS = f"""SELECT c_custkey AS key, {pick(["'GOMC'", "'gomc'", "'GBMC'", "'MAÑJ'"], _C, 'a')} || lpad(CAST(c_custkey % 90 + 10 AS STRING), 2, '0') || '0215' || {pick(quoted(['H', 'M', 'H', 'M', 'X']), _C, 'b')} || {pick(quoted(['DFRRR', 'MCXYZ']), _C, 'c')} || {pick(quoted(['0', 'A', '9']), _C, 'd')} || CAST({dice(_C, 'e', 10)} AS STRING) || {pick(quoted(['', '', '', '1']), _C, 'f')} AS curp FROM {{customer}}"""


def curp_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, CURPS).select("key", national.curp_valid(F.col("curp")).alias("valid"))


DATES = f"""SELECT o_orderkey AS key, {pick(quoted(['{DAY}/{MONTH_DD}/{YEAR}', '{YEAR}-{MONTH_LZ}-{DAY_DD}|{TEXT}', '{DAY} {MONTH_SPA} {YEAR}', '{Month_Ccc} {DAY}, {YEAR_DD}', '{DAY} {MONTH} {YEAR}', '{TEXT}', '{DAY}.{MONTH_DD}']), _O, 'a')} AS mask,
  {pick([f"substr({_ISO}, 9, 2) || '/' || substr({_ISO}, 6, 2) || '/' || substr({_ISO}, 1, 4)", _ISO, f"substr({_ISO}, 9, 2) || ' ' || {pick(quoted(['ENE', 'abr', 'Dic.', 'JAN', 'AGO']), _O, 'm')} || ' ' || substr({_ISO}, 1, 4)", f"{pick(quoted(['Feb', 'SEPT', 'Foo']), _O, 'n')} || ' 3, ' || substr({_ISO}, 3, 2)", "'31/02/2024'", "'12 2024'", f"substr({_ISO}, 9, 2) || '-' || substr({_ISO}, 6, 2) || '-' || substr({_ISO}, 3, 2)"], _O, 'b')} AS shown FROM {{orders}}"""


def mask_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, DATES).select("key", masks.date_valid(F.col("mask"), F.col("shown")).cast("string").alias("valid"))


_PIECES = quoted(["{TEXT}", "{STRINGS}", "DDWC", '{8D"x"}', "-{2D}", "CC{3D}", "{Sex_MF}", "", "\n", "{YEAR}", "D-D"])
SHAPES = f"""SELECT p_partkey AS key, {pick(_PIECES, 'p_partkey', 'a')} || {pick(_PIECES, 'p_partkey', 'b')} || {pick(_PIECES, 'p_partkey', 'c')} || {pick(quoted(['', '|DDDD', '|{TEXT}']), 'p_partkey', 'd')} AS mask FROM {{part}}"""


def mask_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("mask")
    return made(spark, sf_dir, SHAPES).select("key", masks.line_count(m).alias("lines"), masks.expected_length(m).alias("length"), F.array_join(masks.tokens(m), ",").alias("tokens"))


SCORES = f"""SELECT c_custkey AS key, {pick(quoted(['{8D}', 'DDDDDDDD', 'CDDD{2D}', '{Sex_MF}', '{YEAR}', '{POUNDS}', '{Country_Code}', '{MONTH_DD}', '{DAY}', '{STATE_CODE_AUS}', '', '{KGS}', '{TEXT}']), _C, 'a')} AS mask,
  {pick(["lpad(CAST(c_custkey AS STRING), 8, '0')", "'A' || lpad(CAST(c_custkey AS STRING), 5, '0')", "'M'", "CAST(1850 + c_custkey % 200 AS STRING)", "CAST(c_custkey % 600 AS STRING)", "substr(c_mktsegment, 1, 3)", "CAST(c_custkey % 40 AS STRING)", "''", "'NSW'", "'12 lbs'", "CAST(c_custkey % 30 AS STRING) || ' kg'"], _C, 'b')} AS value FROM {{customer}}"""


def mask_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How customers' values fit masks of several kinds."""
    rows = made(spark, sf_dir, SCORES).withColumn("folded", F.upper(F.regexp_replace("value", "[^A-Za-z]", "")))
    return rows.select("key", F.round(masks.compatibility(F.col("mask"), F.col("value"), F.col("folded")), 6).alias("score"))


CAPTIONS = f"""SELECT p_partkey AS key, {pick(quoted(['Card', 'Booklet', 'Sheet front', 'Frontispage']), 'p_partkey', 'a')} || ' ' || {pick(quoted(['front', 'Side B', 'page 3', 'PAGE C', 'side  12', 'page 0', 'Front Cover', 'reverse', 'plain', 'back cover', 'page  x y', 'pages 4']), 'p_partkey', 'b')} || {pick(quoted(['', ' 2021', ' page 7']), 'p_partkey', 'c')} AS caption FROM {{part}}"""


def page_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, CAPTIONS).select("key", layouts.declared_ordinal(F.col("caption")).alias("ordinal"), layouts.caption_role(F.col("caption")).alias("r"))
    return rows.select("key", "ordinal", "r.role", F.col("r.ordinal").alias("page"))


UPLOADS = f"""SELECT page_id AS key, {pick(quoted(['page', 'a.b/page', 'x.tar', '.hidden', 'dir.d/']), _P, 'a')} || {pick(quoted(['.png', '.JPEG', '.gif', '', '.heic', '.Heif', '.jpg']), _P, 'b')} AS name, CASE WHEN {dice(_P, 'c', 9)} = 0 THEN '' ELSE html END AS content FROM {{pages}}"""


def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, UPLOADS)
    told = images.upload_error(F.col("content").cast("binary"), F.col("name"), most_bytes=2000)
    return rows.select("key", images.suffix(F.col("name")).alias("suffix"), told.alias("error"), images.http_status(told).alias("status"))


ENCODED = f"""SELECT page_id AS key, {pick(quoted(['', 'data:image/png;base64,', 'data:,', '  ']), _P, 'a')} || {{base64}} || {pick(quoted(['', '', '*', '=', '  ']), _P, 'b')} AS given FROM {{pages}}"""


def base64_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sources as base64, plain or as data URLs, some with a stray character."""
    rows = made(spark, sf_dir, ENCODED.replace("{base64}", "base64(CAST(substr(html, 1, 300) AS BINARY))"))
    return rows.select("key", F.sha2(images.decoded_base64(F.col("given")), 256).alias("sha256"))


KEYS = f"""SELECT c_custkey AS key, c_name || {pick(quoted([' - ', ' ', '/', '']), _C, 'a')} || c_mktsegment AS name, {pick(["'21/03/1980'", "'1980-03-21'", "'21.3.1980'", "'1980/03/21 x'", "''", "'21 MAR 1980'", "CAST(c_custkey AS STRING)"], _C, 'b')} AS day FROM {{customer}}"""


def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, KEYS).select("key", text.ascii_key(F.col("name")).alias("name"), text.date_key(F.col("day")).alias("day"))


_LATIN, _CYRILLIC = "ABCDEFGHIKLMNOPRSTUVYZ", "АБЦДЕФГХИКЛМНОПРСТУВЫЗ"
_TOLD = "replace(replace({x}, 'C', 'TS'), 'H', 'KH')"
SCRIPTS = f"""SELECT c_custkey AS key, {pick(["translate(c_mktsegment, '" + _LATIN + "', '" + _CYRILLIC + "')", "lower(translate(c_mktsegment, '" + _LATIN + "', '" + _CYRILLIC + "'))", "c_mktsegment", "''"], _C, 'a')} AS a, {pick(["c_mktsegment", _TOLD.format(x='c_mktsegment'), "substr(" + _TOLD.format(x='c_mktsegment') + ", 1, 4)", "'ANOTHER'", "NULL", "lower(" + _TOLD.format(x='c_mktsegment') + ") || ' X'"], _C, 'b')} AS b FROM {{customer}}"""


def cross_script_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two names can be the same, of which one may be written in Cyrillic."""
    rows = made(spark, sf_dir, SCRIPTS).select("key", text.icao_variants(F.col("a")).alias("x"), text.icao_variants(F.col("b")).alias("y"))
    return rows.select("key", text.compatible(F.col("x"), F.col("y")).cast("int").alias("compatible"))


QUERIES = {f.__name__: f for f in (cross_script_names, verification_urls, aamva_parse, barcode_evidence, pdf417_routing, document_routes, curp_check, mask_dates, mask_shapes, mask_scores, page_ordinals, upload_checks, base64_images, identity_keys)}


# --- the oracles ---

_CODES = "DCS DAC DAD DBB DBA DBD DBC DAY DAU DAG DAH DAI DAJ DAK DAQ DCF DCG DAZ".split()
_ANY = "(?:" + "|".join(_CODES) + ")"


def _field(code: str) -> str:
    """The value of the last line with a designator."""
    return f"coalesce(trim(substr(list_filter(lines, lambda x: starts_with(x, '{code}'))[-1], 4)), '')"


def _mask_lists(m: str) -> str:
    """primary, named tokens, numbers of digits, and what stands outside braces."""
    return f"""*, split_part({m}, '|', 1) AS p, regexp_extract_all(split_part({m}, '|', 1), '\\{{([^}}\\["\\s]+)', 1) AS t, [x::INT for x in regexp_extract_all(split_part({m}, '|', 1), '\\{{(\\d+)D(?:"[^"]*")?\\}}', 1)] AS n, regexp_replace(split_part({m}, '|', 1), '\\{{[^}}]*\\}}', '', 'g') AS free"""


#: Any token of a language is read with the words of all languages.
_WORDS = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in words)}) THEN {k}" for k, words in enumerate((("JAN", "ENE"), ("FEB",), ("MAR",), ("APR", "ABR"), ("MAY",), ("JUN",), ("JUL",), ("AUG", "AGO"), ("SEP", "SEPT"), ("OCT",), ("NOV",), ("DEC", "DIC")), 1)) + " END"
_PLAIN = "regexp_replace(value, '[^\\pL\\pN]', '', 'g')"
_FOLD = "replace(replace(translate({x}, '" + _CYRILLIC.replace("Ц", "").replace("Х", "") + "', '" + _LATIN.replace("C", "").replace("H", "") + "'), 'Ц', 'TS'), 'Х', 'KH')"
ORACLES = {
    "cross_script_names": f"""WITH s AS ({view(SCRIPTS)}), k AS (SELECT key, upper(regexp_replace(a, '[^\\pL\\pN]', '', 'g')) AS a, upper(regexp_replace(coalesce(b, ''), '[^\\pL\\pN]', '', 'g')) AS b FROM s), v AS (SELECT key, a, {_FOLD.format(x='a')} AS t, b FROM k)
        SELECT key, CASE WHEN a <> '' AND b <> '' THEN (starts_with(a, b) OR starts_with(b, a) OR starts_with(t, b) OR starts_with(b, t))::INT END AS compatible FROM v""",
    "verification_urls": f"""WITH u AS ({view(URLS)}), p AS (SELECT key, regexp_extract(url, '^([A-Za-z]+)://([^/:]+)(?::[0-9]+)?/+([^/?#]+)/+([^/?#]+)/+([^/?#]+)/+([^/?#]+)/*(?:[?#].*)?$', ['scheme', 'host', 'a', 'b', 'c', 'd']) AS x FROM u),
        o AS (SELECT *, lower(x.scheme) IN ('http', 'https') AND lower(x.host) = 'qr.ine.mx' AND regexp_full_match(x.a, '[0-9]+') AND regexp_full_match(x.b, '[0-9]{{8}}') AND length(x.c) = 1 AND regexp_full_match(x.d, '[0-9]+') AND TRY_CAST(substr(x.b, 1, 4) || '-' || substr(x.b, 5, 2) || '-' || substr(x.b, 7, 2) AS DATE) IS NOT NULL AS ok FROM p)
        SELECT key, CASE WHEN ok THEN x.a END AS identifier, CASE WHEN ok THEN substr(x.b, 1, 4) || '-' || substr(x.b, 5, 2) || '-' || substr(x.b, 7, 2) END AS issue_date, CASE WHEN ok THEN x.c END AS type, CASE WHEN ok THEN x.d END AS query_identifier FROM o""",
    "aamva_parse": f"""WITH a AS ({view(AAMVA)}), l AS (SELECT key, payload, [regexp_replace(x, '^[\\x00\\x1e ]+|[\\x00\\x1e ]+$', '', 'g') for x in string_split(replace(payload, chr(13), chr(10)), chr(10))] AS raw FROM a),
        d AS (SELECT key, payload, [CASE WHEN x LIKE 'DL%' AND length(x) >= 5 THEN substr(x, 3) ELSE x END for x in raw] AS raw FROM l),
        o AS (SELECT key, payload, list_filter([CASE WHEN regexp_matches(x, '^{_ANY}') THEN x WHEN regexp_matches(x, '{_ANY}') THEN regexp_extract(x, '^.*({_ANY}.*)$', 1) ELSE x END for x in raw], lambda x: length(x) >= 4 AND regexp_matches(x, '^{_ANY}')) AS lines FROM d),
        v AS (SELECT *, {', '.join(f'{_field(c)} AS {c}' for c in _CODES)} FROM o), n AS (SELECT *, regexp_replace(DBB, '[^0-9]', '', 'g') AS b FROM v)
        SELECT key, payload LIKE '@%' AND contains(substr(payload, 1, 20), 'ANSI ') AS "headerValid", DAQ AS "documentNumber", DCS AS "familyName", DAC AS "firstName",
          CASE WHEN DBB = '' THEN '' ELSE coalesce(CASE WHEN length(b) = 8 THEN coalesce(TRY_CAST(substr(b, 5, 4) || '-' || substr(b, 1, 2) || '-' || substr(b, 3, 2) AS DATE), TRY_CAST(substr(b, 1, 4) || '-' || substr(b, 5, 2) || '-' || substr(b, 7, 2) AS DATE))::VARCHAR END, DBB) END AS "dateOfBirth",
          CASE DBC WHEN '1' THEN 'M' WHEN '2' THEN 'F' WHEN '9' THEN 'X' ELSE '' END AS sex, array_to_string(list_filter([DAG, DAH, DAI, DAJ, DAK], lambda x: x <> ''), ', ') AS address,
          array_to_string(list_sort(list_distinct([substr(x, 1, 3) for x in lines])), ',') AS designators FROM n""",
    "barcode_evidence": f"""WITH e AS ({view(EVIDENCE)}), t AS (SELECT *, trim(said) AS t FROM e)
        SELECT key, coalesce(valid AND length(t) BETWEEN 1 AND 512 AND NOT regexp_matches(t, '<NUL>|<U\\+|<SOH>|<STX>') AND length(regexp_replace(t, '[\\x00-\\x1f\\x7f]', '', 'g')) >= 0.9 * length(t) AND (symbology <> 'PDF417' OR (header AND designators > 0)), false) AS evidence FROM t""",
    "pdf417_routing": f"WITH r AS ({view(ROUTING)}) SELECT key, profile = 'aamva_pdf417' OR (profile = 'auto_research' AND coalesce(layout, '') NOT IN ('mex_ine', 'swe_id_2021') AND coalesce(zone, '') NOT IN ('td1', 'td2', 'td3', 'mrv')) AS scan FROM r",
    "document_routes": f"""WITH s AS ({view(SEEN)}), a AS (SELECT *, profile = 'auto_research' AS auto, profile = 'aamva_pdf417' OR (profile = 'auto_research' AND coalesce(layout_hint, '') NOT IN ('mex_ine', 'swe_id_2021') AND mrz_hint IS NULL) AS scan FROM s)
        SELECT doc_id, CASE WHEN scan AND aamva_valid THEN 'aamva'
          WHEN profile = 'aamva_pdf417' THEN 'rejected' WHEN td1_shaped AND (auto OR profile IN ('mex_ine', 'icao_td1')) THEN 'td1' WHEN profile = 'icao_td1' THEN 'rejected' WHEN profile = 'mex_ine' THEN 'ine'
          WHEN profile = 'swe_id_2021' THEN CASE WHEN swe_accepted THEN 'swe' ELSE 'rejected' END
          WHEN mrv_checks = 3 AND (auto OR profile = 'icao_mrv') THEN 'mrv' WHEN td2_checks = 4 AND (auto OR profile = 'icao_td2') THEN 'td2' WHEN td3_checks = 5 AND (auto OR profile IN ('mex_passport', 'icao_td3')) THEN 'td3' WHEN NOT auto THEN 'rejected'
          WHEN layout_hint = 'mex_ine' AND ine_accepted THEN 'ine' WHEN swe_accepted THEN 'swe' WHEN ine_accepted THEN 'ine' WHEN ine_qr THEN 'ine_qr' WHEN catalog_evidence THEN 'catalog' ELSE 'unsupported' END AS route FROM a""",
    "curp_check": f"""WITH c AS ({view(CURPS)}), u AS (SELECT key, upper(curp) AS x FROM c), s AS (SELECT key, x, list_sum([(instr('0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ', substr(x, i, 1)) - 1) * (19 - i) for i in range(1, 18)])::INT AS s FROM u)
        SELECT key, regexp_full_match(x, '[A-Z][AEIOUX][A-Z]{{2}}[0-9]{{6}}[HM][A-Z]{{5}}[A-Z0-9][0-9]') AND (10 - s % 10) % 10 = TRY_CAST(substr(x, 18, 1) AS INT) AS valid FROM s""",
    "mask_dates": f"""WITH m AS ({view(DATES)}), l AS (SELECT *, regexp_extract_all(split_part(mask, '|', 1), '\\{{([^}}\\["\\s]+)', 1) AS t, regexp_extract_all(shown, '[0-9A-Za-z_]+') AS w FROM m),
        f AS (SELECT key, list_filter(t, lambda x: regexp_matches(upper(x), '^(DAY|MONTH|YEAR)')) AS t, w FROM l),
        p AS (SELECT key, t, w, list_position([substr(x, 1, 3) for x in t], 'DAY') AS d, list_position([substr(x, 1, 4) for x in t], 'YEAR') AS y, list_position([upper(substr(x, 1, 5)) for x in t], 'MONTH') AS m FROM f),
        q AS (SELECT *, len(t) = 3 AND d > 0 AND y > 0 AND m > 0 AND t[m] IN ('MONTH_DD', 'MONTH_LZ', 'MONTH_SPA', 'Month_Ccc') AS dated, len(w) = 3 AS three, w[d] AS wd, w[y] AS wy, w[m] AS wm, t[m] AS tm FROM p),
        n AS (SELECT *, CASE WHEN regexp_full_match(wm, '[0-9]+') THEN TRY_CAST(wm AS INT) WHEN tm IN ('MONTH_SPA', 'Month_Ccc') THEN {_WORDS.replace('w IN', "upper(regexp_replace(wm, '[^A-Za-z]', '', 'g')) IN")} END AS mm, CASE WHEN regexp_full_match(wy, '[0-9]+') THEN CASE WHEN length(wy) = 2 THEN 2000 + wy::INT ELSE TRY_CAST(wy AS INT) END END AS yy, CASE WHEN regexp_full_match(wd, '[0-9]+') THEN TRY_CAST(wd AS INT) END AS dd FROM q)
        SELECT key, CASE WHEN dated THEN (three AND coalesce(TRY_CAST(lpad(yy::VARCHAR, 4, '0') || '-' || lpad(mm::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0') AS DATE) IS NOT NULL AND mm BETWEEN 1 AND 12 AND yy BETWEEN 1 AND 9999, false))::VARCHAR END AS valid FROM n""",
    "mask_shapes": f"""WITH m AS ({view(SHAPES)}), x AS (SELECT {_mask_lists('mask')} FROM m), c AS (SELECT *, len(regexp_extract_all(p, '\\{{(?:TEXT|STRINGS)')) AS k, coalesce(list_sum(n), 0)::INT + length(regexp_replace(free, '[^CDW]', '', 'g')) AS size FROM x)
        SELECT key, CASE WHEN k = 0 OR (k = 1 AND contains(p, '{{STRINGS}}')) THEN NULL ELSE k END::INT AS lines, CASE WHEN size > 0 THEN size END::INT AS length, array_to_string(t, ',') AS tokens FROM c""",
    "mask_scores": f"""WITH m AS ({view(SCORES)}), x AS (SELECT {_mask_lists('mask')}, {_PLAIN} AS plain, upper(regexp_replace(value, '[^A-Za-z]', '', 'g')) AS folded FROM m),
        c AS (SELECT *, regexp_replace(free, '[^CDW]', '', 'g') AS fixed, coalesce(list_sum(n), 0)::INT AS digits, trim(value) AS v FROM x), e AS (SELECT *, digits + length(fixed) AS size FROM c),
        s AS (SELECT key, mask, value,
          CASE WHEN size > 0 THEN 0.15 - 0.03 * abs(length(plain) - size) ELSE 0 END
          + CASE WHEN contains(fixed, 'D') AND length(plain) = length(fixed) THEN CASE WHEN list_bool_and([substr(fixed, i, 1) <> 'D' OR substr(plain, i, 1) BETWEEN '0' AND '9' for i in range(1, length(fixed) + 1)]) THEN 0.1 ELSE -0.2 END ELSE 0 END
          + CASE WHEN len(n) > 0 AND length(plain) = digits THEN CASE WHEN regexp_full_match(plain, '[0-9]+') THEN 0.1 ELSE -0.2 END ELSE 0 END
          + CASE WHEN contains(mask, '{{YEAR}}') THEN CASE WHEN regexp_full_match(plain, '(19|20)[0-9]{{2}}') THEN 0.2 ELSE -0.1 END ELSE 0 END
          + CASE WHEN contains(mask, '{{Sex_MF}}') THEN CASE WHEN upper(plain) IN ('M', 'F') THEN 0.15 ELSE -0.15 END ELSE 0 END
          + CASE WHEN contains(mask, '{{Country_Code}}') THEN CASE WHEN regexp_full_match(plain, '[A-Za-z]{{3}}') THEN 0.12 ELSE -0.12 END ELSE 0 END
          + CASE WHEN mask = '{{MONTH_DD}}' THEN CASE WHEN regexp_full_match(v, '[0-9]{{2}}') AND TRY_CAST(v AS INT) BETWEEN 1 AND 12 THEN 0.18 ELSE -0.18 END WHEN mask = '{{DAY}}' THEN CASE WHEN regexp_full_match(v, '[0-9]{{1,2}}') AND TRY_CAST(v AS INT) BETWEEN 1 AND 31 THEN 0.18 ELSE -0.18 END
              WHEN mask = '{{STATE_CODE_AUS}}' THEN CASE WHEN folded IN ('ACT', 'NSW', 'NT', 'QLD', 'SA', 'TAS', 'VIC', 'WA') THEN 0.18 ELSE -0.18 END ELSE 0 END
          + CASE WHEN mask = '{{POUNDS}}' THEN CASE WHEN TRY_CAST(regexp_extract(lower(value), '^\\s*(\\d{{1,3}})\\s*(lb|lbs|pound|pounds)?\\s*$', 1) AS INT) BETWEEN 20 AND 999 THEN 0.2 ELSE -0.2 END
              WHEN mask = '{{KGS}}' THEN CASE WHEN TRY_CAST(regexp_extract(lower(value), '^\\s*(\\d{{1,3}})\\s*(kg|kgs)?\\s*$', 1) AS INT) BETWEEN 10 AND 500 THEN 0.2 ELSE -0.2 END ELSE 0 END AS score FROM e)
        SELECT key, CASE WHEN mask = '' OR value = '' THEN 0.0 ELSE round(score, 6) END::DOUBLE AS score FROM s""",
    "page_ordinals": f"""WITH c AS ({view(CAPTIONS)}), t AS (SELECT key, lower(caption) AS c, upper(regexp_extract(caption, '(?i)\\b(?:page|side)\\s+([0-9]+|[A-Z])\\b', 1)) AS o, upper(regexp_extract(caption, '(?i)\\bpage\\s*([0-9]+|[A-Z])\\b', 1)) AS p FROM c),
        n AS (SELECT *, CASE WHEN regexp_full_match(o, '[0-9]+') THEN o::INT WHEN o <> '' THEN ascii(o) - 64 END AS ordinal, CASE WHEN regexp_full_match(p, '[0-9]+') THEN p::INT WHEN p <> '' THEN ascii(p) - 64 END AS page,
          CASE WHEN regexp_matches(c, '\\bfront\\s+cover\\b') THEN 'front_cover' WHEN regexp_matches(c, '\\bback\\s+cover\\b') THEN 'back_cover' WHEN regexp_matches(c, '\\b(front|side\\s*a)\\b') THEN 'front' WHEN regexp_matches(c, '\\b(back|reverse|rear|side\\s*b)\\b') THEN 'back' WHEN p <> '' THEN 'numbered_page' END AS role FROM t)
        SELECT key, CASE WHEN o = '' THEN 1 WHEN ordinal > 0 THEN ordinal END AS ordinal, role, CASE WHEN role = 'numbered_page' THEN page END AS page FROM n""",
    "upload_checks": f"""WITH u AS ({view(UPLOADS)}), b AS (SELECT *, regexp_extract(name, '([^/\\\\]*)$', 1) AS base FROM u), s AS (SELECT *, CASE WHEN regexp_matches(base, '^.+\\.[^.]+$') THEN lower(regexp_extract(base, '(\\.[^.]+)$', 1)) ELSE '.jpg' END AS suffix, strlen(content) AS n FROM b),
        e AS (SELECT key, suffix, CASE WHEN n = 0 THEN 'empty_file' WHEN n > 2000 THEN 'file_too_large' WHEN suffix NOT IN ('.jpg', '.jpeg', '.png', '.heic', '.heif') THEN 'unsupported_media_type' END AS error FROM s)
        SELECT *, CASE error WHEN 'empty_file' THEN 400 WHEN 'file_too_large' THEN 413 WHEN 'unsupported_media_type' THEN 415 ELSE 200 END AS status FROM e""",
    "base64_images": f"""WITH e AS ({view(ENCODED.replace('{base64}', 'to_base64(encode(substr(html, 1, 300)))'))}), p AS (SELECT key, regexp_replace(trim(given), '^data:[^,]*,', '') AS b FROM e)
        SELECT key, CASE WHEN regexp_full_match(b, '([A-Za-z0-9+/]{{4}})*([A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?') THEN sha256(from_base64(b)) END AS sha256 FROM p""",
    "identity_keys": f"""WITH k AS ({view(KEYS)}), d AS (SELECT *, regexp_replace(day, '[^0-9]', '', 'g') AS n FROM k)
        SELECT key, upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS name, CASE WHEN length(n) = 8 AND NOT regexp_matches(day, '^[0-9]{{4}}') THEN substr(n, 5, 4) || substr(n, 3, 2) || substr(n, 1, 2) ELSE n END AS day FROM d""",
}
