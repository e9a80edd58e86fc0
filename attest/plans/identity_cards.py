"""Named queries over cards of known templates, and their SQL. What a reader finds in each field is told by one SQL text that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards
from .payloads import dice, made, pick, quoted, view
from .zones import YEAR

_C = "c_custkey"
#: Readings of two voter-card templates by customer: keys with blanks, dates with or without slashes, addresses in capitals, fields that are missing.
_FIELDS = {
    "surname1": quoted([" GOMEZ", "NU?EZ<", "", "DIAZ"]), "surname2": quoted(["CRUZ", "", "DE LA O"]), "givenNames": quoted(["ANA MARIA", "JUAN", ""]), "dateOfBirth": quoted(["21031980", "21/03/1980", "21 03 80", ""]),
    "address1": quoted(["C  5 DE MAYO AV. 12", "col centro sn.", "AV UNO, INT. 4", ""]), "address2": quoted(["COL ROMA NORTE 06700", "loc. DE ARRIBA", ""]), "address3": quoted(["PUEBLA DE LOS ANGELES, PUE.", "cdmx", ""]),
    "electorKey": quoted(["GMCR RR800321 09H100", "SHORT", ""]), "curp": quoted(["GOCA800321MDFMRN05", "goca 800321 hdfmrn 05", "GOCA8003", ""]), "registrationYear": quoted(["2001 03", "2010", "01", ""]), "section": quoted(["1234", ""]), "validity": quoted(["2031", ""]), "sex": quoted(["M", "H", ""]),
}
FRONTS = " UNION ALL ".join(f"SELECT c_custkey AS doc_id, '{t}' AS template, '{name}' AS name, {pick(values, _C, t[-3:] + name)} AS text, CAST({dice(_C, name + t[-3:], 80)} AS DOUBLE) / 100 + 0.2 AS confidence FROM {{customer}}" for t in cards.VOTER for name, values in _FIELDS.items() if name in cards.TEMPLATES[t])
_SWEDISH = {
    "surname": quoted(["SVENSSON", "<BERG "]), "givenNames": quoted(["SVEN", "EVA ANNA", ""]), "sex": quoted(["K/F", "M/M", "F", "X", ""]), "nationality": quoted(["SVENSK/SWE", "SWE", "SVENSK / SWE", "DANSK/DNK", ""]), "dateOfBirth": quoted(["21 MAR/MAR 80", "12 MAJ/MAY 24", "x"]), "personalNumber": quoted(["19800321-1234", "8003211234", "A", ""]),
    "documentNumber": quoted(["12345678", "1234567", ""]), "height": quoted(["178 CM", ""]), "dateOfIssue": quoted(["01 FEB/FEB 22", "31 FEB 22"]), "dateOfExpiry": quoted(["01 FEB/FEB 27"]), "authority": quoted(["POLISMYNDIGHETEN STOCKHOLM", "POLIS", ""]), "documentStatus": quoted(["SPECIMEN", "", "SWEDEN"]),
}
SWEDES = " UNION ALL ".join(f"SELECT c_custkey AS doc_id, '{cards.SWEDISH}' AS template, '{name}' AS name, {pick(values, _C, 'w' + name)} AS text, 0.5 AS confidence FROM {{customer}}" for name, values in _SWEDISH.items())


def voter_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts of voter cards, read by two templates: the likelier one's record."""
    rows = cards.voter_fronts(made(spark, sf_dir, FRONTS))
    return rows.select("doc_id", "template", F.round("score", 6).alias("score"), "name", "date_of_birth", "address", "elector_key", "curp", "sex", "registration_year", "section", "validity", F.col("accepted").cast("int").alias("accepted"))


def swedish_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cards.swedish_cards(made(spark, sf_dir, SWEDES), YEAR)
    return rows.select("doc_id", "name", "date_of_birth", "date_of_issue", "date_of_expiry", "document_number", "personal_number", "sex", "height", "nationality", "nationality_code", "validity_status", "points", F.col("accepted").cast("int").alias("accepted"))


QUERIES = {f.__name__: f for f in (voter_fronts, swedish_cards)}

_title = lambda x: f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN regexp_matches(substr({x}, i - 1, CASE WHEN i = 1 THEN 0 ELSE 1 END), '[A-Za-z]') THEN lower(substr({x}, i, 1)) ELSE upper(substr({x}, i, 1)) END), '')"
_line = lambda x: f"array_to_string(list_transform(string_split(CASE WHEN starts_with({x}, 'Col ') THEN 'COL ' || substr({x}, 5) ELSE {x} END, ' '), lambda w: CASE WHEN regexp_full_match(w, '[A-Za-z]{{2,4}}[.,]+') THEN upper(w) ELSE w END), ' ')"
_swedish = lambda x: f"CASE WHEN regexp_full_match({x}, '[0-9]{{2}} +[A-Z]{{3}}(/[A-Z]{{3}})? +[0-9]{{2}}') AND list_contains(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'], substr({x}, 4, 3)) THEN coalesce(TRY_CAST((CASE WHEN right({x}, 2)::INT > {YEAR % 100} THEN '19' ELSE '20' END || right({x}, 2) || '-' || lpad(list_position(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'], substr({x}, 4, 3))::VARCHAR, 2, '0') || '-' || left({x}, 2)) AS DATE)::VARCHAR, {x}) ELSE {x} END"
_each = lambda names: ", ".join(f"coalesce(max(text) FILTER (name = '{k}'), '') AS {k}" for k in names)
_both = lambda a, b, by: f"concat_ws('{by}', nullif({a}, ''), nullif({b}, ''))"

ORACLES = {
    "voter_fronts": f"""WITH r AS (SELECT doc_id, template, name, trim(text, ' <') AS text, confidence FROM ({view(FRONTS)})),
c AS (SELECT doc_id, template, round(coalesce(sum(confidence) FILTER (name IN ('surname1', 'surname2', 'givenNames', 'electorKey', 'curp') AND text <> ''), 0), 9) AS score, {_each(_FIELDS)} FROM r GROUP BY doc_id, template),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS k FROM c) WHERE k = 1),
n AS (SELECT *, template = 'INE-front-legacy' AS legacy, regexp_replace(dateOfBirth, '[^0-9]', '', 'g') AS digits, upper(regexp_replace(curp, '[^A-Za-z0-9]', '', 'g')) AS key, upper(regexp_replace(electorKey, '[^A-Za-z0-9]', '', 'g')) AS voter, regexp_replace(address1, ' +', ' ', 'g') AS a1, regexp_replace(address2, ' +', ' ', 'g') AS a2, regexp_replace(address3, ' +', ' ', 'g') AS a3, string_split(registrationYear, ' ')[1] AS year1 FROM b),
t AS (SELECT *, {_title('a1')} AS t1, {_title('a2')} AS t2, {_title('a3')} AS t3, CASE WHEN regexp_full_match(year1, '[0-9]{{4}}') THEN year1 ELSE registrationYear END AS registration_year FROM n),
l AS (SELECT *, CASE WHEN legacy THEN {_line('t1')} ELSE upper(a1) END AS l1, CASE WHEN legacy THEN {_line('t2')} ELSE t2 END AS l2, CASE WHEN legacy THEN {_line('t3')} ELSE replace(t3, ' De ', ' de ') END AS l3 FROM t)
SELECT doc_id, template, round(score, 6) AS score, concat_ws(' ', nullif(surname1, ''), nullif(surname2, ''), nullif(givenNames, '')) AS name, CASE WHEN length(digits) = 8 THEN substr(digits, 1, 2) || '/' || substr(digits, 3, 2) || '/' || substr(digits, 5) ELSE dateOfBirth END AS date_of_birth,
  concat_ws(', ', nullif(l1, ''), nullif(l2, ''), nullif(l3, '')) AS address, voter AS elector_key, key AS curp, CASE WHEN length(key) = 18 AND substr(key, 11, 1) IN ('H', 'M') THEN substr(key, 11, 1) ELSE sex END AS sex, registration_year, section, validity,
  (regexp_full_match(key, '[A-Z]{{4}}[0-9]{{6}}.{{8}}') OR (length(voter) >= 16 AND (registration_year <> '' OR section <> '' OR validity <> '' OR dateOfBirth <> '')))::INT AS accepted FROM l""",
    "swedish_cards": f"""WITH r AS (SELECT doc_id, name, trim(text, ' <') AS text FROM ({view(SWEDES)})), c AS (SELECT doc_id, {_each(_SWEDISH)} FROM r GROUP BY doc_id),
n AS (SELECT *, trim(string_split(nationality, '/')[-1]) AS code, CASE WHEN sex IN ('K/F', 'F') THEN 'F' WHEN sex IN ('M/M', 'M') THEN 'M' ELSE '' END AS told, replace(personalNumber, '-', '') AS own FROM c),
p AS (SELECT *, (code = 'SWE')::INT * 2 + contains(authority, 'POLISMYNDIGHETEN')::INT * 2 + (told <> '')::INT + regexp_full_match(documentNumber, '[0-9]{{8}}')::INT + regexp_full_match(own, '[0-9]+')::INT AS points FROM n)
SELECT doc_id, {_both('surname', 'givenNames', ' ')} AS name, {_swedish('dateOfBirth')} AS date_of_birth, {_swedish('dateOfIssue')} AS date_of_issue, {_swedish('dateOfExpiry')} AS date_of_expiry, documentNumber AS document_number, own AS personal_number, told AS sex, lower(height) AS height,
  CASE WHEN code = 'SWE' THEN 'Sweden' ELSE nationality END AS nationality, code AS nationality_code, CASE WHEN documentStatus = 'SPECIMEN' THEN 0 ELSE -1 END AS validity_status, points, (points >= 5)::INT AS accepted FROM p""",
}
