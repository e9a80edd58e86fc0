"""Named queries over single rules: national numbers and dates, geometry of zones, tokens of masks, labels of evaluations, regions of layouts.

Inputs are SQL texts that both engines run (see payloads); the oracles apply the rules in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks, mrz, national
from ..operators import evaluation, layouts, readings
from .payloads import dice, made, pick, quoted, view
from .zones import ZONES, read_sql, zones

_C, _P, _O = "c_custkey", "p_partkey", "o_orderkey"

PERSONS = f"""SELECT c_custkey AS key, {pick(quoted(['3210380A0O1PB5', '321O38OA001P85', 'I2345678012BO1', '123', '3I1O38QA8818OL']), _C, 'a')} AS number, {pick(quoted(['21/03/1980', '21 03 1981', '22/03/1980', '21/03/80', '']), _C, 'b')} AS seen, {pick(quoted(['GOMC800321HDFRRR05', 'GOMC810321HDFRRR05', 'GOMC8003', 'GOMC801399HDFRRR05']), _C, 'c')} AS curp,
  {pick(quoted(['GMCRRR80032109H100', 'GMCRRR81032109H100', 'SHORT', 'GMCRRR80139909H100']), _C, 'd')} AS voter_key, {pick(quoted(['GOMEZ', 'NOMBRE', 'XOMEZ', '']), _C, 'e')} AS a1, {pick(quoted(['CRUZ', 'GOMEZ', 'DIAZ']), _C, 'f')} AS a2, {pick(quoted(['CARLA', '']), _C, 'g')} AS a3, {pick(quoted(['GOMEZ LUZ', 'GOMEZ', '']), _C, 'h')} AS b1, {pick(quoted(['MORA', 'CRUZ']), _C, 'i')} AS b2, {pick(quoted(['CARLOTA', 'ANA']), _C, 'j')} AS b3,
  {pick(quoted(['Col Centro Sn. De 5', 'Av. Uno, Int. 4', 'Col Roma', 'Calle Col 2']), _C, 'k')} AS titled, {pick(quoted(['12 JAN 80', '12 MAJ/MAY 24', '31 FEB 20', '01 DEC/DEC 26', 'x']), _C, 'l')} AS swedish, {pick(quoted(['19800321-1234', '', None]), _C, 'm')} AS swedish_number, {pick(quoted(['Sven', '']), _C, 'n')} AS given FROM {{customer}}"""


def national_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal numbers, birth dates that several readings agree on, names from two readings, address lines, acceptance of cards."""
    rows = made(spark, sf_dir, PERSONS)
    names = national.merged_names([F.col(f"a{k}") for k in (1, 2, 3)], [F.col(f"b{k}") for k in (1, 2, 3)], F.col("curp"))
    return rows.select(
        "key", national.belarus_number(F.col("number")).alias("belarus"), national.corroborated_birth(F.col("seen"), F.col("curp"), F.col("voter_key")).alias("birth"), *(n.alias(f"name{k}") for k, n in enumerate(names)), national.address_line(F.col("titled")).alias("line"), national.swedish_date(F.col("swedish"), 2025).alias("swedish"),
        national.voter_card_accepted(F.col("curp"), F.col("voter_key"), F.col("a1"), F.col("a3")).cast("int").alias("accepted"), national.swedish_card_score(F.col("swedish_number"), F.col("seen"), F.col("given"), F.col("a1")).alias("score"),
    )


GEOMETRY = f"""SELECT p_partkey AS key, CAST({pick(["0.05", "0.2", "0.3", "0.41", "NULL"], _P, 'a')} AS DOUBLE) AS expected, {dice(_P, 'b', 2)} + 2 AS rows_of_zone, CAST({dice(_P, 'c', 40)} AS DOUBLE) / 100 AS top, CAST({dice(_P, 'd', 50)} + 50 AS DOUBLE) / 100 AS bottom, CAST({pick(["870", "0", "1000"], _P, 'e')} AS DOUBLE) AS w, CAST({pick(["150", "-1"], _P, 'f')} AS DOUBLE) AS h, CAST({pick(["86", "125", "NULL"], _P, 'g')} AS DOUBLE) AS dw, CAST({pick(["54", "88"], _P, 'h')} AS DOUBLE) AS dh, CAST({pick(["60", "0", "NULL"], _P, 'i')} AS DOUBLE) AS distance FROM {{part}}"""


def zone_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights to look for a zone in, the bands of its lines, and its size against the document's."""
    rows = made(spark, sf_dir, GEOMETRY)
    zone = F.array(F.lit(0.1), F.col("top"), F.lit(0.9), F.col("bottom"))
    two, three = F.col("rows_of_zone") == 2, F.col("rows_of_zone") == 3
    ratios = F.when(two, mrz.search_ratios(F.col("expected"), 2)).when(three, mrz.search_ratios(F.col("expected"), 3))
    bands = F.when(two, mrz.line_bounds(zone, 2)).when(three, mrz.line_bounds(zone, 3))
    size = mrz.physical_geometry(F.col("w"), F.col("h"), F.col("dw"), F.col("dh"), F.col("distance"))
    return rows.select("key", F.array_join(F.transform(ratios, lambda x: F.format_number(x, 4)), ",").alias("ratios"), F.array_join(F.transform(bands, lambda b: F.concat_ws("-", F.format_number(b[1], 4), F.format_number(b[3], 4))), ",").alias("bands"), *(F.round(size[c], 6).alias(n) for c, n in (("widthRatio", "width"), ("heightRatio", "height"), ("lineDistanceRatio", "distance"))))


RAW = f"""SELECT c_custkey AS key, {pick(quoted(['p<uto doe<<jane', 'P<UTO', ' I <UTOx']), _C, 'a')} AS l1, {pick(quoted(['l8 98902c<', 'AB']), _C, 'b')} AS l2, {pick(quoted(['doe<< jane', 'x y']), _C, 'c')} AS l3, {dice(_C, 'd', 3)} + 1 AS n FROM {{customer}}"""


def mrz_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they were read, made ready for a format of three lines, of two, or of as many as there are."""
    lines = F.slice(F.array("l1", "l2", "l3"), F.lit(1), F.col("n"))
    told = lambda three: F.array_join(mrz.normalised(lines, three), "/")
    return made(spark, sf_dir, RAW).select("key", told(True).alias("three"), told(False).alias("two"), told(None).alias("as_given"))


_NAMES = ["MONTH_SPA", "MONTH_DEU", "STATE_CODE_CAN", "EYE_COLOR_D20", "Sex_WORD", "SEX_HM", "EYE_COLOR_2C", "Blood_group", "WORD", "WORD_D", "DAY_DD", "DAY_D", "MONTH_D_DD", "YEAR_DD", "TEXT"]
TOKENS = f"""SELECT o_orderkey AS key, {pick(quoted(_NAMES), _O, 'a')} AS token, {pick(quoted(['ENE', 'dez', 'ON', 'BLU', 'Male', 'H', 'x', 'ab+', 'O-', "D'or-St. B", 'A1 b', '07', '7', '31', '32', '12', '0', '', ' 09 ', 'QC']), _O, 'b')} AS value FROM {{orders}}"""


def mask_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether values suit named tokens of masks; null for tokens without a rule."""
    rows = made(spark, sf_dir, TOKENS)
    folded = F.upper(F.regexp_replace("value", "[^A-Za-z]", ""))
    return rows.select("key", masks.token_valid(F.col("token"), F.col("value"), folded).cast("int").alias("valid"))


LABELS = f"""SELECT o_orderkey AS key, o_custkey AS part, {pick(quoted([' Same ', 'GENUINE', '1', 'no', 'Impostor', '0', 'maybe', '', 'different_person', 'TRUE', 'yes']), _O, 'a')} AS label, CAST({pick(["0.5", "0.25", "1", "0", "0.75", "0.6", "0.9"], _O, 'b')} AS DOUBLE) + CASE WHEN {dice(_O, 'c', 60)} = 0 THEN 1.5 ELSE 0 END AS score FROM {{orders}}"""


def evaluation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a record file as truth values."""
    return made(spark, sf_dir, LABELS).select("key", evaluation.label(F.col("label")).cast("int").alias("same"))


def evaluation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forbids an evaluation of three lists of records: all, those with a label, and those with one of no score over one."""
    rows = made(spark, sf_dir, LABELS).select(evaluation.label(F.col("label")).alias("same_person"), "score")
    lists = {"all": rows, "labelled": rows.where(F.col("same_person").isNotNull()), "fine": rows.where(F.col("same_person").isNotNull() & (F.col("score") <= 1)), "genuine": rows.where(F.col("same_person") & (F.col("score") <= 1)), "none": rows.where("false")}
    out = None
    for name, own in lists.items():
        one = evaluation.problems(own).select(F.lit(name).alias("list"), "problem")
        out = one if out is None else out.unionByName(one)
    return out


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of a list of records, its targets a row each."""
    rows = made(spark, sf_dir, LABELS).select(evaluation.label(F.col("label")).alias("same_person"), "score").where(F.col("same_person").isNotNull() & (F.col("score") <= 1))
    r = evaluation.report(rows, [0.1, 0.5])
    return r.select(F.round("auc", 6).alias("auc"), F.round("equal_error.eer", 6).alias("eer"), F.col("scores")[0]["count"].alias("impostors"), F.round(F.col("scores")[1]["mean"], 6).alias("genuine_mean"), F.explode("targets").alias("t")).select("auc", "eer", "impostors", "genuine_mean", "t.target", F.round("t.tar", 6).alias("tar"), F.round("t.threshold", 6).alias("threshold"))


AREAS = f"""SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS identifier, p_partkey AS seq, {pick(quoted(['portrait', 'signature', 'surname']), _P, 'a')} AS name, CAST({pick(["6", "24", "6", "128", "NULL"], _P, 'b')} AS INT) AS light, CAST({pick(["0", "NULL", "0", "2"], _P, 'c')} AS INT) AS layer, CAST({dice(_P, 'd', 3)} AS DOUBLE) / 4 AS x FROM {{part}}"""


def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible regions of layouts, of equal ones the first, and whether a region is the first of its name."""
    rows = made(spark, sf_dir, AREAS)
    d = F.struct("seq", "name", F.array("x", F.lit(0.0), F.col("x") + 0.25, F.lit(1.0)).alias("bounds"), F.col("light").alias("lightType"), "layer")
    held = rows.groupBy("identifier").agg(F.transform(F.array_sort(F.collect_list(d)), lambda x: F.struct(x["name"].alias("name"), x["bounds"].alias("bounds"), x["lightType"].alias("lightType"), x["layer"].alias("layer"))).alias("graphics"))
    found = layouts.graphic_regions(held, ["portrait", "signature"])
    first = layouts.first_of_name(found).select("identifier", "seq", F.lit(1).alias("first"))
    return found.join(first, ["identifier", "seq"], "left").select("identifier", "seq", "name", F.col("bounds")[0].alias("x"), F.coalesce("first", F.lit(0)).alias("first"))


def voter_backs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backs of cards, read in two images and two turns each: taken only with a fully valid zone of the issuer."""
    z = zones(spark, sf_dir, "TD1")
    one = lambda image, turn, lines, sure: F.struct(F.lit(image).alias("image"), F.lit(turn).alias("rotation"), lines.alias("lines"), F.array(sure, sure, sure).alias("confidences"))
    plain, bad = F.array("l1", "l2", "l3"), F.array("l1", F.concat(F.lit("Z"), F.substring("l2", 2, 29)), F.col("l3"))
    k = F.col("key")
    made_of = F.array(one(0, 90, bad, F.lit(0.9)), one(0, 270, F.when(k % 2 == 0, plain).otherwise(bad), F.lit(0.5)), one(1, 90, plain, F.lit(0.7)))
    rows = z.select(k.alias("doc_id"), F.explode(made_of).alias("r")).select("doc_id", "r.*")
    return readings.td1_backs(rows, "UTO").select("doc_id", "image", "rotation", F.array_join("lines", "/").alias("lines"))


#: Runs in both engines: a line of a record file for each part, some of which are wrong.
RECORDS = f"""SELECT p_partkey AS key, p_partkey % 4 AS bucket, {pick(quoted(['pair', '', '"a ""b"""']), _P, 'i')} AS pair, {pick(quoted(['same', 'different', '1', 'perhaps', ' TRUE ', '']), _P, 's')} AS label, {pick(quoted(['0.5', '1', '0', '1.5', '-0.25', 'x', '0.75', '"0.25"', '']), _P, 'v')} AS score, {dice(_P, 'm', 9)} AS odd FROM {{part}}"""


def quarantined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of record files that are wrong, with their line and problem; and how many of each file are right. The files, four with a header each, are made from parts."""
    from ..sources import catalogs
    from ..sources.tables import shared_folder

    rows = made(spark, sf_dir, RECORDS)
    text = F.when(F.col("odd") == 0, F.concat_ws(",", "pair", "label")).when(F.col("odd") == 1, F.concat_ws(",", "pair", "label", "score", F.lit("more"))).otherwise(F.concat_ws(",", "pair", "label", "score"))
    heads = rows.select(F.col("bucket"), F.lit(-1).cast("long").alias("key"), F.lit("pairIdentifier,samePerson,score").alias("value")).distinct()
    lines = rows.select("bucket", F.col("key").cast("long").alias("key"), text.alias("value")).unionByName(heads)
    folder = f"{shared_folder(spark)}/attest-records-{uuid.uuid4().hex}"
    lines.repartition("bucket").sortWithinPartitions("bucket", "key").select("bucket", "value").write.partitionBy("bucket").text(f"{folder}/files")
    good, bad = catalogs.quarantined(catalogs.checked_records(spark, f"{folder}/files/*"), f"{folder}/rows")
    bucket = F.regexp_extract("file", "bucket=([0-9]+)", 1).cast("int").alias("bucket")
    fine = good.groupBy(bucket).agg(F.count("*").alias("line"), F.round(F.sum("score"), 6).cast("string").alias("value"), F.count("pair_id").cast("string").alias("problem"))
    return bad.select(bucket, "line", "problem", "value", F.lit("bad").alias("kind")).unionByName(fine.select("bucket", "line", "problem", "value", F.lit("good").alias("kind")))


QUERIES = {f.__name__: f for f in (quarantined_records, national_rules, zone_geometry, mrz_normalised, mask_tokens, evaluation_labels, evaluation_problems, evaluation_report, layout_regions, voter_backs)}

_DIGITS, _LETTERS = "translate({0}, 'OQIL', '0011')", "translate({0}, '801', 'BOI')"
_FITS = "length({0}) > 0 AND (length(curp) <> 18 OR starts_with(upper({0}), substr(curp, {1}, 1)))"


def _merged(k: int, place: int) -> str:
    a, b = f"a{k}", f"b{k}"
    fa, fb = _FITS.format(a, place), _FITS.format(b, place)
    return f"CASE WHEN upper(a1) = 'NOMBRE' AND upper(a2) = upper(b1) THEN {b} ELSE coalesce(CASE WHEN {fa} AND {fb} THEN CASE WHEN length({b}) > length({a}) THEN {b} ELSE {a} END WHEN {fa} THEN {a} WHEN {fb} THEN {b} END, nullif({a}, ''), {b}) END AS name{k - 1}"


_LABEL = "CASE WHEN lower(trim(label)) IN ('1', 'true', 'yes', 'same', 'same_person', 'genuine') THEN 1 WHEN lower(trim(label)) IN ('0', 'false', 'no', 'different', 'different_person', 'impostor') THEN 0 END"
_MON = "CASE upper(substr(swedish, 4, 3)) " + " ".join(f"WHEN '{m}' THEN '{k:02d}'" for k, m in enumerate(national.MONTHS, 1)) + " END"
_RECORDS = f"""WITH r AS (SELECT *, CASE odd WHEN 0 THEN pair || ',' || label WHEN 1 THEN pair || ',' || label || ',' || score || ',more' ELSE pair || ',' || label || ',' || score END AS value, row_number() OVER (PARTITION BY bucket ORDER BY key) + 1 AS line FROM ({view(RECORDS)})),
t AS (SELECT *, lower(trim(label)) AS l, TRY_CAST(replace(score, '"', '') AS DOUBLE) AS v FROM r),
p AS (SELECT *, CASE WHEN odd < 2 THEN 'fields' WHEN l NOT IN ('same', 'different', '1', 'true') THEN 'label' WHEN v IS NULL OR v NOT BETWEEN 0 AND 1 THEN 'score' END AS problem FROM t)
SELECT bucket::INT AS bucket, line, problem, value, 'bad' AS kind FROM p WHERE problem IS NOT NULL
UNION ALL SELECT bucket::INT, count(*), count(*) FILTER (pair <> '')::VARCHAR, round(sum(v), 6)::VARCHAR, 'good' FROM p WHERE problem IS NULL GROUP BY bucket"""

ORACLES = {
    "quarantined_records": _RECORDS,
    "national_rules": f"""WITH p AS ({view(PERSONS)}), d AS (SELECT *, regexp_replace(seen, '[^0-9]', '', 'g') AS n, substr(curp, 5, 6) AS y, substr(voter_key, 7, 6) AS v FROM p), b AS (SELECT *, length(curp) = 18 AND length(voter_key) = 18 AND y = v AND length(n) = 8 AND regexp_full_match(y, '[0-9]{{6}}') AS fine, CASE WHEN length(n) = 8 AND length(y) = 6 THEN hamming(y, substr(n, 7, 2) || substr(n, 3, 2) || substr(n, 1, 2)) END AS apart FROM d)
        SELECT key, CASE WHEN length(number) = 14 THEN {_DIGITS.format('substr(number, 1, 7)')} || {_LETTERS.format('substr(number, 8, 1)')} || substr(number, 9, 3) || {_LETTERS.format('substr(number, 12, 2)')} || {_DIGITS.format('substr(number, 14, 1)')} ELSE number END AS belarus,
          CASE WHEN fine AND apart <= 1 THEN strftime(TRY_CAST(substr(n, 5, 2) || substr(y, 1, 2) || '-' || substr(y, 3, 2) || '-' || substr(y, 5, 2) AS DATE), '%d/%m/%Y') END AS birth, {_merged(1, 1)}, {_merged(2, 3)}, {_merged(3, 4)},
          array_to_string([CASE WHEN regexp_full_match(w, '[A-Za-z]{{2,4}}[.,]+') THEN upper(w) ELSE w END for w in string_split(CASE WHEN titled LIKE 'Col %' THEN 'COL ' || substr(titled, 5) ELSE titled END, ' ')], ' ') AS line,
          CASE WHEN regexp_full_match(swedish, '[0-9]{{2}} [A-Z]{{3}}(/[A-Z]{{3}})? [0-9]{{2}}') THEN coalesce(TRY_CAST(CASE WHEN right(swedish, 2)::INT > 25 THEN '19' ELSE '20' END || right(swedish, 2) || '-' || {_MON} || '-' || substr(swedish, 1, 2) AS DATE)::VARCHAR, swedish) ELSE swedish END AS swedish,
          (regexp_full_match(upper(curp), '[A-Z]{{4}}[0-9]{{6}}.{{8}}') OR (length(voter_key) >= 16 AND (a1 <> '' OR a3 <> '')))::INT AS accepted, (2 * (coalesce(swedish_number, '') <> '')::INT + 2 * (seen <> '')::INT + (given <> '')::INT + (a1 <> '')::INT) AS score FROM b""",
    "zone_geometry": f"""WITH g AS ({view(GEOMETRY)}), r AS (SELECT *, list_filter([expected * 0.95, expected * 1.1, expected * 1.25], lambda x: x BETWEEN 0.08 AND 0.40) AS own, CASE WHEN rows_of_zone = 2 THEN [0.13, 0.17, 0.21, 0.25] ELSE [0.18, 0.23, 0.28, 0.33] END::DOUBLE[] AS defaults, (bottom - top) / rows_of_zone AS s FROM g),
        f AS (SELECT *, w > 0 AND h > 0 AND dw > 0 AND dh > 0 AS fine FROM r)
        SELECT key, array_to_string([printf('%.4f', x) for x in list_concat(coalesce(own, []), list_filter(defaults, lambda x: NOT list_contains(coalesce(own, []), x)))], ',') AS ratios, array_to_string([printf('%.4f', greatest(top + s * i - s * 0.12, 0.0)) || '-' || printf('%.4f', least(top + s * (i + 1) + s * 0.12, 1.0)) for i in range(rows_of_zone)], ',') AS bands,
          CASE WHEN fine THEN round(w / 10 / dw, 6) END AS width, CASE WHEN fine THEN round(h / 10 / dh, 6) END AS height, CASE WHEN fine AND distance > 0 THEN round(distance / 10 / dh, 6) END AS distance FROM f""",
    "mrz_normalised": f"""WITH r AS ({view(RAW)}), l AS (SELECT key, n, [upper(l1), upper(l2), upper(l3)][1:n] AS l FROM r), c AS (SELECT key, n, [replace(x, ' ', '') for x in l] AS closed, [replace(x, ' ', '<') for x in l] AS filled FROM l), m AS (SELECT *, CASE WHEN n = 3 THEN [closed[1], closed[2], filled[3]] END AS ready FROM c)
        SELECT key, array_to_string(coalesce(ready, closed), '/') AS three, array_to_string(filled, '/') AS two, array_to_string(coalesce(ready, filled), '/') AS as_given FROM m""",
    "mask_tokens": f"""WITH t AS ({view(TOKENS)}), f AS (SELECT *, upper(regexp_replace(value, '[^A-Za-z]', '', 'g')) AS folded, trim(value) AS v FROM t), n AS (SELECT *, CASE WHEN regexp_full_match(v, '[0-9]+') THEN v::INT END AS n FROM f)
        SELECT key, (CASE token WHEN 'MONTH_SPA' THEN folded IN ('ENE', 'FEB', 'MAR', 'ABR', 'MAY', 'JUN', 'JUL', 'AGO', 'SEP', 'SEPT', 'OCT', 'NOV', 'DIC') WHEN 'MONTH_DEU' THEN folded IN ('JAN', 'FEB', 'MAR', 'APR', 'MAI', 'JUN', 'JUL', 'AUG', 'SEP', 'OKT', 'NOV', 'DEZ') WHEN 'STATE_CODE_CAN' THEN folded IN ('AB', 'BC', 'MB', 'NB', 'NL', 'NS', 'NT', 'NU', 'ON', 'PE', 'QC', 'SK', 'YT')
          WHEN 'EYE_COLOR_D20' THEN folded IN ('BLK', 'BLU', 'BRO', 'GRY', 'GRN', 'HAZ', 'MAR', 'PNK', 'DIC', 'UNK') WHEN 'Sex_WORD' THEN folded IN ('MALE', 'FEMALE') WHEN 'SEX_HM' THEN folded IN ('H', 'M') WHEN 'EYE_COLOR_2C' THEN length(folded) = 2 WHEN 'Blood_group' THEN regexp_full_match(upper(v), '(A|B|AB|O)[+-]?')
          WHEN 'WORD' THEN regexp_full_match(v, '[A-Za-z ''.-]+') AND regexp_matches(v, '[A-Za-z]') WHEN 'WORD_D' THEN regexp_full_match(v, '[A-Za-z0-9 ''.-]+') AND regexp_matches(v, '[A-Za-z0-9]')
          WHEN 'DAY_DD' THEN coalesce(length(v) = 2 AND n BETWEEN 1 AND 31, false) WHEN 'DAY_D' THEN coalesce(length(v) = 1 AND n BETWEEN 1 AND 9, false) WHEN 'MONTH_D_DD' THEN coalesce(length(v) IN (1, 2) AND n BETWEEN 1 AND 12, false) WHEN 'YEAR_DD' THEN coalesce(length(v) = 2 AND n BETWEEN 0 AND 99, false) END)::INT AS valid FROM n""",
    "evaluation_labels": f"WITH l AS ({view(LABELS)}) SELECT key, {_LABEL} AS same FROM l",
    "evaluation_problems": f"""WITH l AS (SELECT {_LABEL} AS same, score FROM ({view(LABELS)})), a AS (SELECT count(*) FILTER (same IS NULL) AS nulls, count(*) FILTER (same IS NOT NULL AND score > 1) AS over FROM l)
        SELECT 'all' AS list, CASE WHEN nulls > 0 THEN 'null' WHEN over > 0 THEN 'range' END AS problem FROM a UNION ALL SELECT 'labelled', CASE WHEN over > 0 THEN 'range' END FROM a UNION ALL SELECT 'fine', NULL UNION ALL SELECT 'genuine', 'one_class' UNION ALL SELECT 'none', 'empty'""",
    "evaluation_report": f"""WITH l AS (SELECT {_LABEL} = 1 AS same_person, score FROM ({view(LABELS)}) WHERE {_LABEL} IS NOT NULL AND score <= 1), t AS (SELECT count(*) FILTER (same_person) AS g, count(*) FILTER (NOT same_person) AS i, avg(score) FILTER (same_person) AS m FROM l),
        s AS (SELECT DISTINCT score FROM l), h AS (SELECT (score + lead(score) OVER (ORDER BY score)) / 2 AS threshold FROM s UNION SELECT 1.0 UNION SELECT 0.0),
        c AS (SELECT threshold, (SELECT count(*) FROM l WHERE same_person AND score > threshold) / g::DOUBLE AS tar, (SELECT count(*) FROM l WHERE NOT same_person AND score > threshold) / i::DOUBLE AS far FROM h, t WHERE threshold IS NOT NULL),
        e AS (SELECT (far + 1 - tar) / 2 AS eer FROM c ORDER BY abs(far - (1 - tar)), far + 1 - tar, threshold DESC LIMIT 1),
        u AS (SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / (count(*)) AS auc FROM l AS a, l AS b WHERE a.same_person AND NOT b.same_person),
        k AS (SELECT target, threshold, tar, row_number() OVER (PARTITION BY target ORDER BY tar DESC, far DESC, threshold) AS p FROM c, (SELECT unnest([0.1, 0.5])::DOUBLE AS target) WHERE far <= target)
        SELECT round(auc, 6) AS auc, round(eer, 6) AS eer, i AS impostors, round(m, 6) AS genuine_mean, target, round(tar, 6) AS tar, round(threshold, 6) AS threshold FROM k, e, u, t WHERE p = 1""",
    "layout_regions": f"""WITH a AS ({view(AREAS)}), n AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY seq) - 1 AS place FROM a), v AS (SELECT *, row_number() OVER (PARTITION BY identifier, name, x ORDER BY place) AS k FROM n WHERE light IN (6, 24) AND coalesce(layer, 0) = 0 AND name IN ('portrait', 'signature')),
        f AS (SELECT *, row_number() OVER (PARTITION BY identifier, name ORDER BY place) AS one FROM v WHERE k = 1) SELECT identifier, place::INT AS seq, name, x, (one = 1)::INT AS first FROM f""",
    "voter_backs": f"""WITH z AS ({ZONES.format(customer='customer')}), c AS (SELECT key, unnest([0, 0, 1]) AS image, unnest([90, 270, 90]) AS rotation, l1, unnest(['Z' || substr(l2, 2, 29), CASE WHEN key % 2 = 0 THEN l2 ELSE 'Z' || substr(l2, 2, 29) END, l2]) AS l2, l3 FROM z WHERE format = 'TD1'),
        s AS (SELECT * FROM {read_sql('TD1', 'c')} WHERE shaped AND dated AND n = 4 AND substr(l1, 3, 3) = 'UTO'), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY image, CASE rotation WHEN 90 THEN 1 WHEN 270 THEN 2 END) AS k FROM s)
        SELECT key AS doc_id, image, rotation, l1 || '/' || l2 || '/' || l3 AS lines FROM o WHERE k = 1""",
}
