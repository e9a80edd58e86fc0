"""Named queries over machine-readable zones that are made from customers.

The lines are made by one SQL text that both engines run: numbers, days (some that are none), names and check digits by the
key, then noise in one character of every fourth record. The oracles read these lines by themselves, character by character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mrz
from ..functions.let import settled
from ..sources.tables import table

YEAR = 2025
_ALPHABET = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def digit(x: str, n: int) -> str:
    """SQL: the check digit of n characters."""
    return "((" + " + ".join(f"greatest(instr({_ALPHABET}, substr({x}, {i}, 1)) - 1, 0) * {(7, 3, 1)[(i - 1) % 3]}" for i in range(1, n + 1)) + ") % 10)"


def _with(x: str, n: int) -> str:
    return f"{x} || CAST({digit(x, n)} AS STRING)"


def _noisy(line: str, width: int, salt: str) -> str:
    """One character of the line put in the place of another, in every fourth record."""
    at = f"((ascii(substr(md5('{salt}' || CAST(key AS STRING)), 1, 1)) * 7 + ascii(substr(md5('{salt}' || CAST(key AS STRING)), 2, 1))) % {width} + 1)"
    return f"CASE WHEN key % 4 = 1 THEN substr({line}, 1, {at} - 1) || substr('0O<A9Z7K', key % 8 + 1, 1) || substr({line}, {at} + 1) ELSE {line} END"


_DAY = "lpad(CAST(({base} + key * 17) % 100 AS STRING), 2, '0') || lpad(CAST(key % 13 AS STRING), 2, '0') || lpad(CAST(key * 5 % 31 + 1 AS STRING), 2, '0')"
_GIVEN = "translate(substr(md5(CAST(key AS STRING)), 1, CAST(key % 7 AS INT)), '0123456789abcdef', 'ABCDE<GHIJKLMNOP')"
#: Run in both engines: PIECES from {customer}, and the lines from {pieces}.
PIECES = f"""
WITH r AS (
  SELECT c_custkey AS key, translate(upper(c_name), '#0123456789', '<ABCDEFGHIJ') AS surname FROM {{customer}}),
p AS (
  SELECT key, substr('ABCDEFGHJKLMNPQRSTUVWXYZ', CAST(key % 24 AS INT) + 1, 1) || lpad(CAST(key * 7919 % 100000000 AS STRING), 8, CASE WHEN key % 3 = 0 THEN '<' ELSE '0' END) AS number,
         {_DAY.format(base=60)} AS birth, {_DAY.format(base=5)} AS expiry, substr('MF<', CAST(key % 3 AS INT) + 1, 1) AS sex,
         substr(surname, 1, CAST(8 + key % 9 AS INT)) || CASE WHEN key % 6 = 0 THEN '<' ELSE '<<' END || {_GIVEN} AS names,
         rpad(CASE WHEN key % 5 = 0 THEN '' ELSE CAST(key * 31 AS STRING) END, 14, '<') AS personal FROM r),
c AS (
  SELECT key, names, {_with('number', 9)} AS number, {_with('birth', 6)} AS birth, {_with('expiry', 6)} AS expiry, sex, {_with('personal', 14)} AS personal, substr(personal, 1, 11) AS short FROM p)
SELECT * FROM c
"""
LINES = f"""
WITH b AS (
  SELECT key, names, number || 'UTO' || birth || sex || expiry AS core, number, birth, expiry, sex, personal, short,
         number || birth || expiry || personal AS whole3, number || birth || expiry || '<<<<<<<' AS whole2,
         rpad(number, 25, '<') || birth || expiry || short AS whole1 FROM {{pieces}} AS t),
z AS (
  SELECT key, 'TD3' AS format, rpad('P<UTO' || names, 44, '<') AS l1, core || personal || CAST({digit('whole3', 39)} AS STRING) AS l2, '' AS l3 FROM b
  UNION ALL SELECT key, 'TD2', rpad('I<UTO' || names, 36, '<'), core || '<<<<<<<' || CAST({digit('whole2', 31)} AS STRING), '' FROM b
  UNION ALL SELECT key, 'MRV-A', rpad('V<UTO' || names, 44, '<'), rpad(core, 44, '<'), '' FROM b
  UNION ALL SELECT key, 'MRV-B', rpad('V<UTO' || names, 36, '<'), rpad(core, 36, '<'), '' FROM b
  UNION ALL SELECT key, 'TD1', rpad('I<UTO' || number, 30, '<'), birth || sex || expiry || 'UTO' || short || CAST({digit('whole1', 50)} AS STRING), rpad(names, 30, '<') FROM b)
SELECT key, format, {_noisy('l1', 30, 'a')} AS l1, {_noisy('l2', 28, 'b')} AS l2, CASE WHEN l3 <> '' THEN {_noisy('l3', 30, 'c')} ELSE l3 END AS l3 FROM z
"""


def zones(spark: SparkSession, sf_dir: str, *formats: str) -> DataFrame:
    """key, format, l1, l2, l3 (empty but in TD1), of the formats named. Each step is computed once, though several columns are made of it.

    Work on a line costs far more than reading it: narrow rows are dealt out first, so that a file of one split keeps all cores busy.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = settled(spark.sql(PIECES, customer=table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(tasks, "c_custkey")))
    return settled(spark.sql(LINES, pieces=pieces).where(F.col("format").isin(*formats)))


#: Both in one text, for an engine without such steps.
ZONES = LINES.replace("{pieces}", f"({PIECES})")
FIELDS = ("document_class", "issuing_state", "document_number", "date_of_birth", "date_of_expiry", "sex", "nationality", "surname", "given_names", "name", "optional_data", "n_valid", "status", "error")


def mrz_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zones(spark, sf_dir, "TD3")
    return z.select("key", mrz.check_digit(F.substring("l2", 1, 9)).alias("digit"), mrz.check_valid(F.substring("l2", 14, 6), F.substring("l2", 20, 1)).alias("birth_valid"))


def mrz_td3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = zones(spark, sf_dir, "TD3").select("key", mrz.parsed(mrz.normalised(F.array("l1", "l2")), "TD3", YEAR).alias("z"))
    return rows.select("key", *(f"z.{c}" for c in FIELDS))


def mrz_td1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = zones(spark, sf_dir, "TD1").select("key", mrz.parsed(mrz.normalised(F.array("l1", "l2", "l3"), three=True), "TD1", YEAR).alias("z"))
    return rows.select("key", *(f"z.{c}" for c in FIELDS))


def mrz_two_line_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TD2 and both kinds of visa, field by field."""
    z = zones(spark, sf_dir, "TD2", "MRV-A", "MRV-B")
    lines = mrz.normalised(F.array("l1", "l2"))
    by = F.when(F.col("format") == "TD2", mrz.parsed(lines, "TD2", YEAR)).when(F.col("format") == "MRV-A", mrz.parsed(lines, "MRV-A", YEAR)).otherwise(mrz.parsed(lines, "MRV-B", YEAR))
    return z.select("key", "format", by.alias("z")).select("key", "format", *(f"z.{c}" for c in FIELDS))


def mrz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-line zones of all formats: how many checks hold in the best reading, and whether the zone's own format holds in full."""
    z = zones(spark, sf_dir, "TD3", "TD2", "MRV-A", "MRV-B")
    shape = lambda x: F.struct(mrz.two_line_score(x).alias("score"), mrz.fully_valid(x).alias("valid"))
    return z.select("key", "format", F.explode(F.transform(F.array(mrz.normalised(F.array("l1", "l2"))), shape)).alias("s")).select("key", "format", "s.*")


def _short(z: DataFrame) -> DataFrame:
    """The second line without the fillers before its last two characters, or as it is."""
    bare = F.regexp_replace(F.substring("l2", 1, 42), "<+$", "")
    return z.select("key", F.regexp_replace("l1", "<+$", "").alias("l1"), F.when(F.col("key") % 2 == 0, F.concat(bare, F.substring("l2", 43, 2))).otherwise(F.col("l2")).alias("l2"))


def mrz_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TD3 lines that have lost fillers, put right where that gives lines with dates."""
    t = _short(zones(spark, sf_dir, "TD3"))
    return t.select("key", F.explode(F.array(mrz.repaired_td3(F.array("l1", "l2")))).alias("r")).select("key", F.col("r")[0].alias("l1"), F.col("r")[1].alias("l2"))


def mrz_td1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TD1 lines with a doubled character in the first or second, a lost filler and digit, or a filler too many."""
    t = zones(spark, sf_dir, "TD1")
    at = (F.col("key") % 13 + 1).cast("int")
    longer = lambda c: F.concat(F.substring(c, F.lit(1), at), F.substring(F.col(c), at, F.lit(31)))
    how = F.col("key") % 5
    l1 = F.when(how == 0, longer("l1")).otherwise(F.col("l1"))
    l2 = F.when(how == 1, longer("l2")).when(how == 2, F.substring("l2", 1, 28)).otherwise(F.col("l2"))
    l3 = F.when(how == 3, F.concat("l3", F.lit("<"))).otherwise(F.col("l3"))
    return t.select("key", F.explode(F.array(mrz.repaired_td1(F.array(l1, l2, l3)))).alias("r")).select("key", F.col("r")[0].alias("l1"), F.col("r")[1].alias("l2"), F.col("r")[2].alias("l3"))


def mrz_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three readings of a zone the one with most valid checks, then the greatest confidence, then the first."""
    t = zones(spark, sf_dir, "TD3")
    k = F.col("key")
    readings = F.array(F.struct(F.lit(0).alias("no"), F.array("l1", F.concat(F.lit("Z"), F.substring("l2", 2, 43))).alias("lines"), F.lit(1.9).alias("c")), F.struct(F.lit(1).alias("no"), F.array("l1", "l2").alias("lines"), (1.5 + k % 3 / 10.0).alias("c")), F.struct(F.lit(2).alias("no"), F.array("l1", "l2").alias("lines"), F.lit(1.6).alias("c")))
    rows = t.select("key", F.explode(readings).alias("r")).select("key", "r.no", "r.c", mrz.score(mrz.normalised(F.col("r.lines")), "TD3").alias("checks"))
    return rows.groupBy("key").agg(F.max_by(F.struct("no", "checks"), F.struct("checks", "c", -F.col("no"))).alias("b")).select("key", "b.no", "b.checks")


QUERIES = {f.__name__: f for f in (mrz_check_digits, mrz_td3, mrz_td1, mrz_two_line_formats, mrz_scores, mrz_repair, mrz_td1_repair, mrz_best_candidate)}


# --- the oracles: the same lines, read in SQL ---


def _ok(x: str, n: int, d: str) -> str:
    return f"(CASE WHEN {d} BETWEEN '0' AND '9' THEN {digit(x, n)} = TRY_CAST({d} AS INT) ELSE false END)"


def _date(x: str, kind: str, year: int = YEAR) -> str:
    yy = f"TRY_CAST(substr({x}, 1, 2) AS INT)"
    full = f"CASE WHEN 2000 + {yy} > {year} THEN 1900 + {yy} ELSE 2000 + {yy} END" if kind == "birth" else f"CASE WHEN 2000 + {yy} - {year} >= 50 THEN 1900 + {yy} WHEN 2000 + {yy} - {year} < -50 THEN 2100 + {yy} ELSE 2000 + {yy} END"
    return f"(CASE WHEN regexp_full_match({x}, '[0-9]{{6}}') THEN TRY_CAST(({full})::VARCHAR || '-' || substr({x}, 3, 2) || '-' || substr({x}, 5, 2) AS DATE)::VARCHAR END)"


def _spaced(x: str) -> str:
    return f"trim(regexp_replace({x}, '<+', ' ', 'g'))"


def read_sql(name: str, source: str) -> str:
    """Rows of `source` (key, format, l1, l2, l3, and any more) with the pieces and checks of a format."""
    bare = lambda x: f"replace({x}, '<', '')"
    if name == "TD1":
        number, birth, expiry, zone, optional = "substr(l1, 6, 9)", "substr(l2, 1, 6)", "substr(l2, 9, 6)", "l3", "NULL::VARCHAR"
        sex, nation = "substr(l2, 8, 1)", "substr(l2, 16, 3)"
        whole = "(substr(l1, 6, 25) || substr(l2, 1, 7) || substr(l2, 9, 7) || substr(l2, 19, 11))"
        checks = [_ok(number, 9, "substr(l1, 15, 1)"), _ok(birth, 6, "substr(l2, 7, 1)"), _ok(expiry, 6, "substr(l2, 15, 1)"), _ok(whole, 50, "substr(l2, 30, 1)")]
        shape, kind = "length(l1) = 30 AND length(l2) = 30 AND length(l3) = 30", "true"
    else:
        width = {"TD3": 44, "TD2": 36, "MRV-A": 44, "MRV-B": 36}[name]
        number, birth, expiry, zone = "substr(l2, 1, 9)", "substr(l2, 14, 6)", "substr(l2, 22, 6)", f"substr(l1, 6, {width - 5})"
        sex, nation = "substr(l2, 21, 1)", "substr(l2, 11, 3)"
        optional = bare(f"substr(l2, 29, {dict(TD3=14, TD2=7).get(name, width - 28)})")
        checks = [_ok(number, 9, "substr(l2, 10, 1)"), _ok(birth, 6, "substr(l2, 20, 1)"), _ok(expiry, 6, "substr(l2, 28, 1)")]
        if name == "TD3":
            whole = "(substr(l2, 1, 10) || substr(l2, 14, 7) || substr(l2, 22, 22))"
            checks += [_ok("substr(l2, 29, 14)", 14, "substr(l2, 43, 1)"), _ok(whole, 39, "substr(l2, 44, 1)")]
        if name == "TD2":
            checks += [_ok("(substr(l2, 1, 10) || substr(l2, 14, 7) || substr(l2, 22, 14))", 31, "substr(l2, 36, 1)")]
        shape, kind = f"length(l1) = {width} AND length(l2) = {width}", f"substr(l1, 1, 1) IN ({dict(TD3="'P'", TD2="'A', 'C', 'I'").get(name, "'V'")})"
    n = " + ".join(f"{c}::INT" for c in checks)
    cut = f"instr({zone}, '<<')"
    return f"""(SELECT *, ({shape}) AND {kind} AS shaped, {_date(birth, 'birth')} AS born, {_date(expiry, 'expiry')} AS ends, {_date(birth, 'birth', 2000)} IS NOT NULL AND {_date(expiry, 'expiry', 2000)} IS NOT NULL AS dated, {n} AS n, {len(checks)} AS all_checks,
      {bare('substr(l1, 1, 2)')} AS document_class, {bare('substr(l1, 3, 3)')} AS issuing_state, {bare(number)} AS document_number, {bare(sex)} AS sex, {bare(nation)} AS nationality, {optional} AS optional_data,
      {_spaced(f"CASE WHEN {cut} > 0 THEN substr({zone}, 1, {cut} - 1) ELSE {zone} END")} AS surname, {_spaced(f"CASE WHEN {cut} > 0 THEN substr({zone}, {cut} + 2) ELSE '' END")} AS given_names FROM {source})"""


def fields_sql(name: str, source: str, first: str = "key") -> str:
    told = {"date_of_birth": "born", "date_of_expiry": "ends", "name": "trim(surname || ' ' || given_names)", "n_valid": "n", "status": "(n = all_checks)::INT", "error": "CASE WHEN born IS NULL OR ends IS NULL THEN 'date' END"}
    return f"SELECT {first}, " + ", ".join(f"CASE WHEN shaped THEN {told.get(c, c)} END AS {c}" for c in FIELDS) + f" FROM {read_sql(name, source)}"


def score_sql(name: str, source: str) -> str:
    return f"SELECT *, CASE WHEN shaped AND dated THEN n ELSE 0 END AS score FROM {read_sql(name, source)}"


_Z = f"z AS ({ZONES.format(customer='customer')})"
_TWO = ("TD3", "TD2", "MRV-A", "MRV-B")
_CANDIDATES = """
    SELECT key, 0 AS k, l1, l2, l3 FROM s
    UNION ALL SELECT key, 1 + d, l1, l2 || '<' || d::VARCHAR, l3 FROM s, range(10) AS r(d) WHERE length(l1) = 30 AND length(l2) = 28 AND length(l3) = 30
    UNION ALL SELECT key, 20, l1, l2, substr(l3, 1, 30) FROM s WHERE length(l3) = 31 AND l3 LIKE '%<'
    UNION ALL SELECT key, 30 + d, substr(l1, 1, d) || substr(l1, d + 2), l2, l3 FROM s, range(31) AS r(d) WHERE length(l1) = 31
    UNION ALL SELECT key, 70 + d, l1, substr(l2, 1, d) || substr(l2, d + 2), l3 FROM s, range(31) AS r(d) WHERE length(l2) = 31"""
ORACLES = {
    "mrz_check_digits": f"WITH {_Z} SELECT key, {digit('substr(l2, 1, 9)', 9)} AS digit, {_ok('substr(l2, 14, 6)', 6, 'substr(l2, 20, 1)')} AS birth_valid FROM z WHERE format = 'TD3'",
    "mrz_td3": f"WITH {_Z} {fields_sql('TD3', '(SELECT * FROM z WHERE format = $$TD3$$)')}",
    "mrz_td1": f"WITH {_Z}, c AS (SELECT key, replace(l1, ' ', '') AS l1, replace(l2, ' ', '') AS l2, replace(l3, ' ', '<') AS l3 FROM z WHERE format = 'TD1') {fields_sql('TD1', 'c')}",
    "mrz_two_line_formats": f"WITH {_Z} " + " UNION ALL ".join(fields_sql(name, f"(SELECT * FROM z WHERE format = '{name}')", "key, format") for name in _TWO[1:]),
    "mrz_scores": f"WITH {_Z}, s AS (" + " UNION ALL ".join(f"SELECT key, format, '{name}' AS reading, score, n, all_checks FROM ({score_sql(name, '(SELECT * FROM z WHERE format <> $$TD1$$)')})" for name in _TWO) + """)
        SELECT key, format, max(score) AS score, bool_or(score = all_checks AND (format = reading OR (format LIKE 'MRV%' AND reading LIKE 'MRV%'))) AND any_value(first) = substr(CASE format WHEN 'TD3' THEN 'P' WHEN 'TD2' THEN 'I' ELSE 'V' END, 1, 1) AS valid
        FROM s JOIN (SELECT key AS k2, format AS f2, substr(l1, 1, 1) AS first FROM z) ON key = k2 AND format = f2 GROUP BY key, format""",
    "mrz_repair": f"""WITH {_Z}, t AS (SELECT key, regexp_replace(l1, '<+$', '') AS a, CASE WHEN key % 2 = 0 THEN regexp_replace(substr(l2, 1, 42), '<+$', '') || substr(l2, 43, 2) ELSE l2 END AS l2 FROM z WHERE format = 'TD3'),
        u AS (SELECT key, CASE WHEN a LIKE 'P%' AND length(a) < 44 THEN rpad(a, 44, '<') ELSE a END AS l1, l2, '' AS l3 FROM t),
        c AS (SELECT *, 0 AS k FROM u UNION ALL SELECT key, l1, substr(l2, 1, length(l2) - 2) || repeat('<', 44 - length(l2)) || right(l2, 2), '', 1 FROM u WHERE length(l2) BETWEEN 30 AND 43 AND regexp_matches(l2, '[0-9]{{2}}$')),
        s AS (SELECT key, k, l1, l2, n, row_number() OVER (PARTITION BY key ORDER BY shaped AND dated DESC, CASE WHEN shaped AND dated THEN n ELSE 0 END DESC, k) AS place FROM {read_sql('TD3', 'c')})
        SELECT key, l1, l2 FROM s WHERE place = 1""",
    "mrz_td1_repair": f"""WITH {_Z}, t AS (SELECT key, key % 13 + 1 AS p, l1, l2, l3 FROM z WHERE format = 'TD1'),
        s AS (SELECT key, CASE WHEN key % 5 = 0 THEN substr(l1, 1, p) || substr(l1, p) ELSE l1 END AS l1, CASE key % 5 WHEN 1 THEN substr(l2, 1, p) || substr(l2, p) WHEN 2 THEN substr(l2, 1, 28) ELSE l2 END AS l2, CASE WHEN key % 5 = 3 THEN l3 || '<' ELSE l3 END AS l3 FROM t),
        c AS ({_CANDIDATES}),
        o AS (SELECT key, k, l1, l2, l3, row_number() OVER (PARTITION BY key ORDER BY shaped AND dated AND n = 4 DESC, k) AS place FROM {read_sql('TD1', 'c')})
        SELECT key, l1, l2, l3 FROM o WHERE place = 1""",
    "mrz_best_candidate": f"""WITH {_Z}, c AS (SELECT key, unnest([0, 1, 2]) AS no, l1, unnest(['Z' || substr(l2, 2, 43), l2, l2]) AS l2, '' AS l3, unnest([1.9, 1.5 + key % 3 / 10.0, 1.6])::DOUBLE AS c FROM z WHERE format = 'TD3'),
        o AS (SELECT key, no, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, c DESC, no) AS place FROM ({score_sql('TD3', 'c')})) SELECT key, no, score AS checks FROM o WHERE place = 1""",
}
