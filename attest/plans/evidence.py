"""Named queries over records made from customers, orders, events and pages: zones, barcodes, sides, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import barcodes, text
from ..operators import fusion
from ..sources import manifest
from ..sources.tables import table
from .payloads import dice, made, pick, quoted, view


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as decoded symbols, in the order of their ids."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("format"), F.col("props").alias("text"), "value")


def barcode_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.keep_first(_symbols(spark, sf_dir), ["doc_id", "format", "text"], "seq").withColumn("value", F.round("value", 6))


def barcode_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.first_and_last(_symbols(spark, sf_dir), ["doc_id"], ["format", "text"], "seq", ["value"]).withColumn("value", F.round("value", 6))


def symbologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(barcodes.symbology(F.col("p_size") % 20).alias("symbology")).agg(F.count("*").alias("n"))


_O = "o_orderkey"
#: Runs in both engines: an order as two sides of a document, whose evidence differs by a digest of its key.
SIDES = f"""SELECT o_orderkey AS key, {pick(quoted(['Utopia', 'Utopia', 'UTO', '', None]), _O, 'a')} AS f_country, {pick(quoted(['UTO', 'Utopia', 'Sweden', '']), _O, 'b')} AS b_country, {pick(["'Clerk#' || CAST(o_custkey AS STRING)", "''", "NULL"], _O, 'c')} AS f_name, {pick(["'Clerk#' || CAST(o_custkey AS STRING)", "substr('Clerk#' || CAST(o_custkey AS STRING), 1, 7)", "'Somebody Else'", "''", "upper('Clerk ' || CAST(o_custkey AS STRING))"], _O, 'd')} AS b_name,
  {pick(quoted(['DOE', 'DOE', '']), _O, 'e')} AS f_surname, {pick(quoted(['DOE', 'DOERR', 'ROE', '']), _O, 'f')} AS b_surname, {pick(quoted(['JANE', '']), _O, 'g')} AS f_given, {pick(quoted(['JANE', 'J']), _O, 'h')} AS b_given, {pick(quoted(['1980-03-21', '21/03/1980', '']), _O, 'i')} AS f_born, {pick(quoted(['21.03.1980', '1980-03-21', '1990-01-01', '']), _O, 'j')} AS b_born,
  {pick(quoted(['F', 'M', '', '']), _O, 'k')} AS f_sex, {pick(quoted(['F', '', '']), _O, 'l')} AS b_sex, {pick(quoted(['', 'A1']), _O, 'm')} AS f_number, {pick(quoted(['', 'B2', 'B3']), _O, 'n')} AS b_number, {pick(quoted(['', 'old']), _O, 'o')} AS f_zone, {pick(quoted(['', 'P<UTO']), _O, 'p')} AS b_zone, {pick(quoted(['', 'a', 'a,b']), _O, 'q')} AS f_list, {pick(quoted(['', 'c']), _O, 'r')} AS b_list,
  CAST({dice(_O, 's', 3)} - 1 AS INT) AS f_status, CAST({dice(_O, 't', 3)} - 1 AS INT) AS b_status, {pick(quoted(['pass', 'review', None]), _O, 'u')} AS f_capture, {pick(quoted(['pass', 'not_available', 'spoof']), _O, 'v')} AS b_capture FROM {{orders}}"""


def pair_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts and backs of documents: names cut short, parted or missing, dates in either order."""
    rows = made(spark, sf_dir, SIDES)
    pages = lambda c: F.filter(F.split(c, ","), lambda x: x != "")

    def side(s: str) -> Column:
        of = {"country": "country", "name": "name", "surname": "surname", "given_names": "given", "date_of_birth": "born", "sex": "sex", "document_number": "number", "mrz_code": "zone", "status": "status", "capture": "capture"}
        return F.struct(*(F.col(f"{s}_{c}").alias(k) for k, c in of.items()), pages(F.col(f"{s}_list")).alias("mrz_strings"), F.array(F.lit("VISUAL"), F.lit("MRZ" if s == "b" else "BARCODE")).alias("sources"), F.lit("VISUAL").alias("source"), F.lit("CATALOG-P1").alias("profile"))

    out = fusion.fused(rows.select("key", side("f").alias("front"), side("b").alias("back")), key=text.ascii_key)
    r = "result."
    return out.select("key", *(F.col(c).cast("int").alias(c) for c in ("check_country", "check_name", "check_surname", "check_date_of_birth", "check_sex")), "decision", *(F.col(r + c).alias(c) for c in ("name", "document_number", "mrz_code", "status", "capture", "source", "profile")), F.array_join(r + "mrz_strings", ",").alias("mrz_strings"), F.array_join(r + "sources", ",").alias("sources"))


def unicode_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC keys of whole document texts, as digests, and how many letters lose a mark."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.nfkc_key(F.col("text")), 256).alias("key_sha256"), F.length(text.letters_nfkd(F.col("text"))).alias("letters"))


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files of an asset bundle: path, size, digest."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("texts/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    return manifest.described(files)


def manifest_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of which every 40th file has changed and every 90th is gone."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("texts/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    noted = manifest.described(d.select("path", F.col("t").cast("binary").alias("content")))
    now = d.where(F.col("doc_id") % 90 != 3).select("path", F.when(F.col("doc_id") % 40 == 5, F.concat("t", F.lit("!"))).otherwise(F.col("t")).cast("binary").alias("content"))
    return manifest.mismatches(noted, manifest.described(now)).select("path", "problem")


QUERIES = {f.__name__: f for f in (barcode_dedup, barcode_merge, symbologies, pair_fuse, unicode_keys, manifest_rows, manifest_mismatches)}

_SYMBOL_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in barcodes.SYMBOLOGY.items())
_KEY = "upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"
_MEETS = "CASE WHEN coalesce({0}, '') <> '' AND coalesce({1}, '') <> '' THEN (starts_with(" + _KEY.format("{0}") + ", " + _KEY.format("{1}") + ") OR starts_with(" + _KEY.format("{1}") + ", " + _KEY.format("{0}") + "))::INT END"
_DAY = "CASE WHEN regexp_matches({0}, '^[0-9]{{4}}') THEN regexp_replace({0}, '[^0-9]', '', 'g') ELSE substr(regexp_replace({0}, '[^0-9]', '', 'g'), 5, 4) || substr(regexp_replace({0}, '[^0-9]', '', 'g'), 3, 2) || substr(regexp_replace({0}, '[^0-9]', '', 'g'), 1, 2) END"
ORACLES = {
    "barcode_dedup": "SELECT user_id AS doc_id, event_type AS format, props AS text, min(event_id) AS seq, round(arg_min(value, event_id), 6) AS value FROM events GROUP BY ALL",
    "barcode_merge": "SELECT user_id AS doc_id, event_type AS format, props AS text, min(event_id) AS seq, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY ALL",
    "symbologies": f"SELECT CASE p_size % 20 {_SYMBOL_CASES} END AS symbology, count(*) AS n FROM part GROUP BY 1",
    "pair_fuse": f"""WITH s AS ({view(SIDES)}), n AS (SELECT *, coalesce(nullif(f_name, ''), nullif(trim(f_surname || ' ' || f_given), '')) AS f_whole, coalesce(nullif(b_name, ''), nullif(trim(b_surname || ' ' || b_given), '')) AS b_whole FROM s),
        d AS (SELECT *, {_DAY.format('f_born')} AS f_day, {_DAY.format('b_born')} AS b_day FROM n),
        c AS (SELECT *, {_MEETS.format('f_country', 'b_country')} AS check_country, {_MEETS.format('f_whole', 'b_whole')} AS check_name, {_MEETS.format('f_surname', 'b_surname')} AS check_surname, CASE WHEN f_born <> '' AND b_born <> '' THEN (f_day = b_day)::INT END AS check_date_of_birth, {_MEETS.format('f_sex', 'b_sex')} AS check_sex FROM d),
        e AS (SELECT *, [check_country, check_name, check_surname, check_date_of_birth, check_sex] AS k FROM c), g AS (SELECT *, CASE WHEN list_contains(k, 0) THEN 'mismatch' WHEN coalesce(list_sum(k), 0) >= 2 THEN 'matched' ELSE 'review' END AS decision FROM e)
        SELECT key, check_country, check_name, check_surname, check_date_of_birth, check_sex, decision, f_name AS name, CASE WHEN decision = 'matched' AND b_number <> '' THEN b_number ELSE f_number END AS document_number, CASE WHEN decision = 'matched' AND b_zone <> '' THEN b_zone ELSE f_zone END AS mrz_code,
          CASE WHEN decision = 'matched' THEN greatest(f_status, b_status) ELSE f_status END AS status, CASE WHEN f_capture = 'review' OR b_capture = 'spoof' THEN 'review' WHEN f_capture = 'pass' OR b_capture = 'pass' THEN 'pass' ELSE 'not_available' END AS capture,
          CASE WHEN decision = 'matched' THEN 'MULTI_SOURCE' ELSE 'VISUAL' END AS source, CASE WHEN decision = 'matched' THEN 'PAIRED-DOCUMENT' ELSE 'CATALOG-P1' END AS profile, CASE WHEN decision = 'matched' AND b_list <> '' THEN b_list ELSE f_list END AS mrz_strings, CASE WHEN decision = 'matched' THEN 'VISUAL,BARCODE,MRZ' ELSE 'VISUAL,BARCODE' END AS sources FROM g""",
    "manifest_rows": "SELECT 'texts/' || doc_id AS path, strlen(coalesce(text, ''))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "manifest_mismatches": "SELECT 'texts/' || doc_id AS path, CASE WHEN doc_id % 90 = 3 THEN 'missing' ELSE 'size' END AS problem FROM documents WHERE doc_id % 90 = 3 OR doc_id % 40 = 5",
}
