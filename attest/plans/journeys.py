"""Named queries over documents on their way: stages of observation, searches in two stages, sides that guide one another; and their SQL.

What models would observe is told by SQL texts that both engines run; the plans decide what is asked, of which documents, and what counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion, readings
from ..sources.tables import table
from . import documents, router
from .payloads import SEEN, dice, made, pick, quoted, view
from .zones import _Z, score_sql, zones

#: What each stage of observation tells.
TOLD = {"barcodes": ("aamva_valid", "ine_qr"), "td1": ("td1_shaped",), "two_line": ("mrv_checks", "td2_checks", "td3_checks"), "visual": ("ine_accepted", "swe_accepted"), "catalog": ("catalog_evidence",)}


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = made(spark, sf_dir, SEEN)
    observer = lambda columns: lambda asked: truth.select("doc_id", *columns).join(asked.select("doc_id"), "doc_id", "left_semi")
    return router.observe_in_stages(truth.select("doc_id", "profile", "layout_hint", "mrz_hint"), {stage: observer(columns) for stage, columns in TOLD.items()})


def staged_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's image: the stages that it was observed in, and the route that it took."""
    return routed(spark, sf_dir).select("doc_id", F.array_join("stages", ",").alias("stages"), "route")


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images each stage of observation was asked about."""
    return router.stage_counts(routed(spark, sf_dir))


#: What a reader finds in a band: the first line in one band of each document, parts of it or other text elsewhere; the second line at one place below, changed elsewhere. t and h: thousandths of the page.
_READ = """SELECT *, CASE
    WHEN t IN (720, 750, 780, 810, 840, 870, 900) AND h IN (45, 55, 65) AND t - 720 = key % 7 * 30 THEN CASE WHEN h = 45 + key % 3 * 10 THEN l1 ELSE substr(l1, 1, 40 - h % 3) END
    WHEN t IN (720, 750, 780, 810, 840, 870, 900) AND (t + h + key) % 4 = 0 THEN concat('P', substr(l1, 1, 30))
    WHEN (t + h + key) % 5 = 0 THEN l2 WHEN (t + h + key) % 5 = 1 THEN concat(substr(l2, 1, 43), '7') WHEN (t + h + key) % 5 = 2 THEN concat('X', l2) ELSE substr(l2, 2, 43) END AS text,
  CAST((t * 7 + h * 3 + key) % 10 AS DOUBLE) / 20 + 0.5 AS confidence FROM {bands}"""


def adaptive_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of each customer's passport, read in bands: the four likeliest first lines say where second lines are looked for. Lines, as many as customers, meet their bands by shuffles: a small file says little about their size."""
    lines = zones(spark, sf_dir, "TD3").select("key", "l1", "l2")

    def read(bands: DataFrame) -> DataFrame:
        rows = bands.join(lines.withColumnRenamed("key", "doc_id").hint("merge"), "doc_id").withColumns({"key": F.col("doc_id"), "t": F.round(F.col("top") * 1000).cast("int"), "h": F.round(F.col("height") * 1000).cast("int")})
        return spark.sql(_READ, bands=rows).drop("key", "t", "h", "l1", "l2")

    found = readings.adaptive_lines(lines.select(F.col("key").alias("doc_id")), read)
    return found.select("doc_id", F.element_at("lines", 1).alias("first"), F.element_at("lines", 2).alias("second"), F.round(readings.total(F.col("confidences")), 6).alias("confidence"), "checks", "bands")


#: Both sides of cards, by customer: what the front was taken for (two candidates), names and birth dates that agree or not, a QR payload on some backs.
CARDS = f"""SELECT c_custkey AS doc_id, c_custkey * 3 % 199 + 1 AS one, c_custkey * 5 % 197 + 1 AS two, upper(replace(c_name, '#', ' ')) AS f_name, {pick(["upper(replace(c_name, '#', ' '))", "substr(upper(replace(c_name, '#', ' ')), 1, 12)", "'SOMEBODY ELSE'", "''"], 'c_custkey', 'n')} AS b_name,
  {pick(quoted(['1980-03-21', '1980-03-21', '']), 'c_custkey', 'f')} AS f_born, {pick(quoted(['1980-03-21', '1980-03-21', '1980-03-21', '1990-01-01', '']), 'c_custkey', 'b')} AS b_born, {pick(quoted(['M', '']), 'c_custkey', 's')} AS sex, CASE WHEN {dice('c_custkey', 'q', 6)} = 0 THEN 'payload' END AS qr FROM {{customer}}"""


def barcode_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layout_table with barcode regions: visible ones, some in other light, some twice."""
    k = F.col("identifier")
    region = lambda bounds, light: F.struct(F.lit("barcode").alias("name"), F.array(*map(F.lit, bounds)).alias("bounds"), light.alias("lightType"), F.lit(0).alias("layer"))
    first, second = (0.1, 0.1, 0.5, 0.3), (0.5, 0.5, 0.9, 0.9)
    every = F.array(F.when(k % 2 == 0, region(first, F.lit(6))), F.when(k % 3 == 0, region(second, F.when(k % 5 == 0, 1).otherwise(24))), F.when(k % 14 == 0, region(first, F.lit(24))))
    return documents.layout_table(spark, sf_dir).withColumn("barcodes", F.array_compact(every))


def guided_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sides; symbols of the back are looked for where the front's relation says."""
    rows = made(spark, sf_dir, CARDS)
    symbol = lambda form, text: F.struct(F.lit(form).alias("format"), text.alias("text"))
    own = F.array(symbol("Aztec", F.concat(F.lit("own"), F.col("doc_id").cast("string"))))
    candidate = lambda c, sure: F.struct(F.col(c).cast("long").alias("identifier"), F.lit("card").alias("name"), F.lit(sure).alias("confidence"))
    front = F.struct(F.col("f_name").alias("name"), F.col("f_born").alias("date_of_birth"), "sex", F.array(symbol("PDF417", F.lit("front"))).alias("machine_barcodes"), F.lit(None).cast("string").alias("ine_qr"), F.array(candidate("one", 0.5), candidate("two", 0.4)).alias("candidates"))
    back = F.struct(F.col("b_name").alias("name"), F.col("b_born").alias("date_of_birth"), "sex", own.alias("machine_barcodes"), F.col("qr").alias("ine_qr"))

    def decode(regions: DataFrame) -> DataFrame:
        k = (F.col("doc_id") * 7 + F.col("identifier") * 3 + F.when(F.col("bounds")[0] > 0.3, 1).otherwise(0)) % 5
        url = F.concat(F.lit("https://qr.ine.mx/"), F.col("doc_id").cast("string"), F.lit("/20240101/a/"), F.col("identifier").cast("string"))
        told = F.when(k == 0, symbol("QRCode", url)).when(k == 1, symbol("Code128", F.concat(F.lit("12"), F.col("identifier").cast("string")))).when(k == 2, symbol("Aztec", F.concat(F.lit("own"), F.col("doc_id").cast("string")))).when(k == 3, symbol("QRCode", F.lit("https://qr.example.org/x")))
        return regions.select("doc_id", told.alias("s")).where(F.col("s").isNotNull()).select("doc_id", "s.*")

    out = fusion.guided_pairs(rows.select("doc_id", front.alias("front")), rows.select("doc_id", back.alias("back")), barcode_layouts(spark, sf_dir), decode)
    shown = F.array_join(F.array_sort(F.transform("result.machine_barcodes", lambda s: F.concat_ws(":", s["format"], s["text"]))), " ")
    return out.select("doc_id", "decision", F.col("front").alias("layout"), "relation", "regions", "related_barcodes", shown.alias("symbols"), F.col("result.ine_qr").alias("ine_qr"))


QUERIES = {f.__name__: f for f in (staged_routes, stage_counts, adaptive_bands, guided_pairs)}


def _route(seen: dict[str, str]) -> str:
    """SQL: the route, by what has been seen so far; what has not counts as not there."""
    s = {"aamva_valid": "false", "td1_shaped": "false", "mrv_checks": "0", "td2_checks": "0", "td3_checks": "0", "ine_accepted": "false", "swe_accepted": "false", "ine_qr": "false", "catalog_evidence": "false"} | seen
    return f"""CASE WHEN scan AND {s['aamva_valid']} THEN 'aamva' WHEN profile = 'aamva_pdf417' THEN 'rejected' WHEN {s['td1_shaped']} AND (auto OR profile IN ('mex_ine', 'icao_td1')) THEN 'td1' WHEN profile = 'icao_td1' THEN 'rejected' WHEN profile = 'mex_ine' THEN 'ine'
      WHEN profile = 'swe_id_2021' THEN CASE WHEN {s['swe_accepted']} THEN 'swe' ELSE 'rejected' END WHEN {s['mrv_checks']} = 3 AND (auto OR profile = 'icao_mrv') THEN 'mrv' WHEN {s['td2_checks']} = 4 AND (auto OR profile = 'icao_td2') THEN 'td2'
      WHEN {s['td3_checks']} = 5 AND (auto OR profile IN ('mex_passport', 'icao_td3')) THEN 'td3' WHEN NOT auto THEN 'rejected' WHEN layout_hint = 'mex_ine' AND {s['ine_accepted']} THEN 'ine' WHEN {s['swe_accepted']} THEN 'swe' WHEN {s['ine_accepted']} THEN 'ine' WHEN {s['ine_qr']} THEN 'ine_qr' WHEN {s['catalog_evidence']} THEN 'catalog' ELSE 'unsupported' END"""


def _stages() -> str:
    asked = {"barcodes": "auto OR profile IN ('mex_ine', 'aamva_pdf417') OR scan", "td1": "r IN ('unsupported', 'rejected', 'ine') AND profile IN ('mex_ine', 'icao_td1', 'auto_research')", "two_line": "r IN ('unsupported', 'rejected', 'ine') AND (auto OR profile IN ('icao_mrv', 'icao_td2', 'mex_passport', 'icao_td3'))", "visual": "r IN ('unsupported', 'rejected', 'ine') AND profile IN ('auto_research', 'mex_ine', 'swe_id_2021')", "catalog": "r = 'unsupported' AND auto"}
    out, at, seen = [f"s AS MATERIALIZED (SELECT *, profile = 'auto_research' AS auto, profile = 'aamva_pdf417' OR (profile = 'auto_research' AND coalesce(layout_hint, '') NOT IN ('mex_ine', 'swe_id_2021') AND mrz_hint IS NULL) AS scan FROM ({view(SEEN)}))"], "s", {}
    for k, (stage, columns) in enumerate(TOLD.items()):
        out.append(f"r{k} AS MATERIALIZED (SELECT * EXCLUDE (r), coalesce({asked[stage]}, false) AS n{k} FROM (SELECT *, {_route(seen)} AS r FROM {at}))")
        seen |= {c: f"(CASE WHEN n{k} THEN {c} END)" if "checks" in c else f"(n{k} AND {c})" for c in columns}
        at = f"r{k}"
    names = ", ".join(f"CASE WHEN n{k} THEN '{stage}' END" for k, stage in enumerate(TOLD))
    return ",\n".join(out) + f",\nz AS (SELECT doc_id, concat_ws(',', {names}) AS stages, {_route(seen)} AS route FROM {at})"


_BANDS = f"""WITH {_Z}, l AS MATERIALIZED (SELECT key, l1, l2 FROM z WHERE format = 'TD3'),
b1 AS MATERIALIZED (SELECT l.*, (top * 1000)::INT AS t, (height * 1000)::INT AS h FROM l, (SELECT unnest([0.72, 0.75, 0.78, 0.81, 0.84, 0.87, 0.90]) AS top), (SELECT unnest([0.045, 0.055, 0.065]) AS height)),
f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (text[1] = 'P')::INT DESC, abs(length(text) - 44), length(text) - length(replace(text, '<', '')) DESC, confidence DESC, t DESC, h DESC) AS place FROM ({_READ.format(bands='b1')})),
k AS (SELECT * FROM f WHERE place <= 4),
p AS (SELECT DISTINCT key, l1, l2, place, text AS one, confidence AS c1, t + o AS t, unnest([h, 55, 65]) AS h FROM k, (SELECT unnest([55, 65, 75, 85]) AS o)),
q AS (SELECT * FROM p WHERE t + h <= 995),
d AS MATERIALIZED (SELECT key, place, one, c1, t, h, text AS two, confidence AS c2 FROM ({_READ.format(bands='q')})),
g AS MATERIALIZED (SELECT key, one, two, max(row(round(c1 + c2, 9), -place, -t)) AS sure FROM d GROUP BY key, one, two),
n AS (SELECT key, count(*) AS bands FROM (SELECT DISTINCT key, t, h FROM q) GROUP BY key),
s AS (SELECT key, one AS l1, two AS l2, '' AS l3, 'TD3' AS format, sure FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, (length(l1) = 44 AND length(l2) = 44)::INT DESC, sure DESC) AS place FROM ({score_sql('TD3', 's')}))
SELECT key AS doc_id, l1 AS first, l2 AS second, round(sure[1], 6) AS confidence, score AS checks, bands FROM o JOIN n USING (key) WHERE place = 1"""

_PAIRED = f"""WITH c AS ({CARDS.format(customer='customer')}),
e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'related_document' ELSE 'paired_page' END AS relation, unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_partkey + 1, p_partkey + 2] ELSE [p_partkey + 1, p_partkey + 4] END) AS dst FROM part WHERE p_partkey % 3 < 2),
k AS (SELECT * FROM e WHERE dst IN (SELECT p_partkey FROM part)),
t AS (SELECT doc_id, qr, id, relation, dst, dense_rank() OVER (PARTITION BY doc_id ORDER BY rank) AS place FROM (SELECT doc_id, qr, 0 AS rank, one AS id FROM c UNION ALL SELECT doc_id, qr, 1, two FROM c) JOIN k USING (id)),
f AS (SELECT * FROM t WHERE place = 1),
g AS (SELECT doc_id, dst, unnest(list_filter([CASE WHEN dst % 2 = 0 THEN 0 END, CASE WHEN dst % 3 = 0 AND dst % 5 <> 0 THEN 1 END], lambda x: x IS NOT NULL)) AS side FROM f WHERE qr IS NULL),
s AS (SELECT *, (doc_id * 7 + dst * 3 + side) % 5 AS m FROM g),
u AS (SELECT doc_id, ['QRCode', 'Code128', 'Aztec', 'QRCode'][m + 1] AS format, CASE m WHEN 0 THEN 'https://qr.ine.mx/' || doc_id || '/20240101/a/' || dst WHEN 1 THEN '12' || dst WHEN 2 THEN 'own' || doc_id ELSE 'https://qr.example.org/x' END AS text FROM s WHERE m < 4),
w AS (SELECT doc_id, count(*) AS n, min(text) FILTER (starts_with(text, 'https://qr.ine.mx')) AS url FROM u GROUP BY doc_id),
y AS (SELECT doc_id, string_agg(s, ' ' ORDER BY s) AS symbols FROM (SELECT doc_id, format || ':' || text AS s FROM u UNION SELECT doc_id, 'Aztec:own' || doc_id FROM c) GROUP BY doc_id),
v AS (SELECT c.*, CASE WHEN b_name <> '' THEN starts_with(f_name, b_name) OR starts_with(b_name, f_name) END AS x, CASE WHEN f_born <> '' AND b_born <> '' THEN f_born = b_born END AS y, CASE WHEN sex <> '' THEN true END AS z FROM c),
d AS (SELECT *, CASE WHEN NOT coalesce(x, true) OR NOT coalesce(y, true) THEN 'mismatch' WHEN coalesce(x, false)::INT + coalesce(y, false)::INT + coalesce(z, false)::INT >= 2 THEN 'matched' ELSE 'review' END AS decision FROM v)
SELECT d.doc_id, decision, f.id AS layout, f.relation, coalesce(r.regions, 0) AS regions, CASE WHEN qr IS NOT NULL THEN 0 ELSE coalesce(w.n, 0) END AS related_barcodes,
       CASE WHEN decision <> 'matched' THEN 'PDF417:front' WHEN qr IS NOT NULL THEN 'Aztec:own' || d.doc_id ELSE y.symbols END AS symbols, CASE WHEN decision = 'matched' THEN coalesce(w.url, qr) END AS ine_qr
FROM d LEFT JOIN (SELECT DISTINCT doc_id, id, relation FROM f) AS f USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS regions FROM g GROUP BY doc_id) AS r USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN y USING (doc_id)"""

ORACLES = {"staged_routes": f"WITH {_stages()} SELECT * FROM z", "stage_counts": f"WITH {_stages()} SELECT unnest(string_split(stages, ',')) AS stage, count(*) AS documents FROM z WHERE stages <> '' GROUP BY stage", "adaptive_bands": _BANDS, "guided_pairs": _PAIRED}
