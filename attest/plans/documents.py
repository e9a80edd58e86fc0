"""Named queries over parts, line items and conversations read as a document catalog, classifier candidates and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, fusion, layouts
from ..sources.tables import table

TYPES = ("VotingCard", "IdentityCard", "Passport", "Visa", "DriverLicense")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog documents."""
    k = F.col("p_partkey")
    pick = lambda values, by=1: F.element_at(F.array(*(F.lit(v) for v in values)), (F.floor(k / by) % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("identifier"), F.concat("p_name", F.lit(" "), pick(("front", "back", "page 2", "2021", "Side B"))).alias("caption"), F.col("p_brand").alias("country"),
        F.array(pick(("MEX", "SWE", "UTO")), F.upper(F.substring("p_brand", 1, 3))).alias("iso_codes"), pick(TYPES).alias("document_type"), pick(("ID1", "ID2", "ID3"), 5).alias("document_format"),
        (1990 + k % 30).cast("string").alias("year"), F.lit("").alias("series"), F.array().cast("array<string>").alias("state_codes"), (k % 10 == 9).alias("deprecated"),
        (k % 2 == 0).alias("mrz_present"), (k % 16 == 0).alias("mrz_ignored"), F.when(k % 13 == 0, "td2").alias("mrz_expected"),
    )


_DOCS = f"""
docs AS (SELECT p_partkey AS identifier, p_name || ' ' || ['front', 'back', 'page 2', '2021', 'Side B'][p_partkey % 5 + 1] AS caption, p_brand AS country, [['MEX', 'SWE', 'UTO'][p_partkey % 3 + 1], upper(substr(p_brand, 1, 3))] AS iso_codes,
  {list(TYPES)}[p_partkey % 5 + 1] AS document_type, ['ID1', 'ID2', 'ID3'][(p_partkey // 5) % 3 + 1] AS document_format, (1990 + p_partkey % 30)::VARCHAR AS year, p_partkey % 10 = 9 AS deprecated,
  p_partkey % 2 = 0 AS mrz_present, p_partkey % 16 = 0 AS mrz_ignored, CASE WHEN p_partkey % 13 = 0 THEN 'td2' END AS mrz_expected FROM part)"""


def _rank() -> Column:
    """Line numbers repeat within an order: what they leave open the part and the quantity settle."""
    return F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")


_RANK = "(l_linenumber::BIGINT * 10000000 + l_partkey * 100 + l_quantity::BIGINT)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ranked candidates of an order's image, with their documents; every 20th is one that the catalog does not know."""
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _rank().alias("rank"), F.when(F.col("l_partkey") % 20 == 7, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("identifier"), F.round(F.col("l_quantity") / 50, 4).alias("confidence"))
    return catalog.with_documents(raw, documents(spark, sf_dir))


_CAND = f"""{_DOCS},
raw AS (SELECT l_orderkey AS doc_id, {_RANK} AS rank, CASE WHEN l_partkey % 20 = 7 THEN -l_partkey ELSE l_partkey END AS identifier, round(l_quantity / 50, 4) AS confidence FROM lineitem),
cand AS (SELECT raw.*, docs.* EXCLUDE (identifier) FROM raw LEFT JOIN docs USING (identifier))"""


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(documents(spark, sf_dir), query=" PAGE 2", country="uto", document_type="passport").select("identifier", "caption", "country")


def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.search(documents(spark, sf_dir), document_format="id2", deprecated=True)
    return catalog.page(found, offset=20, limit=25).select("identifier", "caption", "total")


def catalog_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.facets(documents(spark, sf_dir))


def catalog_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(F.col("identifier") == 42).select("identifier", "caption", "document_type", "document_format")


def classifier_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unambiguous(candidates(spark, sf_dir)).select("doc_id", "identifier", "confidence")


def classifier_layout_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.layout_hint(candidates(spark, sf_dir).withColumn("confidence", F.col("confidence").cast("decimal(10,4)")))


def classifier_voter_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.voter_card(candidates(spark, sf_dir))


def classifier_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).where(F.array_contains("iso_codes", "MEX") & (F.col("document_type") == "VotingCard"))
    return catalog.orientation(c.select("doc_id", (F.col("rank") % 4 * 90).alias("degrees"), F.col("confidence").cast("decimal(10,4)").alias("confidence")))


def classifier_mrz_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("identifier", catalog.mrz_hint(F.col("document_type"), F.col("document_format"), F.col("caption"), F.col("mrz_present"), F.col("mrz_ignored"), F.col("mrz_expected")).alias("hint"))


def classifier_confirms(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = candidates(spark, sf_dir).where(F.floor(F.col("rank") / 10_000_000) == 1)
    said = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    name, issuer = said(("Passport", "Visa", "Identity Card", "Identity Document", "Voter Credential")), said(("UTO", "MEX", ""))
    return first.select("doc_id", catalog.confirms(issuer, F.lit("Mexico"), name, F.col("confidence"), F.col("iso_codes"), F.col("document_type"), F.col("document_format")).alias("confirmed"))


def effective_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")).alias("requested"))
    return catalog.effective_identifier(asked, candidates(spark, sf_dir))


def layout_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as layouts that name the next two as children and pages; captions state roles for some."""
    k = F.col("p_partkey")
    said = F.element_at(F.array(*map(F.lit, ("Card front", "Card Side B", "Booklet page 3", "Plain", "Page cover", "Front cover", "Booklet", "sheet PAGE C"))), (k % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("identifier"), said.alias("caption"), F.when(k % 3 == 0, F.array(k + 1, k + 2)).alias("child_documents"), F.when(k % 3 == 1, F.array(k + 1, k + 4)).alias("paired_pages"), F.when(k % 3 == 2, k - 1).alias("parent_identifier"))


_LAYOUTS = """
lay AS (SELECT p_partkey AS id, ['Card front', 'Card Side B', 'Booklet page 3', 'Plain', 'Page cover', 'Front cover', 'Booklet', 'sheet PAGE C'][p_partkey % 8 + 1] AS caption,
  ['front', 'back', 'numbered_page', NULL, NULL, 'front_cover', NULL, 'numbered_page'][p_partkey % 8 + 1] AS own, CASE p_partkey % 8 WHEN 2 THEN 3 WHEN 7 THEN 3 END AS ordinal FROM part)"""


def page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layouts.page_roles(layout_table(spark, sf_dir))
    return rows.select("identifier", "role", "ordinal", "method", F.array_join(F.transform("related", lambda x: x.cast("string")), ",").alias("related"))


def layout_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.relations(layout_table(spark, sf_dir))


def catalog_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _rank().alias("rank"), F.col("l_partkey").alias("identifier"))
    rows = fusion.catalog_relation(c, layout_table(spark, sf_dir))
    return rows.select("doc_id", "front", "relation", F.array_join(F.transform("related", lambda x: x["identifier"].cast("string")), ",").alias("related"))


#: Runs in both engines: turns as pages of layouts, whose ordinals and relations depend on a digest; some have none.
_ORDERED = """
SELECT CAST(conv_id AS STRING) || '/' || CAST(CAST(floor(turn / 10) AS INT) AS STRING) AS collection_id, turn AS position,
       CASE WHEN h % 9 = 0 THEN NULL ELSE CAST(turn % 7 AS BIGINT) END AS identifier, CASE WHEN h % 8 = 1 THEN NULL ELSE h % 4 END AS ordinal,
       CAST(h % 7 AS BIGINT) AS one, CAST(h * 3 % 7 AS BIGINT) AS two
FROM (SELECT conv_id, turn, ascii(substr(md5(CAST(conv_id AS STRING) || '+' || CAST(turn AS STRING)), 1, 1)) + ascii(substr(md5(CAST(conv_id AS STRING) || '+' || CAST(turn AS STRING)), 2, 1)) AS h FROM {conversations}) AS t
"""


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation, as many as a collection may have pages."""
    pages = spark.sql(_ORDERED, conversations=table(spark, sf_dir, "conversations")).withColumn("related", F.array("one", "two"))
    rows = fusion.page_order(pages.withColumn("ordinal", F.col("ordinal").cast("int")))
    return rows.select("collection_id", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"), "decision", "method")


#: Runs in both engines: turns as pages, whose evidence depends on a digest of conversation and turn.
_PAGES = """
SELECT CAST(conv_id AS STRING) || '/' || CAST(CAST(floor(turn / 10) AS INT) AS STRING) AS collection_id, turn AS position,
       CASE WHEN h % 5 = 0 THEN '' WHEN h % 5 = 1 THEN 'UTOPIA' WHEN h % 25 = 2 THEN 'SWEDEN' ELSE 'UTO' END AS country,
       CASE WHEN h % 7 = 0 THEN '' WHEN h % 29 = 1 THEN 'MARY' ELSE substr('JOHNDOE', 1, 4 + h % 4) END AS name,
       CASE WHEN h % 3 = 0 THEN 'DOE' ELSE '' END AS surname,
       CASE WHEN h % 4 = 0 THEN '' WHEN h % 23 = 3 THEN '19900101' ELSE '19800321' END AS date_of_birth,
       CASE WHEN h % 6 = 0 THEN 'M' ELSE '' END AS sex,
       CASE WHEN h % 2 = 0 THEN '' ELSE 'D' || CAST(turn AS STRING) END AS document_number, h % 2 AS status,
       CASE WHEN h % 11 = 0 THEN 'review' WHEN h % 3 = 0 THEN 'pass' WHEN h % 3 = 1 THEN 'not_available' END AS capture
FROM (SELECT conv_id, turn, ascii(substr(md5(CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)), 1, 1)) + ascii(substr(md5(CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)), 2, 1)) AS h FROM {conversations}) AS t
"""


def page_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.folded_pages(spark.sql(_PAGES, conversations=table(spark, sf_dir, "conversations")))
    return rows.withColumn("page_decisions", F.array_join("page_decisions", ","))


def field_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fields need, over edges from each part to two before it, to itself, and from the sixth back to the twelfth, a cycle."""
    k = F.col("p_partkey").cast("long")
    p = table(spark, sf_dir, "part").select(k.alias("k"))
    edges = p.select(F.col("k").alias("name"), F.explode(F.array(F.floor(F.col("k") / 2), F.floor(F.col("k") / 3), F.when(F.col("k") == 6, F.lit(12)).otherwise(F.col("k")))).alias("needs")).where(F.col("needs") > 0)
    return layouts.dependencies(p.select(F.col("k").alias("root"), F.col("k").alias("name")), edges)


#: Runs in both engines: up to two readings of each of three parts of customers' names, and of the whole.
_READINGS = """
SELECT c_custkey AS doc_id, k AS pos, CASE WHEN k = 6 THEN 9 ELSE CAST(floor(k / 2) AS INT) + 1 END AS type, 'part' || CAST(k AS STRING) AS name,
       CASE WHEN d % 3 = 0 THEN '' WHEN k = 6 AND d % 4 > 0 THEN '' WHEN d % 7 = 1 THEN ' ' || c_mktsegment || ',' ELSE substr(c_name, 1 + k, 9) || CAST(k AS STRING) END AS value, CAST(d % 5 AS DOUBLE) / 10 + 0.25 AS confidence
FROM (SELECT c_custkey, c_name, c_mktsegment, k, ascii(substr(md5(CAST(c_custkey AS STRING) || '/' || CAST(k AS STRING)), 1, 1)) + ascii(substr(md5(CAST(c_custkey AS STRING) || '/' || CAST(k AS STRING)), 2, 1)) AS d
      FROM {customer} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) AS seven) AS t
"""


def _assembly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Readings of customers' cards, and the rule that puts three of their fields together."""
    readings = spark.sql(_READINGS, customer=table(spark, sf_dir, "customer"))
    pos = F.col("pos").cast("double")
    readings = readings.withColumns({"locale": F.lit(None).cast("int"), "bounds": F.array(pos, F.lit(0.0), pos + 1, F.lit(1.0))})
    part = lambda kind, t=None, value=None: (kind, t, None, value)
    rules = spark.createDataFrame([(1, (9, "full", None), [part("field", 1), part("literal", value=", "), part("field", 2), part("literal", value=" / "), part("literal", value=" - "), part("field", 3)])], "rule int, target struct<type:int,name:string,locale:int>, parts array<struct<kind:string,type:int,locale:int,value:string>>")
    return readings, rules


def field_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts of customers' names put together by a rule with literals; some parts are missing, some were read twice."""
    rows = layouts.assembled(*_assembly(spark, sf_dir))
    return rows.select("doc_id", "value", F.round("confidence", 6).alias("confidence"), F.array_join("derived_from", ",").alias("derived_from"), F.element_at("bounds", 1).alias("left"), F.element_at("bounds", 3).alias("right"))


def layout_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requested fields of each card: one is put together from four of the fields that were read, the other is read."""
    readings, rules = _assembly(spark, sf_dir)
    edges = spark.createDataFrame([("full", f"part{k}") for k in (0, 1, 3, 5)], "name string, needs string")
    rows = layouts.recognised_layout(readings, rules, edges, ["full", "part3"])
    return rows.select("doc_id", "name", "value", F.round("confidence", 6).alias("confidence"), F.col("derived").cast("int").alias("derived"))


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of readings of one field the surest, the later of equal ones: line items of a supplier, by return flag."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("name"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("value"), F.col("l_quantity").alias("confidence"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).alias("pos"))
    return layouts.field_values(rows)


def read_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    top = F.round(k % 50 / 100.0, 4)
    bounds = F.array(F.lit(0.1), top, F.lit(0.9), top + F.round((k % 7 + 1) / 20.0, 4))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(layouts.candidate_windows(bounds, F.lit(0.05))).alias("place", "w"))
    return rows.select("p_partkey", "place", F.round(F.col("w")[1], 8).alias("top"), F.round(F.col("w")[3], 8).alias("bottom"))


QUERIES = {f.__name__: f for f in (catalog_search, catalog_page, catalog_facets, catalog_item, classifier_margin, classifier_layout_hint, classifier_voter_card, classifier_orientation, classifier_mrz_hint, classifier_confirms, effective_identifier, page_roles, layout_relations, catalog_relation, page_order, page_fold, field_closure, field_assembly, layout_recognition, field_values, read_windows)}

_KNOWN = "SELECT * FROM cand WHERE caption IS NOT NULL"
_OK = "CASE WHEN length(f.{0}) > 0 AND length(p.{0}) > 0 THEN starts_with(f.{0}, p.{0}) OR starts_with(p.{0}, f.{0}) END"
ORACLES = {
    "page_fold": f"""WITH p AS ({_PAGES.format(conversations='conversations')}),
        n AS (SELECT collection_id, count(*) AS n FROM p GROUP BY 1), q AS (SELECT p.* FROM p JOIN n USING (collection_id) WHERE n BETWEEN 2 AND 10),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY position) AS place FROM q) WHERE place = 1),
        c AS (SELECT p.*, [{_OK.format('country')}, {_OK.format('name')}, {_OK.format('surname')}, CASE WHEN length(f.date_of_birth) > 0 AND length(p.date_of_birth) > 0 THEN f.date_of_birth = p.date_of_birth END, {_OK.format('sex')}] AS r FROM q AS p JOIN f ON p.collection_id = f.collection_id WHERE p.position > f.position),
        d AS (SELECT *, CASE WHEN list_contains(r, false) THEN 'mismatch' WHEN len(list_filter(r, lambda x: x)) >= 2 THEN 'matched' ELSE 'review' END AS decision FROM c),
        g AS (SELECT collection_id, CASE WHEN bool_or(decision = 'mismatch') THEN 'mismatch' WHEN bool_and(decision = 'matched') THEN 'matched' ELSE 'review' END AS decision, string_agg(decision, ',' ORDER BY position) AS page_decisions, count(*) FILTER (decision = 'matched') + 1 AS matched_pages,
          arg_max(document_number, position) FILTER (decision = 'matched' AND document_number <> '') AS number, max(status) FILTER (decision = 'matched') AS status FROM d GROUP BY collection_id),
        k AS (SELECT collection_id, CASE WHEN bool_or(capture = 'review') THEN 'review' WHEN bool_or(capture = 'pass') THEN 'pass' ELSE 'not_available' END AS capture FROM q GROUP BY collection_id)
        SELECT n.collection_id, CASE WHEN f.collection_id IS NULL THEN 'page_count' END AS error, g.decision, page_decisions, matched_pages, country, name, surname, date_of_birth, sex, coalesce(number, document_number) AS document_number, greatest(f.status, g.status) AS status, k.capture
        FROM n LEFT JOIN f USING (collection_id) LEFT JOIN g USING (collection_id) LEFT JOIN k USING (collection_id)""",
    "catalog_search": f"WITH {_DOCS} SELECT identifier, caption, country FROM docs WHERE NOT deprecated AND list_contains(iso_codes, 'UTO') AND document_type = 'Passport' AND contains(lower(caption), 'page 2')",
    "catalog_page": f"WITH {_DOCS}, f AS (SELECT *, count(*) OVER () AS total FROM docs WHERE document_format = 'ID2') SELECT identifier, caption, total FROM f ORDER BY country, caption, year, identifier LIMIT 25 OFFSET 20",
    "catalog_facets": f"""WITH {_DOCS}, d AS (SELECT * FROM docs WHERE NOT deprecated), x AS (SELECT unnest(iso_codes) AS value, country, row_number() OVER (ORDER BY country, caption, year, identifier) AS k FROM d)
        SELECT 'country' AS facet, value, arg_min(country, k) AS name, count(*) AS count FROM x GROUP BY value UNION ALL SELECT 'type', document_type, NULL, count(*) FROM d GROUP BY document_type UNION ALL SELECT 'format', document_format, NULL, count(*) FROM d GROUP BY document_format""",
    "catalog_item": f"WITH {_DOCS} SELECT identifier, caption, document_type, document_format FROM docs WHERE identifier = 42",
    "classifier_margin": f"WITH {_CAND}, r AS (SELECT doc_id, identifier, confidence, row_number() OVER w AS k, coalesce(lead(confidence) OVER w, 0) AS s FROM ({_KNOWN}) WINDOW w AS (PARTITION BY doc_id ORDER BY rank)) SELECT doc_id, identifier, confidence FROM r WHERE k = 1 AND confidence >= 0.65 AND confidence - s >= 0.15",
    "classifier_layout_hint": f"""WITH {_CAND}, h AS (SELECT doc_id, rank, confidence::DECIMAL(10, 4) AS confidence, CASE WHEN list_contains(iso_codes, 'MEX') AND document_type = 'VotingCard' THEN 'mex_ine' WHEN list_contains(iso_codes, 'SWE') AND document_type = 'IdentityCard' AND contains(caption, '2021') THEN 'swe_id_2021' END AS hint FROM cand),
        s AS (SELECT doc_id, hint, sum(confidence) AS c, min(rank) AS r FROM h WHERE hint IS NOT NULL GROUP BY doc_id, hint), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, r) AS k FROM s) SELECT doc_id, hint FROM b WHERE k = 1 AND c >= 0.45""",
    "classifier_voter_card": f"WITH {_CAND}, b AS (SELECT doc_id, identifier, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, rank) AS k FROM cand WHERE list_contains(iso_codes, 'MEX') AND document_type = 'VotingCard') SELECT doc_id, identifier, confidence FROM b WHERE k = 1 AND confidence >= 0.2",
    "classifier_orientation": f"WITH {_CAND}, s AS (SELECT doc_id, rank % 4 * 90 AS degrees, sum(confidence::DECIMAL(10, 4)) AS s FROM cand WHERE list_contains(iso_codes, 'MEX') AND document_type = 'VotingCard' GROUP BY ALL) SELECT doc_id, arg_max(degrees, row(s, -degrees)) AS degrees FROM s GROUP BY doc_id",
    "classifier_mrz_hint": f"""WITH {_DOCS} SELECT identifier, CASE WHEN mrz_ignored THEN NULL WHEN mrz_expected IS NOT NULL THEN mrz_expected WHEN document_type = 'Visa' AND document_format IN ('ID2', 'ID3') THEN 'mrv' WHEN document_type = 'Passport' AND document_format = 'ID3' THEN 'td3'
        WHEN mrz_present THEN CASE document_format WHEN 'ID1' THEN 'td1' WHEN 'ID2' THEN 'td2' WHEN 'ID3' THEN 'td3' END END AS hint FROM docs""",
    "classifier_confirms": f"""WITH {_CAND}, n AS (SELECT *, ['Passport', 'Visa', 'Identity Card', 'Identity Document', 'Voter Credential'][doc_id % 5 + 1] AS name, ['UTO', 'MEX', ''][doc_id % 3 + 1] AS issuer FROM cand WHERE rank // 10000000 = 1)
        SELECT doc_id, coalesce(confidence >= 0.2 AND (issuer = '' OR list_contains(iso_codes, issuer)) AND ((name = 'Voter Credential' AND list_contains(iso_codes, 'MEX') AND document_type = 'VotingCard') OR (name = 'Passport' AND document_format = 'ID3' AND document_type = 'Passport')
          OR (name = 'Visa' AND document_type = 'Visa' AND document_format IN ('ID2', 'ID3')) OR (name = 'Identity Card' AND document_format = 'ID1') OR (name = 'Identity Document' AND document_format = 'ID2')), false) AS confirmed FROM n""",
    "effective_identifier": f"WITH {_CAND}, f AS (SELECT doc_id, arg_min(identifier, rank) AS told FROM ({_KNOWN}) WHERE confidence >= 0.65 GROUP BY doc_id) SELECT o_orderkey AS doc_id, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END, told) AS identifier FROM orders LEFT JOIN f ON o_orderkey = doc_id",
    "page_roles": f"""WITH {_LAYOUTS}, e AS (SELECT id AS src, unnest([id + 1, id + 2]) AS dst, 'child' AS kind FROM lay WHERE id % 3 = 0 UNION ALL SELECT id, unnest([id + 1, id + 4]), 'page' FROM lay WHERE id % 3 = 1),
        t AS (SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) FILTER (kind = 'child' AND own IN ('back', 'back_cover')) AS backs, string_agg(dst::VARCHAR, ',' ORDER BY dst) FILTER (kind = 'page' AND own = 'numbered_page' AND ordinal > 1) AS pages FROM e JOIN lay ON dst = id GROUP BY src)
        SELECT id AS identifier, CASE WHEN own IS NOT NULL THEN own WHEN backs IS NOT NULL THEN 'front' WHEN pages IS NOT NULL THEN 'primary_page' ELSE 'unknown' END AS role, CASE WHEN own IS NOT NULL THEN ordinal WHEN backs IS NULL AND pages IS NOT NULL THEN 1 END AS ordinal,
          CASE WHEN own IS NOT NULL THEN 'caption_marker' WHEN backs IS NOT NULL THEN 'related_back_layout' WHEN pages IS NOT NULL THEN 'related_numbered_page' ELSE 'unavailable' END AS method, CASE WHEN own IS NULL THEN coalesce(backs, pages) END AS related FROM lay LEFT JOIN t ON id = src""",
    "layout_relations": "SELECT p_partkey AS src, unnest([p_partkey + 1, p_partkey + 2]) AS dst, 'child' AS kind FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, unnest([p_partkey + 1, p_partkey + 4]), 'paired_page' FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, p_partkey - 1, 'parent' FROM part WHERE p_partkey % 3 = 2",
    "catalog_relation": f"""WITH e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'related_document' ELSE 'paired_page' END AS relation, unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_partkey + 1, p_partkey + 2] ELSE [p_partkey + 1, p_partkey + 4] END) AS dst FROM part WHERE p_partkey % 3 < 2),
        r AS (SELECT id, relation, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS related FROM e WHERE dst IN (SELECT p_partkey FROM part) GROUP BY id, relation), m AS (SELECT l_orderkey AS doc_id, id AS front, relation, related, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_RANK}) AS k FROM lineitem JOIN r ON l_partkey = id)
        SELECT doc_id, front, relation, related FROM m WHERE k = 1""",
    "field_closure": """WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part), e AS (SELECT k AS name, unnest([k // 2, k // 3, CASE WHEN k = 6 THEN 12 ELSE k END]) AS needs FROM p), c AS (SELECT k AS root, k AS name FROM p UNION SELECT root, needs FROM c JOIN e USING (name) WHERE needs > 0) SELECT root, name FROM c""",
    "field_assembly": f"""WITH r AS ({_READINGS.format(customer='customer')}), x AS (SELECT * FROM r WHERE value <> ''),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY confidence DESC, pos) AS place FROM x WHERE type < 9) WHERE place = 1),
        j AS (SELECT doc_id, max(value) FILTER (type = 1) AS a, max(value) FILTER (type = 2) AS b, max(value) FILTER (type = 3) AS c, round(avg(confidence), 6) AS confidence, string_agg(name, ',' ORDER BY type) AS derived_from, min(pos)::DOUBLE AS "left", max(pos)::DOUBLE + 1 AS "right" FROM b GROUP BY doc_id),
        v AS (SELECT *, trim(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ', ' || b WHEN a IS NOT NULL AND c IS NOT NULL THEN a || ' - ' ELSE coalesce(a, b, '') END || CASE WHEN c IS NULL THEN '' WHEN b IS NOT NULL THEN ' /  - ' || c ELSE c END, ' ,/') AS value FROM j)
        SELECT doc_id, value, confidence, derived_from, "left", "right" FROM v WHERE value <> '' AND doc_id NOT IN (SELECT doc_id FROM x WHERE type = 9)""",
    "layout_recognition": f"""WITH r AS ({_READINGS.format(customer='customer')}), x AS (SELECT * FROM r WHERE value <> '' AND name IN ('part0', 'part1', 'part3', 'part5')),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY confidence DESC, pos) AS place FROM x) WHERE place = 1),
        j AS (SELECT doc_id, max(value) FILTER (type = 1) AS a, max(value) FILTER (type = 2) AS b, max(value) FILTER (type = 3) AS c, round(avg(confidence), 6) AS confidence FROM b GROUP BY doc_id),
        v AS (SELECT *, trim(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || ', ' || b WHEN a IS NOT NULL AND c IS NOT NULL THEN a || ' - ' ELSE coalesce(a, b, '') END || CASE WHEN c IS NULL THEN '' WHEN b IS NOT NULL THEN ' /  - ' || c ELSE c END, ' ,/') AS value FROM j)
        SELECT doc_id, 'full' AS name, value, confidence, 1 AS derived FROM v WHERE value <> '' UNION ALL SELECT doc_id, name, value, round(confidence, 6), 0 FROM x WHERE name = 'part3'""",
    "field_values": """WITH r AS (SELECT l_suppkey AS doc_id, l_returnflag AS name, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS value, l_quantity AS confidence, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS pos FROM lineitem),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY confidence DESC, pos DESC, value DESC) AS k FROM r) SELECT doc_id, name, value, confidence FROM b WHERE k = 1""",
    "read_windows": """WITH p AS (SELECT p_partkey, round(p_partkey % 50 / 100.0, 4)::DOUBLE AS top, round(p_partkey % 50 / 100.0, 4)::DOUBLE + round((p_partkey % 7 + 1) / 20.0, 4)::DOUBLE AS bottom, 0.05::DOUBLE AS text FROM part),
        h AS (SELECT *, least(bottom - top, greatest(text * 1.5, (bottom - top) / 8)) AS height FROM p), e AS (SELECT *, CASE WHEN bottom - top <= height * 1.8 THEN top - text * 0.5 ELSE top END AS a, CASE WHEN bottom - top <= height * 1.8 THEN bottom + text * 0.5 ELSE bottom END AS z FROM h),
        n AS (SELECT *, greatest(3, least(10, round_even((z - a) / greatest(text * 0.55, 0.001), 0)))::INT AS n FROM e), w AS (SELECT *, unnest(range(n)) AS i FROM n), y AS (SELECT *, a + (z - a - height) * i / (n - 1) AS y FROM w)
        SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY abs((y + y + height) / 2 - (top + bottom) / 2), i) - 1)::INT AS place, round(y, 8) AS top, round(y + height, 8) AS bottom FROM y""",
    "page_order": f"""WITH RECURSIVE p AS ({_ORDERED.format(conversations='conversations')}), g AS (SELECT *, (row_number() OVER (PARTITION BY collection_id ORDER BY position) - 1)::INT AS k FROM p),
        e AS (SELECT a.collection_id, CASE WHEN a.ordinal < b.ordinal THEN a.k ELSE b.k END AS f, CASE WHEN a.ordinal < b.ordinal THEN b.k ELSE a.k END AS l FROM g AS a JOIN g AS b ON a.collection_id = b.collection_id AND a.k < b.k AND a.ordinal <> b.ordinal AND (b.identifier IN (a.one, a.two) OR a.identifier IN (b.one, b.two)) WHERE a.identifier IS NOT NULL AND b.identifier IS NOT NULL),
        c AS (SELECT collection_id, list(k ORDER BY k) AS every FROM g GROUP BY 1), x AS (SELECT c.collection_id, every, (SELECT list({{'f': f, 'l': l}}) FROM e WHERE e.collection_id = c.collection_id) AS edges FROM c),
        s AS (SELECT collection_id, every, edges, []::INT[] AS told, every AS remaining FROM x
          UNION ALL SELECT collection_id, every, edges, list_append(told, nxt), list_filter(remaining, lambda q: q <> nxt) FROM (
            SELECT *, list_filter(remaining, lambda q: len(list_filter(coalesce(edges, []), lambda d: d.l = q AND list_contains(remaining, d.f))) = 0)[1] AS nxt FROM s WHERE len(remaining) > 0) WHERE nxt IS NOT NULL),
        d AS (SELECT collection_id, every, edges, arg_max(told, len(told)) AS told FROM s GROUP BY collection_id, every, edges)
        SELECT collection_id, array_to_string(CASE WHEN len(told) = len(every) THEN told ELSE every END, ',') AS indices, CASE WHEN len(told) = len(every) AND told <> every THEN 'reordered' ELSE 'preserved' END AS decision,
          CASE WHEN edges IS NOT NULL AND len(told) = len(every) THEN 'catalog_relation_and_declared_page_ordinal' ELSE 'caller_order' END AS method FROM d""",
}
