"""Evidence of several sides and pages of a document: compatibility checks, fusion, page order, the fold over pages.

Two sides are joined on their pair. A page that matches overlays some fields of what has been gathered, but never those that pages are
compared by: each page is therefore held against the first one, and the fold is an aggregate over a collection's pages in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType

from ..functions.barcodes import verification_url
from ..functions.policy import capture_decision
from ..functions.text import compatible, compatible_keys, date_key, icao_variants, variants
from ..sources.tables import written
from .layouts import barcode_regions
from .readings import guided_regions
from .recursion import recursive

MOST_PAGES = 10
#: Compared fields with their kinds, and the fields that a matching back or page gives to the whole (fixed values).
COMPARED = {"country": "text", "name": "text", "surname": "text", "date_of_birth": "date", "sex": "text"}
OVERLAID = ("document_number", "document_class", "issuing_state", "nationality", "nationality_code", "date_of_expiry", "personal_number", "optional_data", "mrz_code", "mrz_strings", "checks", "machine_barcodes", "ine_qr")
RECOGNISED = 0.65


def full_name(side: str, have: list[str]) -> Column:
    """The first of: the name, the joint name, surname and given names; empty ones count as missing. side: a struct column with the fields `have`."""
    some = lambda c: F.nullif(F.col(f"{side}.{c}"), F.lit("")) if c in have else F.lit(None).cast("string")
    return F.coalesce(some("name"), some("surname_and_given_names"), F.nullif(F.concat_ws(" ", some("surname"), some("given_names")), F.lit("")))


def check(a: Column, b: Column, kind: str, key=None) -> Column:
    """True, false, or null where one side has nothing to compare. key makes a text comparable: a key, or an array of variants."""
    if kind == "date":
        return F.when((F.coalesce(F.length(a), F.lit(0)) > 0) & (F.coalesce(F.length(b), F.lit(0)) > 0), date_key(a) == date_key(b))
    if key in (variants, icao_variants):
        return compatible(key(a), key(b))
    return compatible_keys(key(a), key(b)) if key else compatible_keys(a, b)


def filled(value: Column, kind: DataType) -> Column:
    """Whether a value counts as there: not null, and not an empty text, list or map."""
    if isinstance(kind, StringType):
        return F.coalesce(F.length(value) > 0, F.lit(False))
    return F.coalesce(F.size(value) > 0, F.lit(False)) if isinstance(kind, (ArrayType, MapType)) else value.isNotNull()


def decision(checks: list[Column]) -> Column:
    """mismatch if one check is false, matched if at least two are true, else review."""
    false = F.greatest(*(F.coalesce(~c, F.lit(False)) for c in checks))
    true = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0))
    return F.when(false, "mismatch").when(true >= 2, "matched").otherwise("review")


def side_summary(side: str, have: list[str]) -> Column:
    """What a pairing tells of a side: whether it was recognised, as what, and its first known candidate if that is sure enough.

    candidates: array of structs (identifier, name, confidence), name null for those that the catalog does not know.
    """
    field = lambda c, kind="string": F.col(f"{side}.{c}") if c in have else F.lit(None).cast(kind)
    none = "array<struct<identifier:long,name:string,confidence:double>>"
    first = F.get(F.filter(field("candidates", none), lambda c: c["name"].isNotNull()), F.lit(0))
    sure = F.when(F.coalesce(first["confidence"], F.lit(0.0)) >= RECOGNISED, first)
    recognised = ~field("profile").eqNullSafe(F.lit("UNSUPPORTED"))
    return F.struct(F.lit(side).alias("side"), recognised.alias("recognized"), field("profile").alias("profile"), field("requested", "long").alias("layout_identifier"), field("source").alias("source"), sure.alias("classification"))


def fused(pairs: DataFrame, key=None, compared: dict[str, str] = COMPARED, overlaid: tuple[str, ...] = OVERLAID) -> DataFrame:
    """Pairs with columns front and back as structs: result is the front, overlaid by the back's filled fields where the sides match; checks
    and decision tell whether they do, sides what each is. Where they match, status is the greater of both, sources their union in order, and
    source, profile and profile_status say that the document is a pair; machine_profile is the back's where it has a zone. key: what makes
    texts comparable, text.variants for all spellings."""
    kinds = {f.name: f.dataType for f in pairs.schema["front"].dataType}
    have, of_back = list(kinds), pairs.schema["back"].dataType.names
    front, back = (lambda c: F.col(f"front.{c}")), (lambda c: F.col(f"back.{c}") if c in of_back else F.lit(None).cast(kinds[c]))
    one, two = {c: front(c) for c in compared if c in have}, {c: back(c) for c in compared if c in have}
    if "name" in compared:
        one["name"], two["name"] = full_name("front", have), full_name("back", of_back)
    checks = {c: check(one[c], two[c], kind, key) for c, kind in compared.items() if c in one}
    out = pairs.withColumns({f"check_{c}": v for c, v in checks.items()})
    out = out.withColumn("decision", decision([F.col(f"check_{c}") for c in checks]))
    matched = F.col("decision") == "matched"
    fields = {c: F.when(matched & filled(back(c), kinds[c]), back(c)).otherwise(front(c)) if c in overlaid else front(c) for c in have if c != "capture"}
    if "status" in have:
        fields["status"] = F.when(matched, F.greatest(F.coalesce(front("status"), F.lit(-1)), F.coalesce(back("status"), F.lit(-1)))).otherwise(front("status"))
    if "sources" in have:
        none = F.array().cast("array<string>")
        fields["sources"] = F.when(matched, F.array_distinct(F.concat(F.coalesce(front("sources"), none), F.coalesce(back("sources"), none)))).otherwise(front("sources"))
    for c, told in (("source", "MULTI_SOURCE"), ("profile", "PAIRED-DOCUMENT"), ("profile_status", "front_back_identity_checks_passed")):
        if c in have:
            fields[c] = F.when(matched, told).otherwise(front(c))
    if "machine_profile" in have and {"mrz_code", "profile"} <= set(of_back):
        fields["machine_profile"] = F.when(matched & (F.length(back("mrz_code")) > 0), back("profile")).otherwise(front("machine_profile"))
    if "capture" in have:
        fields["capture"] = capture_decision(F.array(front("capture"), back("capture")))
    sides = F.array(side_summary("front", have), side_summary("back", of_back))
    return out.select(*(c for c in out.columns if c not in ("front", "back")), sides.alias("sides"), F.struct(*(v.alias(c) for c, v in fields.items())).alias("result"))


def paired(fronts: DataFrame, backs: DataFrame, layouts: DataFrame, guided: DataFrame | None = None, key=None) -> DataFrame:
    """Sides of documents, joined on doc_id and fused; with the catalog's relation of the front.

    fronts, backs: doc_id and a struct (front, back). guided: doc_id and barcodes, read in the regions of the related layouts: they join the
    back's machine_barcodes (structs with format and text; one of each, the later reading), unless the back has a QR payload (ine_qr).
    """
    both = fronts.join(backs, "doc_id")
    if guided is not None and "machine_barcodes" in backs.schema["back"].dataType.names:
        both = both.join(guided.select("doc_id", F.col("barcodes").alias("_guided")), "doc_id", "left")
        none = F.array().cast(backs.schema["back"].dataType["machine_barcodes"].dataType)
        every = F.concat(F.coalesce("back.machine_barcodes", none), F.coalesce("_guided", none))
        same = lambda x, y: (x["format"] == y["format"]) & (x["text"] == y["text"])
        places = F.filter(F.transform(every, lambda x, i: F.when(~F.exists(F.slice(every, F.lit(1), i), lambda y: same(x, y)), F.element_at(F.filter(every, lambda y: same(x, y)), -1))), lambda x: x.isNotNull())
        has_qr = F.col("back.ine_qr").isNotNull() if "ine_qr" in backs.schema["back"].dataType.names else F.lit(False)
        both = both.withColumn("related_barcodes", F.when(has_qr, 0).otherwise(F.size(F.coalesce("_guided", none)))).withColumn("back", F.col("back").withField("machine_barcodes", F.when(has_qr, F.col("back.machine_barcodes")).otherwise(places))).drop("_guided")
    told = fused(both, key)
    candidates = fronts.select("doc_id", F.posexplode("front.candidates").alias("rank", "c")).select("doc_id", "rank", F.col("c.identifier").alias("identifier")) if "candidates" in fronts.schema["front"].dataType.names else None
    if candidates is None:
        return told
    return told.join(catalog_relation(candidates, layouts), "doc_id", "left")


def guided_pairs(fronts: DataFrame, backs: DataFrame, layouts: DataFrame, decode, key=None) -> DataFrame:
    """paired(), with symbols of the back sought where the layouts that the front's catalog relation names have barcodes; regions counts where it was looked.

    What is looked at depends on what the front was taken for: its relation is joined to the layouts' barcode regions, for backs that have no QR
    payload yet. decode: a function of (doc_id, identifier, bounds and a region's other columns) to (doc_id, format, text), run once. What it finds joins the
    back's symbols, and a verification URL among it is the back's ine_qr, the least of several.
    """
    if "candidates" not in fronts.schema["front"].dataType.names:
        raise ValueError("fronts need candidates: their relation says where to look")
    candidates = fronts.select("doc_id", F.posexplode("front.candidates").alias("rank", "c")).select("doc_id", "rank", F.col("c.identifier").alias("identifier"))
    told = "ine_qr" in backs.schema["back"].dataType.names
    unread = backs.where(F.col("back.ine_qr").isNull()) if told else backs
    regions = guided_regions(catalog_relation(candidates, layouts).join(unread.select("doc_id"), "doc_id", "left_semi"), barcode_regions(layouts))
    found = written(decode(regions).select("doc_id", "format", "text"), "guided")
    url = F.when(F.col("format") == "QRCode", F.when(verification_url(F.col("text")).isNotNull(), F.col("text")))
    symbols = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("format", "text"))).alias("barcodes"), F.min(url).alias("_qr"))
    out = paired(fronts, backs, layouts, symbols, key).join(regions.groupBy("doc_id").agg(F.count("*").alias("_n")), "doc_id", "left")
    if told:
        out = out.join(symbols.select("doc_id", "_qr"), "doc_id", "left")
        out = out.withColumn("result", F.col("result").withField("ine_qr", F.when(F.col("decision") == "matched", F.coalesce("_qr", "result.ine_qr")).otherwise(F.col("result.ine_qr")))).drop("_qr")
    return out.withColumn("regions", F.coalesce("_n", F.lit(0))).drop("_n")


def catalog_relation(candidates: DataFrame, layouts: DataFrame) -> DataFrame:
    """doc_id, front, relation, related: the first candidate whose layout has paired pages, or else children, that the catalog knows."""
    known = layouts.select(F.col("identifier").alias("dst"), F.col("caption").alias("related_name"))
    kind = F.when(F.size("paired_pages") > 0, "paired_page").when(F.size("child_documents") > 0, "related_document")
    edges = layouts.select("identifier", kind.alias("relation"), F.posexplode(F.when(kind == "paired_page", F.col("paired_pages")).otherwise(F.col("child_documents"))).alias("place", "dst")).join(known, "dst")
    related = edges.groupBy("identifier", "relation").agg(F.array_sort(F.collect_list(F.struct("place", F.col("dst").alias("identifier"), F.col("related_name").alias("name")))).alias("related"))
    met = candidates.join(related, "identifier")
    best = met.groupBy("doc_id").agg(F.min_by(F.struct(F.col("identifier").alias("front"), "relation", "related"), "rank").alias("b"))
    return best.select("doc_id", "b.*")


def page_order(pages: DataFrame) -> DataFrame:
    """collection_id, indices, decision, method: pages in the order that their layouts state.

    pages: collection_id, position, identifier, ordinal, related array. Two related pages with different ordinals stand in their
    order; of the pages that may come next the earliest given does; a cycle leaves the given order.

    Related pages meet by a join on the layout that one of them names. The order is a recursion: a row holds how many pages each page of
    its collection still waits for, and a step takes the first that waits for none; a collection is done when no page is left, or, on a cycle, when all wait.
    """
    numbered = pages.select("collection_id", "identifier", "ordinal", "related", (F.row_number().over(Window.partitionBy("collection_id").orderBy("position")) - 1).alias("k"))
    told = numbered.where(F.col("identifier").isNotNull() & F.col("ordinal").isNotNull())
    one = told.select("collection_id", "k", "ordinal", F.explode(F.array_distinct("related")).alias("identifier"))
    two = told.select("collection_id", "identifier", F.col("k").alias("k2"), F.col("ordinal").alias("ordinal2"))
    met = one.join(two, ["collection_id", "identifier"]).where(F.col("ordinal") != F.col("ordinal2"))
    forward = F.col("ordinal") < F.col("ordinal2")
    edges = met.select("collection_id", F.when(forward, F.col("k")).otherwise(F.col("k2")).alias("first"), F.when(forward, F.col("k2")).otherwise(F.col("k")).alias("last")).distinct()
    after = edges.groupBy("collection_id", F.col("first").alias("k")).agg(F.collect_list("last").alias("after"))
    waits = edges.groupBy("collection_id", F.col("last").alias("k")).agg(F.count("*").cast("int").alias("open"))
    rows = numbered.select("collection_id", "k").join(waits, ["collection_id", "k"], "left").join(after, ["collection_id", "k"], "left")
    each = F.array_sort(F.collect_list(F.struct("k", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("after", F.array().cast("array<int>")).alias("after"))))
    start = rows.groupBy("collection_id").agg(each.alias("p")).select("collection_id", F.col("p.open").alias("open"), F.col("p.after").alias("after"))
    return recursive(
        pages.sparkSession,
        "SELECT collection_id, 0 AS step, -1 AS page, open, after FROM {begun}",
        """SELECT collection_id, step + 1, next, transform(open, (n, i) -> CASE WHEN i = next THEN -1 WHEN array_contains(after[next], i) THEN n - 1 ELSE n END), after
           FROM (SELECT *, CAST(array_position(open, 0) AS INT) - 1 AS next FROM walk) WHERE next >= 0""",
        """, whole AS (
             SELECT collection_id, transform(filter(array_sort(collect_list(struct(step, page))), x -> x.step > 0), x -> x.page) AS told,
                    max_by(size(open), step) AS n, max_by(exists(after, x -> size(x) > 0), step) AS ruled FROM walk GROUP BY collection_id),
           settled AS (SELECT collection_id, size(told) = n AS done, ruled, sequence(0, n - 1) AS given, told FROM whole)
           SELECT collection_id, if(done, told, given) AS indices, if(done AND told <> given, 'reordered', 'preserved') AS decision,
                  if(done AND ruled, 'catalog_relation_and_declared_page_ordinal', 'caller_order') AS method FROM settled""",
        begun=start,
    )


def folded_pages(pages: DataFrame, compared: dict[str, str] = COMPARED, overlaid: tuple[str, ...] = OVERLAID) -> DataFrame:
    """collection_id, error, decision, page_decisions, matched_pages, and the fields of what was gathered, a row for each collection.

    pages: collection_id, position, comparable keys of the compared fields (strings by text.ascii_key, nfkc_key or date_key, or arrays of
    text.variants), and any of the overlaid fields, status, sources and capture. The first page starts. Each next one is checked against what has been
    gathered, whose compared fields stay those of the first page; where it matches, its filled overlaid fields replace what was there. The
    whole is a mismatch if one page is, matched if all are, else for review. capture is told from all pages. A collection of fewer than two
    or more than MOST_PAGES pages is an error, and nothing else is told of it.
    """
    kinds = {f.name: f.dataType for f in pages.schema}
    gathered = [c for c in (*compared, *overlaid, "status", "sources", "capture") if c in kinds]
    counts = pages.groupBy("collection_id").agg(F.count("*").alias("_n"))
    some = pages.select("collection_id", F.struct("position", *gathered).alias("_p")).join(counts.where(F.col("_n").between(2, MOST_PAGES)).select("collection_id"), "collection_id", "left_semi")
    rows = some.groupBy("collection_id").agg(F.sort_array(F.collect_list("_p")).alias("_pages"))
    first_of = {c: f"_first_{c}" for c in gathered}
    rows = rows.select("collection_id", F.expr("slice(_pages, 2, size(_pages))").alias("_rest"), "_pages", *(F.col("_pages")[0][c].alias(x) for c, x in first_of.items()))

    def against_first(page: Column) -> Column:
        results = []
        for c, kind in compared.items():
            if c in kinds:
                a, b = F.col(first_of[c]), page[c]
                if isinstance(kinds[c], ArrayType):
                    results.append(compatible(a, b))
                elif kind == "date":
                    results.append(F.when((F.length(a) > 0) & (F.length(b) > 0), a == b))
                else:
                    results.append(compatible_keys(a, b))
        return decision(results)

    told = rows.select("collection_id", *first_of.values(), "_rest", "_pages", F.explode(F.array(F.transform("_rest", against_first))).alias("page_decisions"))
    matched = F.filter("_rest", lambda p, i: F.get("page_decisions", i) == "matched")
    told = told.select("collection_id", *first_of.values(), "_pages", "page_decisions", F.explode(F.array(matched)).alias("_matched"))
    all_matched = F.forall("page_decisions", lambda d: d == "matched")
    whole = F.when(F.array_contains("page_decisions", "mismatch"), "mismatch").when(all_matched, "matched").otherwise("review")
    fields = []
    for c in gathered:
        first, own = F.col(first_of[c]), F.transform("_matched", lambda p: p[c])  # noqa: B023
        if c in overlaid:
            fields.append(F.coalesce(F.try_element_at(F.filter(own, lambda v: filled(v, kinds[c])), F.lit(-1)), first).alias(c))  # noqa: B023
        elif c == "status":
            none = F.lit(-1).cast(kinds[c])
            fields.append(F.when(F.size("_matched") > 0, F.array_max(F.concat(F.array(F.coalesce(first, none)), F.transform(own, lambda v: F.coalesce(v, none))))).otherwise(first).alias(c))
        elif c == "sources":
            none = F.array().cast(kinds[c])
            fields.append(F.array_distinct(F.flatten(F.concat(F.array(F.coalesce(first, none)), F.transform(own, lambda v: F.coalesce(v, none))))).alias(c))
        elif c == "capture":
            fields.append(capture_decision(F.transform("_pages", lambda p: p["capture"])).alias(c))
        else:
            fields.append(first.alias(c))
    told = told.select("collection_id", whole.alias("decision"), "page_decisions", (F.size("_matched") + 1).alias("matched_pages"), *fields)
    return counts.select("collection_id", F.when(~F.col("_n").between(2, MOST_PAGES), "page_count").alias("error")).join(told, "collection_id", "left")


def first_and_last(rows: DataFrame, group: list[str], key: list[str], seq: str, value: list[str]) -> DataFrame:
    """Of rows with equal keys: the place of the first, the values of the last."""
    out = rows.groupBy(*group, *key).agg(F.min(seq).alias(seq), F.max_by(F.struct(*value), seq).alias("_v"))
    return out.select(*group, *key, seq, "_v.*")


def keep_first(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Of rows with equal keys the first."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("_r")).select(*key, "_r.*")
