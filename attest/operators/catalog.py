"""The document catalog and its classifier's candidates: search, pages, facets, hints.

A catalog has identifier, caption, country, iso_codes array, document_type, document_format, year, series, state_codes array,
deprecated; candidates have doc_id, rank, identifier, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("country", "caption", "year")


def sort_key(*more: str) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")) for c in ORDER] + [F.col("identifier"), *map(F.col, more)]


def search(catalog: DataFrame, query: str | None = None, country: str | None = None, document_type: str | None = None, document_format: str | None = None, deprecated: bool = False) -> DataFrame:
    """Documents that meet all that is asked: a country code, a type and a format whatever the case, a part of their joined texts. Unordered; see page()."""
    out = catalog if deprecated else catalog.where(~F.coalesce("deprecated", F.lit(False)))
    given = lambda x: (x or "").strip()
    if given(country):
        out = out.where(F.array_contains("iso_codes", given(country).upper()))
    for column, value in (("document_type", document_type), ("document_format", document_format)):
        if given(value):
            out = out.where(F.lower(column) == given(value).lower())
    if given(query):
        texts = [F.col("caption"), F.col("country"), F.array_join("iso_codes", " "), F.col("document_type"), F.col("document_format"), F.col("year"), F.col("series"), F.array_join("state_codes", " ")]
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in texts))), F.lit(given(query).lower())))
    return out


def page(found: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of results in catalog order, each row with the total. Offsets from 0, limits from 1 to 100."""
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("offset must be at least 0 and limit within 1 and 100")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(*sort_key()).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def facets(catalog: DataFrame, deprecated: bool = False) -> DataFrame:
    """(facet, value, name, count): documents by country code, type and format in one grouping-sets aggregate. A country is named as in the first of its documents in catalog order."""
    docs = search(catalog, deprecated=deprecated)
    kinds = F.concat(F.transform("iso_codes", lambda c: F.struct(F.lit("country").alias("facet"), c.alias("value"))), F.array(F.struct(F.lit("type").alias("facet"), F.col("document_type").alias("value")), F.struct(F.lit("format").alias("facet"), F.col("document_format").alias("value"))))
    rows = docs.select(F.explode(kinds).alias("f"), "country", F.struct(*sort_key()).alias("k")).where(F.length("f.value") > 0)
    return rows.groupBy("f.facet", "f.value").agg(F.min_by("country", "k").alias("name"), F.count("*").alias("count")).withColumn("name", F.when(F.col("facet") == "country", F.col("name")))


def with_documents(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidates with their documents; candidates that the catalog does not know stay, without one."""
    return candidates.join(catalog, "identifier", "left")


def layout_hint(candidates: DataFrame, least: float = 0.45) -> DataFrame:
    """doc_id, hint: the implemented layout whose candidates have the greatest confidence together, if that is enough; of equal ones the first met."""
    hint = F.when(F.array_contains("iso_codes", "MEX") & (F.col("document_type") == "VotingCard"), "mex_ine").when(F.array_contains("iso_codes", "SWE") & (F.col("document_type") == "IdentityCard") & F.contains(F.col("caption"), F.lit("2021")), "swe_id_2021")
    sums = candidates.withColumn("hint", hint).where(F.col("hint").isNotNull()).groupBy("doc_id", "hint").agg(F.sum("confidence").alias("c"), F.min("rank").alias("r"))
    best = sums.groupBy("doc_id").agg(F.max_by(F.struct("hint", "c"), F.struct("c", -F.col("r"))).alias("b"))
    return best.where(F.col("b.c") >= least).select("doc_id", "b.hint")


def unambiguous(candidates: DataFrame, least: float = 0.65, margin: float = 0.15) -> DataFrame:
    """The first candidate with a document, where it is sure enough and far enough above the second with a document."""
    known = candidates.where(F.col("caption").isNotNull())
    w = Window.partitionBy("doc_id").orderBy("rank")
    ranked = known.withColumns({"place": F.row_number().over(w), "second": F.coalesce(F.lead("confidence").over(w), F.lit(0.0))})
    return ranked.where((F.col("place") == 1) & (F.col("confidence") >= least) & (F.col("confidence") - F.col("second") >= margin)).drop("place", "second")


def voter_card(candidates: DataFrame, least: float = 0.2) -> DataFrame:
    """The surest candidate for a Mexican voting card, if it is sure enough."""
    own = candidates.where(F.array_contains("iso_codes", "MEX") & (F.col("document_type") == "VotingCard"))
    return own.groupBy("doc_id").agg(F.max_by(F.struct("identifier", "confidence"), F.struct("confidence", -F.col("rank"))).alias("b")).where(F.col("b.confidence") >= least).select("doc_id", "b.*")


def orientation(scores: DataFrame) -> DataFrame:
    """doc_id, degrees: of four rotations with their voting-card confidences, the greatest sum; the smaller rotation of equal ones."""
    sums = scores.groupBy("doc_id", "degrees").agg(F.sum("confidence").alias("s"))
    return sums.groupBy("doc_id").agg(F.max_by("degrees", F.struct("s", -F.col("degrees"))).alias("degrees"))


PASSPORT_LIKE = ("TravelDocument", "RefugeeTravelDocument", "LaissezPasser", "AliensPassport")


def mrz_hint(document_type: Column, document_format: Column, caption: Column, present: Column, ignored: Column, expected: Column) -> Column:
    """Which machine-readable zone a document should have: td1, td2, td3, mrv or null.

    An ignored zone is none; an expected profile says it outright; visas and passports are told by type and format even where no
    zone is noted; else the format tells, if a zone is noted.
    """
    kind = F.coalesce(document_type, F.lit(""))
    passport = (document_format == "ID3") & (F.contains(kind, F.lit("Passport")) | kind.isin(*PASSPORT_LIKE)) & ~kind.isin("PassportPage", "DomesticPassport", "VehiclePassport") & ~F.contains(F.coalesce(caption, F.lit("")), F.lit("not MRZ"))
    noted = F.coalesce(present, F.lit(False))
    by_format = F.when(document_format == "ID1", "td1").when(document_format == "ID2", "td2").when(document_format == "ID3", F.when(F.contains(kind, F.lit("Visa")), "mrv").otherwise("td3"))
    return F.when(F.coalesce(ignored, F.lit(False)), None).when(expected.isin("td1", "td2", "td3", "mrv"), expected).when((kind == "Visa") & document_format.isin("ID2", "ID3"), "mrv").when(passport, "td3").when(noted, by_format)


def confirms(issuer: Column, country: Column, name: Column, confidence: Column, iso_codes: Column, document_type: Column, document_format: Column) -> Column:
    """Whether the first candidate agrees in structure with what was recognised."""
    kind = F.coalesce(document_type, F.lit(""))
    issued = F.coalesce(F.nullif(issuer, F.lit("")).isNull() | F.array_contains(iso_codes, issuer), F.lit(False))
    alike = (
        ((country == "Mexico") & (name == "Voter Credential") & F.array_contains(iso_codes, "MEX") & (kind == "VotingCard"))
        | ((country == "Sweden") & F.contains(name, F.lit("Id Card")) & F.array_contains(iso_codes, "SWE") & (kind == "IdentityCard"))
        | ((name == "Passport") & (document_format == "ID3") & (F.contains(kind, F.lit("Passport")) | kind.isin(*PASSPORT_LIKE[:3])))
        | ((name == "Visa") & (kind == "Visa") & document_format.isin("ID2", "ID3"))
        | ((name == "Identity Card") & (document_format == "ID1"))
        | ((name == "Identity Document") & (document_format == "ID2"))
    )
    return (confidence >= 0.2) & issued & F.coalesce(alike, F.lit(False))


def effective_identifier(requested: DataFrame, candidates: DataFrame, least: float = 0.65) -> DataFrame:
    """doc_id, identifier: what was asked for, else the first candidate with a document that is sure enough, else null. requested: doc_id, requested."""
    first = candidates.where(F.col("caption").isNotNull() & (F.col("confidence") >= least)).groupBy("doc_id").agg(F.min_by("identifier", "rank").alias("told"))
    return requested.join(first, "doc_id", "left").select("doc_id", F.coalesce("requested", "told").alias("identifier"))
