"""Cards of known templates: where their fields lie, which template a card is of, and the record that its readings make.

A template is a table of boxes. Readings of all templates' fields are rows (doc_id, template, name, text, confidence); a card's fields are
brought together by one aggregate, and cleaned as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.national import address_line, compact, swedish_date, voter_card_accepted

#: The boxes (left, top, right, bottom, parts of the card) of the fields of each template.
TEMPLATES = {
    "INE-front-legacy": {
        "surname1": (0.318, 0.295, 0.637, 0.338), "surname2": (0.318, 0.338, 0.637, 0.381), "givenNames": (0.318, 0.385, 0.728, 0.432), "dateOfBirth": (0.773, 0.295, 0.937, 0.345),
        "address1": (0.310, 0.480, 0.650, 0.525), "address2": (0.310, 0.535, 0.680, 0.580), "address3": (0.310, 0.590, 0.570, 0.635), "electorKey": (0.485, 0.645, 0.765, 0.700),
        "curp": (0.355, 0.700, 0.660, 0.750), "registrationYear": (0.835, 0.700, 0.960, 0.750), "state": (0.390, 0.775, 0.455, 0.825), "municipality": (0.600, 0.775, 0.680, 0.825),
        "section": (0.755, 0.775, 0.850, 0.825), "locality": (0.415, 0.830, 0.500, 0.885), "issueYear": (0.600, 0.830, 0.690, 0.885), "validity": (0.750, 0.830, 0.850, 0.885),
    },
    "INE-front-modern": {
        "surname1": (0.3125, 0.332, 0.625, 0.382), "surname2": (0.3125, 0.377, 0.625, 0.427), "givenNames": (0.3125, 0.422, 0.688, 0.472), "address1": (0.315, 0.570, 0.745, 0.620),
        "address2": (0.305, 0.615, 0.620, 0.660), "address3": (0.315, 0.660, 0.625, 0.700), "electorKey": (0.516, 0.729, 0.828, 0.779), "curp": (0.3125, 0.818, 0.688, 0.868),
        "dateOfBirth": (0.305, 0.910, 0.445, 0.965), "registrationYear": (0.688, 0.818, 0.850, 0.868), "section": (0.5625, 0.913, 0.675, 0.963), "validity": (0.688, 0.913, 0.850, 0.963), "sex": (0.894, 0.298, 0.956, 0.348),
    },
    "SWE-ID-2021-front": {
        "surname": (0.0417, 0.1518, 0.2917, 0.2147), "givenNames": (0.0417, 0.2251, 0.2500, 0.2906), "sex": (0.2833, 0.3246, 0.3917, 0.3848), "nationality": (0.4083, 0.3246, 0.6417, 0.3848),
        "dateOfBirth": (0.2833, 0.4084, 0.5500, 0.4738), "personalNumber": (0.2833, 0.4895, 0.5750, 0.5576), "documentNumber": (0.0417, 0.5812, 0.2583, 0.6492), "height": (0.2833, 0.5812, 0.4500, 0.6492),
        "dateOfIssue": (0.0417, 0.6806, 0.3417, 0.7513), "dateOfExpiry": (0.0417, 0.7618, 0.3417, 0.8325), "authority": (0.0333, 0.8534, 0.3667, 0.9058), "documentStatus": (0.3250, 0.1257, 0.5833, 0.2042),
    },
}
VOTER, SWEDISH = ("INE-front-legacy", "INE-front-modern"), "SWE-ID-2021-front"
#: Fields whose confidence tells a voter card's template; the authority of a Swedish card, what its sex is written as, and the points from which it counts as one.
KEY_FIELDS = ("surname1", "surname2", "givenNames", "electorKey", "curp")
POLICE, SEXES, ENOUGH = "POLISMYNDIGHETEN", {"K/F": "F", "F": "F", "M/M": "M", "M": "M"}, 5


def field_specs(documents: DataFrame, templates: tuple[str, ...] = VOTER) -> DataFrame:
    """doc_id, template, name, box: every field of some templates, to be read of each document."""
    boxes = [F.struct(F.lit(t).alias("template"), F.lit(name).alias("name"), F.array(*map(F.lit, box)).alias("box")) for t in templates for name, box in TEMPLATES[t].items()]
    return documents.select("doc_id", F.inline(F.array(*boxes)))


def gathered(readings: DataFrame) -> DataFrame:
    """doc_id, template, score (the confidences of KEY_FIELDS that were read), values, confidences (maps by name); of several readings of a field the surest, then the greater text. Spaces and fillers around a text go."""
    text = F.coalesce(F.regexp_replace("text", "^[ <]+|[ <]+$", ""), F.lit(""))
    one = readings.groupBy("doc_id", "template", "name").agg(F.max(F.struct("confidence", text.alias("text"))).alias("r"))
    own = F.when(F.col("name").isin(*KEY_FIELDS) & (F.col("r.text") != ""), F.coalesce("r.confidence", F.lit(0.0))).otherwise(0.0)
    pairs = lambda field: F.map_from_entries(F.collect_list(F.struct("name", f"r.{field}")))
    total = F.aggregate(F.array_sort(F.collect_list(own)), F.lit(0.0), lambda s, x: s + x)  # in one order, whatever that of the rows
    return one.groupBy("doc_id", "template").agg(total.alias("score"), pairs("text").alias("values"), pairs("confidence").alias("confidences"))


def titled(value: Column) -> Column:
    """Letters after anything but a letter in capitals, the others small; single spaces."""
    chars = F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(F.coalesce(F.get(chars, i - 1).rlike(r"\p{L}"), F.lit(False)), F.lower(c)).otherwise(F.upper(c))), "")


def _joined(parts: list[Column], by: str) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), by)


def voter_fronts(readings: DataFrame) -> DataFrame:
    """One row for each document: the template whose KEY_FIELDS were read surest (the first of equal ones), the card's record and whether it counts as a voter card.

    Keys are compacted; the sex of a whole CURP goes before the one read; a birth date of eight digits gets its slashes; the address lines are
    written as the template's cards write them. Fields that a template does not have, or that were not read, are empty.
    """
    order = F.array_position(F.array(*map(F.lit, VOTER)), F.col("template"))
    rows = gathered(readings.where(F.col("template").isin(*VOTER)))
    best = rows.groupBy("doc_id").agg(F.max_by(F.struct("template", "score", "values", "confidences"), F.struct(F.round("score", 9), -order)).alias("b")).select("doc_id", "b.*")
    get = lambda k: F.coalesce(F.try_element_at("values", F.lit(k)), F.lit(""))
    legacy = F.col("template") == VOTER[0]
    single = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    first_year = F.get(F.split(single(get("registrationYear")), " "), F.lit(0))
    digits = F.regexp_replace(get("dateOfBirth"), "[^0-9]", "")
    curp = compact(get("curp"))
    told = best.select(
        "doc_id", "template", "score", get("surname1").alias("first_surname"), get("surname2").alias("second_surname"), _joined([get("surname1"), get("surname2")], " ").alias("surname"), get("givenNames").alias("given_names"),
        F.when(F.length(digits) == 8, F.concat_ws("/", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 4))).otherwise(get("dateOfBirth")).alias("date_of_birth"),
        F.when(legacy, address_line(titled(get("address1")))).otherwise(F.upper(single(get("address1")))).alias("address1"),
        F.when(legacy, address_line(titled(get("address2")))).otherwise(titled(get("address2"))).alias("address2"),
        F.when(legacy, address_line(titled(get("address3")))).otherwise(F.replace(titled(get("address3")), F.lit(" De "), F.lit(" de "))).alias("address3"),
        compact(get("electorKey")).alias("elector_key"), curp.alias("curp"), F.when((F.length(curp) == 18) & F.substring(curp, 11, 1).isin("H", "M"), F.substring(curp, 11, 1)).otherwise(get("sex")).alias("sex"),
        F.when(first_year.rlike("^[0-9]{4}$"), first_year).otherwise(get("registrationYear")).alias("registration_year"), *(get(k).alias(n) for k, n in (("state", "state"), ("municipality", "municipality"), ("section", "section"), ("locality", "locality"), ("issueYear", "issue_year"), ("validity", "validity"))), "confidences",
    )
    told = told.withColumns({"name": _joined([F.col("surname"), F.col("given_names")], " "), "address": _joined([F.col(f"address{k}") for k in (1, 2, 3)], ", ")})
    return told.withColumn("accepted", F.coalesce(voter_card_accepted(F.col("curp"), F.col("elector_key"), F.col("registration_year"), F.col("section"), F.col("validity"), F.col("date_of_birth")), F.lit(False)))


def swedish_cards(readings: DataFrame, year: int) -> DataFrame:
    """One row for each document with readings of the Swedish template: its record, points, and whether it counts as such a card (from ENOUGH points on).

    Two points for the nationality, two for the authority, one each for a sex, a document number of eight digits and a personal number of digits. Dates as
    the card writes them become ISO dates (year: see national.swedish_date).
    """
    rows = gathered(readings.where(F.col("template") == SWEDISH))
    get = lambda k: F.coalesce(F.try_element_at("values", F.lit(k)), F.lit(""))
    code = F.trim(F.element_at(F.split(get("nationality"), "/"), -1))
    sex = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SEXES.items() for x in pair)), get("sex")), F.lit(""))
    number = F.replace(get("personalNumber"), F.lit("-"), F.lit(""))
    points = 2 * (code == "SWE").cast("int") + 2 * F.contains(get("authority"), F.lit(POLICE)).cast("int") + (sex != "").cast("int") + get("documentNumber").rlike("^[0-9]{8}$").cast("int") + number.rlike("^[0-9]+$").cast("int")
    told = rows.select(
        "doc_id", get("surname").alias("surname"), get("givenNames").alias("given_names"), *(swedish_date(get(k), year).alias(n) for k, n in (("dateOfBirth", "date_of_birth"), ("dateOfIssue", "date_of_issue"), ("dateOfExpiry", "date_of_expiry"))),
        get("documentNumber").alias("document_number"), number.alias("personal_number"), sex.alias("sex"), F.lower(get("height")).alias("height"), get("authority").alias("authority"), get("documentStatus").alias("document_status"),
        F.when(code == "SWE", "Sweden").otherwise(get("nationality")).alias("nationality"), code.alias("nationality_code"), F.when(get("documentStatus") == "SPECIMEN", 0).otherwise(-1).alias("validity_status"), points.alias("points"), "confidences",
    )
    return told.withColumns({"name": _joined([F.col("surname"), F.col("given_names")], " "), "accepted": F.col("points") >= ENOUGH})
