"""Rules of single countries: personal numbers, visual dates, names and acceptance of cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mrz import belarus_number  # noqa: F401  (belongs to this family, used by the parser)

CURP_ALPHABET = "0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ"
CURP_PATTERN = "^[A-Z][AEIOUX][A-Z]{2}[0-9]{6}[HM][A-Z]{5}[A-Z0-9][0-9]$"
#: Names of issuers, the authority that a code stands for, and the keys of visual fields.
COUNTRY_NAMES = {"BLR": "Belarus", "MEX": "Mexico", "SWE": "Sweden"}
BLR_AUTHORITIES = {"709": "УВД АДМИНИСТРАЦИИ ФРУНЗЕНСКОГО РАЙОНА Г.МИНСКА"}
VISUAL_KEYS = {"surname1": "firstSurname", "surname2": "secondSurname", "address1": "addressLine1", "address2": "addressLine2", "address3": "addressLine3"}
SAME_KEYS = ("givenNames", "dateOfBirth", "electorKey", "curp", "sex", "registrationYear", "state", "municipality", "section", "locality", "issueYear", "validity")
#: Where the two Mexican passport profiles have their nationality, by which they are told apart.
MEX_NATIONALITY = ((0.294, 0.402, 0.500, 0.446), (0.294, 0.375, 0.520, 0.425))
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def compact(value: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]", "")


def mexican_number(value: Column) -> Column:
    """Positional repair of an 18-character CURP read from an image; other lengths come back compacted."""
    x = compact(value)
    letters, digits = lambda c: F.translate(c, "0158", "OISB"), lambda c: F.translate(c, "OQILS", "00115")
    part = lambda a, n: F.substring(x, a, n)
    return F.when(F.length(x) == 18, F.concat(letters(part(1, 4)), digits(part(5, 6)), letters(part(11, 1)), letters(part(12, 5)), part(17, 2))).otherwise(x)


def curp_valid(value: Column) -> Column:
    """Pattern and check digit: (10 - sum of place-in-alphabet times 18..2 mod 10) mod 10. Null is not valid."""
    x = F.upper(F.coalesce(value, F.lit("")))
    total = F.aggregate(F.transform(F.split(F.substring(x, 1, 17), ""), lambda c, i: (F.instr(F.lit(CURP_ALPHABET), c) - 1) * (F.lit(18) - i)), F.lit(0), lambda s, v: s + v)
    return F.when(x.rlike(CURP_PATTERN), (10 - total % 10) % 10 == F.substring(x, 18, 1).try_cast("int")).otherwise(F.lit(False))


def corroborated_birth(visual: Column, curp: Column, voter_key: Column) -> Column:
    """DD/MM/YYYY if the CURP and the elector key agree on YYMMDD and the visual date differs from it in at most one character;
    the century is that of the visual date. Null otherwise."""
    digits = F.regexp_replace(F.coalesce(visual, F.lit("")), "[^0-9]", "")
    a, b = F.substring(curp, 5, 6), F.substring(voter_key, 7, 6)
    seen = F.concat(F.substring(digits, 7, 2), F.substring(digits, 3, 2), F.substring(digits, 1, 2))
    apart = F.aggregate(F.zip_with(F.split(a, ""), F.split(seen, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, v: s + v)
    told = F.try_to_date(F.concat(F.substring(digits, 5, 2), a), "yyyyMMdd")
    fine = (F.length(curp) == 18) & (F.length(voter_key) == 18) & (a == b) & (F.length(digits) == 8) & a.rlike("^[0-9]{6}$")
    return F.when(F.coalesce(fine, F.lit(False)), F.when(apart <= 1, F.date_format(told, "dd/MM/yyyy")))


def merged_names(original: list[Column], fallback: list[Column], number: Column) -> list[Column]:
    """Three name lines from two readings. If the first reading begins with its own heading, its lines are shifted and the second
    is taken. Else the longest reading that begins with the initial told by the personal number, the first of equal ones; if none does,
    the first reading, or the second where that is empty."""
    plain = lambda c: F.regexp_replace(F.trim(F.upper(F.coalesce(c, F.lit("")))), r"\s+", " ")
    shifted = (F.upper(F.coalesce(original[0], F.lit(""))) == "NOMBRE") & (plain(original[1]) == plain(fallback[0]))
    out = []
    for a, b, place in zip(original, fallback, (1, 3, 4), strict=True):
        initial = F.when(F.length(number) == 18, F.substring(number, place, 1))
        fits = lambda c: (F.coalesce(F.length(c), F.lit(0)) > 0) & F.coalesce(F.upper(c).startswith(initial), F.lit(True))  # noqa: B023, E731
        best = F.when(fits(a) & fits(b), F.when(F.length(b) > F.length(a), b).otherwise(a)).when(fits(a), a).when(fits(b), b)
        out.append(F.when(shifted, b).otherwise(F.coalesce(best, F.nullif(a, F.lit("")), b)))
    return out


def nearest_in_zone(word: Column, zone: Column) -> Column:
    """A visual word (0 read as O) that is not in the zone: the substring of its length that differs in one character, the
    lexicographically first of several; the word itself if there is none."""
    x = F.translate(F.upper(word), "0", "O")
    n = F.length(x)
    parts = F.when(F.length(zone) >= n, F.transform(F.sequence(F.lit(1), F.length(zone) - n + 1), lambda i: F.substring(zone, i, n))).otherwise(F.array().cast("array<string>"))
    apart = lambda p: F.aggregate(F.zip_with(F.split(p, ""), F.split(x, ""), lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda s, v: s + v)
    return F.when(F.instr(zone, x) > 0, x).otherwise(F.coalesce(F.array_min(F.filter(parts, lambda p: apart(p) == 1)), x))


def visual_date(value: Column) -> Column:
    """Eight digits as DDMMYYYY to ISO; an empty string for anything else."""
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) == 8, F.coalesce(F.try_to_date(digits, "ddMMyyyy").cast("string"), F.lit(""))).otherwise("")


def swedish_date(value: Column, year: int) -> Column:
    """DD MON[/MON] YY to ISO, years over those of `year` being of the 1900s; anything else comes back unchanged."""
    x = F.upper(F.trim(value))
    pattern = r"^([0-9]{2})\s+([A-Z]{3})(?:/[A-Z]{3})?\s+([0-9]{2})$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(x, pattern, 2))
    yy = F.regexp_extract(x, pattern, 3).try_cast("int")
    full = F.when(yy > year % 100, 1900 + yy).otherwise(2000 + yy)
    said = F.concat_ws("-", full.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.regexp_extract(x, pattern, 1))
    return F.when(x.rlike(pattern) & (month > 0), F.coalesce(F.try_to_date(said, "yyyy-MM-dd").cast("string"), value)).otherwise(value)


def address_line(titled: Column) -> Column:
    """From a line in title case with single spaces: a leading Col in capitals, as are short abbreviations that end in a stop or comma."""
    line = F.when(titled.startswith("Col "), F.concat(F.lit("COL "), F.substring(titled, F.lit(5), F.length(titled)))).otherwise(titled)
    return F.array_join(F.transform(F.split(line, " "), lambda w: F.when(w.rlike(r"^\p{L}{2,4}[.,]+$"), F.upper(w)).otherwise(w)), " ")


def voter_card_accepted(curp: Column, elector_key: Column, *supporting: Column) -> Column:
    """A CURP-like number, or an elector key of at least 16 characters with at least one supporting field."""
    c, e = compact(curp), compact(elector_key)
    some = F.exists(F.array(*supporting), lambda x: F.coalesce(F.length(x), F.lit(0)) > 0) if supporting else F.lit(False)
    return c.rlike(r"^\p{L}{4}[0-9]{6}.{8}$") | ((F.length(e) >= 16) & some)


def swedish_card_score(number: Column, birth: Column, *other: Column) -> Column:
    """Two points for each of the first two fields that were read, one for each other; from 5 on the card is accepted."""
    has = lambda c: (F.coalesce(F.length(c), F.lit(0)) > 0).cast("int")
    return sum((has(c) for c in other), 2 * has(number) + 2 * has(birth))


def looked_up(code: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), code)


def country_name(code: Column) -> Column:
    """Null for an issuer without a name."""
    return looked_up(code, COUNTRY_NAMES)


def visual_key(key: Column) -> Column:
    """The output key of a visual field; null for one that is not given out."""
    return looked_up(key, VISUAL_KEYS | {k: k for k in SAME_KEYS})


def belarus_visual(authority: Column, place: Column, issued: Column, status_text: Column, status: Column) -> Column:
    """What the visual texts of a Belarusian passport add to its zone: eight digits of the issue date as a date (the text itself if
    they are none), the authority that a code names, and specimens, whose text begins with SAMI, as not valid."""
    digits = F.regexp_replace(F.coalesce(issued, F.lit("")), "[^0-9]", "")
    day = F.when(F.length(digits) == 8, F.try_to_date(digits, "ddMMyyyy").cast("string"))
    letters = F.regexp_replace(F.upper(F.coalesce(status_text, F.lit(""))), r"[^\p{L}]", "")
    specimen = letters.startswith("SAMI")
    fields = {"document_name": F.lit("Belarus - ePassport (2021)"), "country": F.lit("Belarus"), "nationality": F.lit("Belarus"), "authority": F.trim(authority), "authority_name": F.coalesce(looked_up(F.trim(authority), BLR_AUTHORITIES), F.lit("")), "place_of_birth": F.trim(place), "date_of_issue": F.coalesce(day, F.trim(issued)), "document_status": F.when(specimen, "SPECIMEN").otherwise(""), "status": F.when(specimen, 0).otherwise(status)}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def mexican_profile(nationalities: Column) -> Column:
    """From structs (text, confidence), one for each profile: the place of the one that reads MEXICANA (0 as O), then of the surest, the first of equal ones."""
    keyed = F.transform(nationalities, lambda n, i: F.struct((F.translate(F.upper(F.trim(n["text"])), "0", "O") == "MEXICANA").alias("own"), n["confidence"].alias("c"), (-i).alias("k")))
    return -F.array_max(keyed)["k"]


def mexican_visual(values: Column, first_line: Column) -> Column:
    """What the visual texts (structs of text and confidence: surname, givenNames, nationality, personalNumber, placeOfBirth, folioNumber, dateOfIssue) of
    a Mexican passport add to its zone. Words of names are mended by the zone's names; where both were read with 0.85, they make the zone's first line anew."""
    zone = F.translate(F.translate(F.substring(first_line, 6, 39), "0158", "OISB"), "<", "")
    mended = lambda c: F.array_join(F.transform(F.filter(F.split(F.trim(values[c]["text"]), r"\s+"), lambda w: w != ""), lambda w: nearest_in_zone(w, zone)), " ")
    upper = lambda c: F.translate(F.upper(F.trim(values[c]["text"])), "0", "O")
    surname, given = mended("surname"), mended("givenNames")
    sure = (values["surname"]["confidence"] >= 0.85) & (values["givenNames"]["confidence"] >= 0.85)
    line = F.rpad(F.concat(F.substring(first_line, 1, 5), F.translate(surname, " ", "<"), F.lit("<<"), F.translate(given, " ", "<")), 44, "<")
    folio = F.trim(values["folioNumber"]["text"])
    joined = F.array_join(F.filter(F.array(surname, given), lambda x: x != ""), " ")
    fields = {"document_name": F.lit("Mexico - ePassport (2021)"), "surname": surname, "given_names": given, "name": joined, "nationality": upper("nationality"), "personal_number": mexican_number(values["personalNumber"]["text"]), "place_of_birth": upper("placeOfBirth"), "date_of_issue": visual_date(values["dateOfIssue"]["text"]), "folio_number": F.when(folio.rlike("^[0-9]+$"), folio).otherwise(""), "first_line": F.when(sure, line).otherwise(first_line)}
    return F.struct(*(v.alias(k) for k, v in fields.items()))
