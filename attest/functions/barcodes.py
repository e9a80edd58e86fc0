"""Barcode payloads: AAMVA records, verification URLs, evidence rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

#: Designators of the AAMVA DL/ID standard and the names of their fields (fixed values).
AAMVA = {"DCS": "familyName", "DAC": "firstName", "DAD": "middleName", "DBB": "dateOfBirth", "DBA": "dateOfExpiry", "DBD": "dateOfIssue", "DBC": "sexCode", "DAY": "eyeColor", "DAU": "height", "DAG": "addressLine1", "DAH": "addressLine2", "DAI": "city", "DAJ": "jurisdictionCode", "DAK": "postalCode", "DAQ": "documentNumber", "DCF": "documentDiscriminator", "DCG": "countryCode", "DAZ": "hairColor"}
#: Catalog code types and symbologies (fixed values).
SYMBOLOGY = {1: "Code128", 2: "Code39", 3: "EAN8", 4: "ITF", 5: "PDF417", 9: "Codabar", 10: "UPCA", 11: "Code93", 12: "UPCE", 13: "EAN13", 14: "QRCode", 15: "Aztec", 16: "DataMatrix"}
CONTROL_NAMES = ("<NUL>", "<U+", "<SOH>", "<STX>")


def symbology(code_type: Column) -> Column:
    """Null for a type that the catalog does not name: any symbology is then looked for."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in SYMBOLOGY.items() for x in pair)), code_type)


def aamva_date(value: Column) -> Column:
    """MMDDYYYY, else YYYYMMDD, to ISO; the value itself if neither."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.coalesce(F.try_to_date(digits, "MMddyyyy").cast("string"), F.try_to_date(digits, "yyyyMMdd").cast("string"), value)


def header_valid(text: Column) -> Column:
    return text.startswith("@") & F.contains(F.substring(text, 1, 20), F.lit("ANSI "))


def aamva_fields(text: Column) -> Column:
    """designator -> value; a designator that comes again counts as it comes last.

    A line may open with its designator, or hold it after other data; then the last place where one stands is taken, the
    alphabetically last designator of those that stand there.
    """
    known = list(AAMVA)
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.regexp_replace(x, r"^[\x00\x1e ]+|[\x00\x1e ]+$", ""))
    lines = F.transform(lines, lambda x: F.when(x.startswith("DL") & (F.length(x) >= 5), F.substring(x, F.lit(3), F.length(x))).otherwise(x))

    def opened(x: Column) -> Column:
        places = F.transform(F.array(*map(F.lit, known)), lambda d: F.length(x) - F.length(F.call_function("substring_index", x, d, F.lit(-1))) - 2)
        last = F.array_max(F.transform(places, lambda p: F.when(p >= 1, p).otherwise(0)))
        return F.when(F.substring(x, 1, 3).isin(known), x).when(last > 0, F.substring(x, last, F.length(x))).otherwise(x)

    lines = F.filter(F.transform(lines, opened), lambda x: (F.length(x) >= 4) & F.substring(x, 1, 3).isin(known))
    return let(lines, _last_of_each)


def _last_of_each(lines: Column) -> Column:
    pairs = F.transform(lines, lambda x, i: F.struct(F.substring(x, 1, 3).alias("k"), F.trim(F.substring(x, F.lit(4), F.length(x))).alias("v"), i.alias("i")))
    last = let(pairs, lambda every: F.filter(every, lambda p: ~F.exists(every, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"]))))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def parsed_aamva(text: Column, fields: Column | None = None) -> Column:
    """A struct of the fields by name, with sex, address and header_valid; missing fields are empty strings."""
    return let(aamva_fields(text) if fields is None else fields, lambda held: _named(text, held))


def _named(text: Column, held: Column) -> Column:
    get = lambda d: F.coalesce(F.try_element_at(held, F.lit(d)), F.lit(""))
    of = {name: get(d) for d, name in AAMVA.items()}
    for name in ("dateOfBirth", "dateOfExpiry", "dateOfIssue"):
        of[name] = F.when(of[name] != "", aamva_date(of[name])).otherwise("")
    code = of.pop("sexCode")
    of["sex"] = F.when(code == "1", "M").when(code == "2", "F").when(code == "9", "X").otherwise("")
    of["address"] = F.array_join(F.filter(F.array(*(of[x] for x in ("addressLine1", "addressLine2", "city", "jurisdictionCode", "postalCode"))), lambda x: x != ""), ", ")
    return F.struct(header_valid(text).alias("headerValid"), F.array_sort(F.map_keys(held)).alias("availableDesignators"), *(v.alias(k) for k, v in of.items()))


def printable_share(text: Column) -> Column:
    """Of the characters, those that are not control, format or unassigned ones, nor separators other than the plain space."""
    return F.length(F.regexp_replace(text, r"\p{C}|[\p{Z}&&[^ ]]", "")) / F.length(text)


def is_evidence(text: Column, valid: Column, symbology_name: Column, header: Column, designators: Column) -> Column:
    """Whether a decoded symbol counts: valid, not empty, no names of control characters, at most 512 characters, 90 % printable, and a PDF417 only as an AAMVA record."""
    t = F.trim(text)
    named = F.greatest(*(F.contains(t, F.lit(x)) for x in CONTROL_NAMES))
    held = valid & (F.length(t).between(1, 512)) & ~named
    record = (symbology_name != "PDF417") | (header & (designators > 0))
    return F.coalesce(F.when(held, (printable_share(t) >= 0.9) & record), F.lit(False))


def verification_url(url: Column, host: str = "qr.ine.mx") -> Column:
    """identifier, issue date, type and query id from http(s)://host/digits/YYYYMMDD/c/digits; null for any other text."""
    return let(F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda x: x != ""), lambda parts: _verified(url, parts, host))


def _verified(url: Column, parts: Column, host: str) -> Column:
    day = F.try_to_date(F.get(parts, F.lit(1)), "yyyyMMdd")
    p = lambda k: F.get(parts, F.lit(k))
    shaped = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.lower(F.try_parse_url(url, F.lit("HOST"))) == host) & (F.size(parts) == 4) & p(0).rlike("^[0-9]+$") & p(1).rlike("^[0-9]{8}$") & day.isNotNull() & (F.length(p(2)) == 1) & p(3).rlike("^[0-9]+$")
    return F.when(F.coalesce(shaped, F.lit(False)), F.struct(p(0).alias("identifier"), day.cast("string").alias("issueDate"), p(2).alias("type"), p(3).alias("queryIdentifier"), url.alias("url")))


def scan_pdf417(profile: Column, layout_hint: Column, mrz_hint: Column) -> Column:
    """Whether the expensive symbol scan is worth while: always for its own profile; for automatic ones unless a hint says that there is none."""
    hinted = F.coalesce(layout_hint.isin("mex_ine", "swe_id_2021"), F.lit(False)) | F.coalesce(mrz_hint.isin("td1", "td2", "td3", "mrv"), F.lit(False))
    return (profile == "aamva_pdf417") | ((profile == "auto_research") & ~hinted)


def qr_evidence(symbols: Column, host: str = "qr.ine.mx") -> Column:
    """From structs (format, text, decoder), in order: the first QRCode with a verification URL, with the digits of the first Code128 that is digits only ("" without one); null if there is no such QRCode."""
    urls = F.filter(F.transform(F.filter(symbols, lambda s: s["format"] == "QRCode"), lambda s: F.struct(verification_url(s["text"], host).alias("u"), s["decoder"].alias("decoder"))), lambda s: s["u"].isNotNull())
    numbers = F.filter(symbols, lambda s: (s["format"] == "Code128") & s["text"].rlike("^[0-9]+$"))

    def told(first: Column) -> Column:
        u = first["u"]
        fields = {"credential_identifier": u["identifier"], "issue_date": u["issueDate"], "credential_type": u["type"], "query_identifier": u["queryIdentifier"], "verification_url": u["url"]}
        fields |= {"barcode_number": F.coalesce(F.get(numbers, F.lit(0))["text"], F.lit("")), "format": F.lit("QRCode"), "decoder": first["decoder"]}
        return F.when(first.isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))

    return let(F.get(urls, F.lit(0)), told)


def qr_result(evidence: Column) -> Column:
    """The document that a verification QR alone stands for; null without evidence."""
    fields = {"document_name": F.lit("Voter Credential"), "country": F.lit("Mexico"), "document_number": evidence["credential_identifier"], "date_of_issue": evidence["issue_date"], "credential_type": evidence["credential_type"], "query_identifier": evidence["query_identifier"], "barcode_number": evidence["barcode_number"], "source": F.lit("BARCODE"), "sources": F.array(F.lit("BARCODE")), "status": F.lit(1), "profile": F.lit("MEX-INE-QR"), "profile_status": F.lit("selected_by_public_verification_qr_structure"), "engine": evidence["decoder"], "barcode_format": evidence["format"]}
    return F.when(evidence.isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))


def aamva_result(record: Column) -> Column:
    """The document that a parsed AAMVA record stands for: valid if its header is; the country is the United States unless it is stated."""
    some = lambda *names: F.array_join(F.filter(F.array(*(record[n] for n in names)), lambda x: x != ""), " ")
    country = F.coalesce(F.nullif(record["countryCode"], F.lit("")), F.lit("USA"))
    fields = {"document_name": F.lit("Driver License"), "country": country, "document_number": record["documentNumber"], "surname": record["familyName"], "given_names": some("firstName", "middleName"), "surname_and_given_names": some("familyName", "firstName", "middleName"), "date_of_birth": record["dateOfBirth"], "date_of_expiry": record["dateOfExpiry"], "sex": record["sex"], "address": record["address"], "source": F.lit("BARCODE"), "sources": F.array(F.lit("BARCODE")), "status": F.when(record["headerValid"], 1).otherwise(-1), "profile": F.lit("AAMVA-PDF417"), "profile_status": F.lit("selected_by_valid_barcode"), "designators": record["availableDesignators"]}
    return F.struct(*(v.alias(k) for k, v in fields.items()))
