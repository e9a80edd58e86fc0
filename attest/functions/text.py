"""Identity text: keys, variants, compatibility, dates. NFKC and NFKD have no SQL function: those steps are pandas UDFs."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .let import let


@F.pandas_udf(StringType())
def nfkc_key(values: pd.Series) -> pd.Series:
    """NFKC, upper case, letters and digits only; null counts as empty."""
    return values.map(lambda x: "".join(filter(str.isalnum, unicodedata.normalize("NFKC", x or "").upper())))


@F.pandas_udf(StringType())
def strip_marks(values: pd.Series) -> pd.Series:
    """NFKD without combining marks; null counts as empty."""
    return values.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def letters_nfkd(values: pd.Series) -> pd.Series:
    """Upper case, NFKD, letters only; null counts as empty."""
    return values.map(lambda x: "".join(filter(str.isalpha, unicodedata.normalize("NFKD", (x or "").upper()))))


@F.pandas_udf(StringType())
def title_case(values: pd.Series) -> pd.Series:
    """Every letter after a non-letter is upper case, unlike initcap. Null stays null."""
    return values.map(lambda x: None if x is None else x.title())


def ascii_key(value: Column) -> Column:
    """nfkc_key for texts in which every character is its own NFKC form, on the JVM."""
    return F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^\p{L}\p{N}]", ""))


def transliterated(value: Column, table: dict[str, str]) -> Column:
    """Character by character through a table; others stay. Null counts as empty."""
    text = F.coalesce(value, F.lit(""))
    if not table:
        return text
    known, told = F.lit("".join(table)), F.split(F.lit("|".join(table.values())), r"\|")
    one = lambda c: F.when(F.instr(known, c) > 0, F.get(told, F.instr(known, c) - 1)).otherwise(c)
    return F.when(text == "", "").otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def variants(value: Column, table: dict[str, str] | None = None) -> Column:
    """Distinct non-empty keys under which a text may stand elsewhere: as it is, without marks, and transliterated as it is and in upper case."""
    keys = [nfkc_key(value), nfkc_key(strip_marks(value))]
    if table:
        keys += [nfkc_key(transliterated(value, table)), nfkc_key(transliterated(F.upper(value), table))]
    return F.array_distinct(F.filter(F.array(*keys), lambda x: x != ""))


def icao_variants(value: Column) -> Column:
    """variants() with the ICAO transliteration."""
    return variants(value, icao_table())


def compatible(a: Column, b: Column) -> Column:
    """For arrays of variants: null if one is empty; else whether one of one side begins with one of the other."""
    met = lambda p: F.exists(p["a"], lambda x: F.exists(p["b"], lambda y: x.startswith(y) | y.startswith(x)))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.when((F.size(p["a"]) > 0) & (F.size(p["b"]) > 0), met(p)))


def compatible_keys(a: Column, b: Column) -> Column:
    """compatible() for one key a side; null and empty keys are not comparable."""
    return F.when((F.coalesce(F.length(a), F.lit(0)) > 0) & (F.coalesce(F.length(b), F.lit(0)) > 0), a.startswith(b) | b.startswith(a))


def date_key(value: Column) -> Column:
    """Digits of a date. Eight that do not lead with a four-digit year are DDMMYYYY and become YYYYMMDD."""
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")
    turned = F.concat(F.substring(digits, 5, 4), F.substring(digits, 3, 2), F.substring(digits, 1, 2))
    return F.when((F.length(digits) != 8) | value.rlike("^[0-9]{4}"), digits).otherwise(turned)


#: Transliteration of ICAO 9303 part 3 (fixed values): where Latin letters are not written by their plain letter, and other scripts in capitals.
ICAO_LATIN = {"Ä": "AE", "Å": "AA", "Æ": "AE", "Ð": "D", "Ñ": "N", "Ö": "OE", "Ø": "OE", "Ü": "UE", "Þ": "TH", "ß": "SS", "Œ": "OE", "Ĳ": "IJ", "Đ": "D", "Ł": "L", "Ŋ": "N", "Ħ": "H", "Ŧ": "T", "ı": "I", "ĸ": "Q"}
ICAO_CYRILLIC = "А A Б B В V Г G Д D Е E Ё E Ж ZH З Z И I І I Й I К K Л L М M Н N О O П P Р R С S Т T У U Ф F Х KH Ц TS Ч CH Ш SH Щ SHCH Ъ IE Ы Y Э E Ю IU Я IA Ґ G Ѓ G Є IE Ї I Ђ D Ѕ DZ Ј J Ќ K Љ LJ Њ NJ Ћ C Ў U Џ DZ Ѫ U Ѵ Y"
ICAO_GREEK = "Α A Β V Γ G Δ D Ε E Ζ Z Η I Θ TH Ι I Κ K Λ L Μ M Ν N Ξ X Ο O Π P Ρ R Σ S Τ T Υ U Φ F Χ CH Ψ PS Ω O"
ICAO_ARABIC = "ء XE آ XAA أ XAE ؤ U إ I ئ XI ا A ب B ة XTA ت T ث XTH ج J ح XH خ XKH د D ذ XDH ر R ز Z س S ش XSH ص XSS ض XDZ ط XTT ظ XZZ ع E غ G ف F ق Q ك K ل L م M ن N ه H و W ى XAY ي Y"
LATIN_BLOCKS = (range(0xC0, 0x250), range(0x1E00, 0x1F00))


@cache
def icao_table() -> dict[str, str]:
    """Character -> letters. Latin letters with marks give their plain letter unless listed; Greek and Cyrillic small letters go as capitals do; marked Greek ones as plain ones."""
    plain = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    out: dict[str, str] = {}
    for script in (ICAO_CYRILLIC, ICAO_GREEK, ICAO_ARABIC):
        words = script.split()
        out |= dict(zip(words[::2], words[1::2], strict=True))
    out |= {"Ь": "", "ς": "S"}
    for c in map(chr, range(0x386, 0x3D0)):
        if c.isalpha() and c not in out and (base := plain(c).upper()) in out:
            out[c] = out[base]
    for c, told in [*out.items()]:
        if len(c.lower()) == 1:
            out.setdefault(c.lower(), told)
    for c in (chr(k) for block in LATIN_BLOCKS for k in block):
        listed = ICAO_LATIN.get(c) or ICAO_LATIN.get(c.upper())
        base = plain(c).upper()
        if c.isalpha() and (listed or base.isascii() and base.isalpha()):
            out[c] = listed or base
    return out
