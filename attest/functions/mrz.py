"""Machine-readable zones (ICAO 9303) as fixed-width records: column expressions only.

A format is a table of slices; one builder makes the parser of any format from it. Characters outside the alphabet make a
check unknown (null), which counts as not valid. Dates of two-digit years are resolved against a given year, never today.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

WEIGHTS = (7, 3, 1)


@dataclass(frozen=True)
class Slice:
    """Characters [start, end) of a line (from 0), and where its check digit stands, if it has one."""

    line: int
    start: int
    end: int
    check: int | None = None


@dataclass(frozen=True)
class Format:
    lines: int
    width: int
    classes: str
    document_number: Slice
    birth: Slice
    expiry: Slice
    sex: Slice
    nationality: Slice
    names: Slice
    optional: Slice | None = None
    composite: tuple[Slice, ...] = ()
    composite_check: tuple[int, int] | None = None


def _two_lines(width: int, classes: str, **more) -> Format:
    return Format(2, width, classes, Slice(1, 0, 9, 9), Slice(1, 13, 19, 19), Slice(1, 21, 27, 27), Slice(1, 20, 21), Slice(1, 10, 13), Slice(0, 5, width), **more)


FORMATS = {
    "TD1": Format(3, 30, "", Slice(0, 5, 14, 14), Slice(1, 0, 6, 6), Slice(1, 8, 14, 14), Slice(1, 7, 8), Slice(1, 15, 18), Slice(2, 0, 30), None, (Slice(0, 5, 30), Slice(1, 0, 7), Slice(1, 8, 15), Slice(1, 18, 29)), (1, 29)),
    "TD2": _two_lines(36, "ACI", optional=Slice(1, 28, 35), composite=(Slice(1, 0, 10), Slice(1, 13, 20), Slice(1, 21, 35)), composite_check=(1, 35)),
    "TD3": _two_lines(44, "P", optional=Slice(1, 28, 42, 42), composite=(Slice(1, 0, 10), Slice(1, 13, 20), Slice(1, 21, 43)), composite_check=(1, 43)),
    "MRV-A": _two_lines(44, "V", optional=Slice(1, 28, 44)),
    "MRV-B": _two_lines(36, "V", optional=Slice(1, 28, 36)),
}
CHECKS = ("document_number", "birth", "expiry", "optional", "composite")


def weighted_sum(value: Column) -> Column:
    """Sum of character values times 7, 3, 1 in turn; null if a character is outside 0-9, A-Z and <."""
    return let(value, _weighted_sum)


def _weighted_sum(value: Column) -> Column:
    digits = F.translate(value, "<", "0")
    codes = F.transform(F.split(digits, ""), lambda c, i: (F.ascii(c) - F.when(c <= "9", 48).otherwise(55)) * F.element_at(F.array(*map(F.lit, WEIGHTS)), i % 3 + 1))
    return F.when(value == "", 0).when(value.rlike("^[0-9A-Z<]+$"), F.aggregate(codes, F.lit(0), lambda s, x: s + x))


def check_digit(value: Column) -> Column:
    return weighted_sum(value) % 10


def check_valid(value: Column, digit: Column) -> Column:
    """False for a check character that is no digit, before anything else is looked at."""
    return F.when(~digit.rlike("^[0-9]$"), False).otherwise(check_digit(value) == digit.try_cast("int"))


def normalised(lines: Column, three: bool | None = None) -> Column:
    """Upper case; spaces become fillers, but on the first two of three lines they go (on all, if three lines are meant and there are not three)."""
    closed = lambda x: F.replace(F.upper(x), F.lit(" "), F.lit(""))
    filled = lambda x: F.replace(F.upper(x), F.lit(" "), F.lit("<"))
    if three is None:
        return F.when(F.size(lines) == 3, F.transform(lines, lambda x, i: F.when(i < 2, closed(x)).otherwise(filled(x)))).otherwise(F.transform(lines, filled))
    return F.when(F.size(lines) == 3, F.transform(lines, lambda x, i: F.when(i < 2, closed(x)).otherwise(filled(x)))).otherwise(F.transform(lines, closed)) if three else F.transform(lines, filled)


def full_year(yy: Column, kind: str, year: int) -> Column:
    """birth: not after this year. expiry: nearest to this year, of two as near the earlier."""
    near = F.lit(year // 100 * 100) + yy
    if kind == "birth":
        return F.when(near > year, near - 100).otherwise(near)
    return F.when(near - year >= 50, near - 100).when(near - year < -50, near + 100).otherwise(near)


def date_of(yymmdd: Column, kind: str, year: int) -> Column:
    """ISO date; null for anything that is no date."""
    return let(yymmdd, lambda x: _date_of(x, kind, year))


def _date_of(yymmdd: Column, kind: str, year: int) -> Column:
    yy = F.substring(yymmdd, 1, 2).try_cast("int")
    said = F.concat_ws("-", F.lpad(full_year(yy, kind, year).cast("string"), 4, "0"), F.substring(yymmdd, 3, 2), F.substring(yymmdd, 5, 2))
    return F.when(yymmdd.rlike("^[0-9]{6}$"), F.try_to_date(said, "yyyy-MM-dd").cast("string"))


def _cut(lines: Column, s: Slice) -> Column:
    return F.substring(F.get(lines, F.lit(s.line)), s.start + 1, s.end - s.start)


def _at(lines: Column, line: int, place: int) -> Column:
    return F.substring(F.get(lines, F.lit(line)), place + 1, 1)


def unfilled(value: Column) -> Column:
    return F.replace(value, F.lit("<"), F.lit(""))


def _spaced(block: Column) -> Column:
    return F.array_join(F.filter(F.split(block, "<"), lambda x: x != ""), " ")


def names_of(zone: Column) -> tuple[Column, Column]:
    """Surname and given names: the zone is cut at its first double filler, single ones part words."""
    at = F.instr(zone, "<<")
    return _spaced(F.substring_index(zone, "<<", 1)), F.when(at > 0, _spaced(F.substring(zone, at + 2, F.length(zone)))).otherwise(F.lit(""))


def shape_error(lines: Column, name: str) -> Column:
    """lines or class if the (normalised) lines do not have the format; null if they do."""
    f = FORMATS[name]
    shaped = (F.size(lines) == f.lines) & F.forall(lines, lambda x: F.length(x) == f.width)
    of_class = F.lit(True) if not f.classes else F.substring(F.get(lines, F.lit(0)), 1, 1).isin(*f.classes)
    return F.when(~F.coalesce(shaped, F.lit(False)), "lines").when(~of_class, "class")


def belarus_number(value: Column) -> Column:
    """Positional repair of a 14-character personal number: digits where digits stand, letters where letters stand."""
    digits, letters = lambda x: F.translate(x, "OQIL", "0011"), lambda x: F.translate(x, "801", "BOI")
    part = lambda a, n: F.substring(value, a, n)
    return F.when(F.length(value) == 14, F.concat(digits(part(1, 7)), letters(part(8, 1)), part(9, 3), letters(part(12, 2)), digits(part(14, 1)))).otherwise(value)


def _read(lines: Column, name: str) -> Column:
    """The lines that checks are made on: in a Belarusian TD3 with its personal number repaired."""
    if name != "TD3":
        return lines
    second = F.get(lines, F.lit(1))
    repaired = F.concat(F.substring(second, 1, 28), belarus_number(F.substring(second, 29, 14)), F.substring(second, 43, 2))
    return F.when(F.substring(F.get(lines, F.lit(0)), 3, 3) == "BLR", F.array(F.get(lines, F.lit(0)), repaired)).otherwise(lines)


def checks(lines: Column, name: str) -> dict[str, Column]:
    f = FORMATS[name]
    out = {what: check_valid(_cut(lines, s), _at(lines, s.line, s.check)) for what in ("document_number", "birth", "expiry", "optional") if (s := getattr(f, what)) and s.check is not None}
    if f.composite_check:
        out["composite"] = check_valid(F.concat(*(_cut(lines, s) for s in f.composite)), _at(lines, *f.composite_check))
    return out


def parsed(lines: Column, name: str, year: int) -> Column:
    """_parsed() of lines that are computed once, however they are made."""
    return let(lines, lambda x: _parsed(x, name, year))


def _parsed(lines: Column, name: str, year: int) -> Column:
    """A struct of the fields of normalised lines; null where they do not have the format.

    error is date if a date is none, alphabet if a check has characters that it cannot weigh; checks that are unknown count as
    not valid. status is 1 if all checks hold, 0 otherwise.
    """
    def told(z: Column) -> Column:
        names = list(checks(lines, name))
        sure = {k: F.coalesce(z["checks"][k], F.lit(False)) for k in names}
        n = sum((v.cast("int") for v in sure.values()), F.lit(0))
        fields = {
            "profile": F.lit(name),
            "document_class": unfilled(F.substring(F.get(lines, F.lit(0)), 1, 2)),
            "issuing_state": unfilled(F.substring(F.get(lines, F.lit(0)), 3, 3)),
            "document_number": unfilled(_cut(lines, f.document_number)),
            "date_of_birth": z["birth"],
            "date_of_expiry": z["expiry"],
            "sex": unfilled(_cut(lines, f.sex)),
            "nationality": unfilled(_cut(lines, f.nationality)),
            "surname": z["surname"],
            "given_names": z["given"],
            "name": F.array_join(F.filter(F.array(z["surname"], z["given"]), lambda x: x != ""), " "),
            "optional_data": unfilled(_cut(_read(lines, name), f.optional)) if f.optional else F.lit(None).cast("string"),
            "checks": F.map_from_arrays(F.array(*map(F.lit, sure)), F.array(*sure.values())),
            "n_valid": n,
            "status": F.when(n == len(sure), 1).otherwise(0),
            "error": F.when(z["birth"].isNull() | z["expiry"].isNull(), "date").when(F.exists(F.array(*(z["checks"][k] for k in names)), lambda x: x.isNull()), "alphabet"),
        }
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    f = FORMATS[name]
    surname, given = names_of(_cut(lines, f.names))
    birth, expiry = date_of(_cut(lines, f.birth), "birth", year), date_of(_cut(lines, f.expiry), "expiry", year)
    held = let(_read(lines, name), lambda x: F.struct(*(v.alias(k) for k, v in checks(x, name).items())))
    once = F.struct(held.alias("checks"), birth.alias("birth"), expiry.alias("expiry"), surname.alias("surname"), given.alias("given"))
    return F.when(shape_error(lines, name).isNull(), let(once, told))


def has_format(lines: Column, name: str) -> Column:
    """Whether lines have the shape of a format and two dates that are some."""
    f = FORMATS[name]
    dates = [date_of(_cut(lines, s), kind, 2000).isNotNull() for s, kind in ((f.birth, "birth"), (f.expiry, "expiry"))]
    return F.coalesce(shape_error(lines, name).isNull() & dates[0] & dates[1], F.lit(False))


def score(lines: Column, name: str) -> Column:
    """Number of valid checks; 0 where the lines do not have the format, have an unweighable character or a date that is none."""
    return let(lines, lambda x: _score(x, name))


def _score(lines: Column, name: str) -> Column:
    results = let(_read(lines, name), lambda x: F.array(*checks(x, name).values()))
    count = let(results, lambda x: F.when(F.forall(x, lambda v: v.isNotNull()), F.size(F.filter(x, lambda v: v))).otherwise(0))
    return F.when(has_format(lines, name), count).otherwise(0)


def two_line_score(lines: Column) -> Column:
    """The best score of the two-line formats."""
    return F.greatest(*(score(lines, name) for name in ("TD3", "TD2", "MRV-A", "MRV-B")))


def fully_valid(lines: Column) -> Column:
    """Whether two normalised lines have all checks of the format that their first character and width name."""
    first, width = F.substring(F.get(lines, F.lit(0)), 1, 1), F.length(F.get(lines, F.lit(0)))
    held = (
        F.when(first == "V", F.greatest(score(lines, "MRV-A"), score(lines, "MRV-B")) == 3)
        .when((width == 36) & first.isin("A", "C", "I"), score(lines, "TD2") == 4)
        .when((width == 44) & (first == "P"), score(lines, "TD3") == 5)
    )
    return F.coalesce(F.when(F.size(lines) == 2, held), F.lit(False))


def repaired_td3(lines: Column) -> Column:
    """A short first line is filled up; into a short second line fillers go before its last two digits. Of the readings that have the
    format and dates, the one with most valid checks, the plain one first; the plain one if there is none."""
    n = F.transform(lines, lambda x: F.replace(F.upper(F.trim(x)), F.lit(" "), F.lit("<")))
    first, second = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    first = F.when(first.startswith("P") & (F.length(first) < 44), F.rpad(first, 44, "<")).otherwise(first)
    short = F.length(second).between(30, 43) & second.rlike("[0-9]{2}$")
    filled = F.concat(F.substring(second, F.lit(1), F.length(second) - 2), F.repeat(F.lit("<"), F.lit(44) - F.length(second)), F.right(second, F.lit(2)))

    def best(x: Column) -> Column:
        scores = F.transform(x, lambda c: F.when(has_format(c, "TD3"), score(c, "TD3")).otherwise(-1))
        return F.get(x, F.array_position(scores, F.array_max(scores)).cast("int") - 1)

    readings = F.concat(F.array(F.array(first, second)), F.when(short, F.array(F.array(first, filled))).otherwise(F.array().cast("array<array<string>>")))
    return F.when(F.size(n) != 2, n).otherwise(let(readings, best))


def td1_candidates(lines: Column) -> Column:
    """Normalised three lines and their repairs, in order: the lines as they are; a missing filler and composite digit on line two;
    a filler too many on line three; one character too many on line one or two."""
    a, b, c = (F.get(lines, F.lit(k)) for k in range(3))
    la, lb, lc = map(F.length, (a, b, c))
    none = F.array().cast("array<array<string>>")
    digits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.array(a, F.concat(b, F.lit("<"), d.cast("string")), c))
    without = lambda x, k: F.concat(F.substring(x, F.lit(1), k), F.substring(x, k + 2, F.lit(31)))
    return F.concat(
        F.array(lines),
        F.when((la == 30) & (lb == 28) & (lc == 30), digits).otherwise(none),
        F.when((lc == 31) & c.endswith("<"), F.array(F.array(a, b, F.substring(c, 1, 30)))).otherwise(none),
        F.when(la == 31, F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.array(without(a, k), b, c))).otherwise(none),
        F.when(lb == 31, F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.array(a, without(b, k), c))).otherwise(none),
    )


def repaired_td1(lines: Column) -> Column:
    """The first candidate with all four checks, else the normalised lines; lines that are not three come back as they are.

    A candidate is held against the check of its number first, then against those of its dates, each a sum over a few characters: only those that
    meet all three are scored as a whole.
    """
    f = FORMATS["TD1"]

    def good(x: Column) -> Column:
        quick = [F.coalesce(check_valid(_cut(x, s), _at(x, s.line, s.check)), F.lit(False)) for s in (f.document_number, f.birth, f.expiry)]
        return quick[0] & quick[1] & quick[2] & (score(x, "TD1") == 4)

    def repaired(n: Column) -> Column:
        return F.coalesce(F.get(F.filter(td1_candidates(n), good), F.lit(0)), n)

    return F.when(F.size(lines) != 3, lines).otherwise(let(normalised(lines, three=True), repaired))


def search_ratios(expected: Column, lines: int) -> Column:
    """Zone heights to try: around the expected one where that lies in [0.08, 0.40], then the defaults for two or three lines; each once."""
    defaults = (0.13, 0.17, 0.21, 0.25) if lines == 2 else (0.18, 0.23, 0.28, 0.33)
    own = F.filter(F.transform(F.array(F.lit(0.95), F.lit(1.1), F.lit(1.25)), lambda k: expected * k), lambda x: x.between(0.08, 0.40))
    return F.array_distinct(F.concat(F.when(expected.isNull(), F.array().cast("array<double>")).otherwise(own), F.array(*map(F.lit, defaults))))


def line_bounds(zone: Column, lines: int, overlap: float = 0.12) -> Column:
    """The bands of a zone [left, top, right, bottom] that hold its lines, each a little wider and held within [0, 1]."""
    height = (zone[3] - zone[1]) / lines
    return F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda i: F.array(zone[0], F.greatest(zone[1] + height * i - height * overlap, F.lit(0.0)), zone[2], F.least(zone[1] + height * (i + 1) + height * overlap, F.lit(1.0))))


def physical_geometry(width_units: Column, height_units: Column, document_width: Column, document_height: Column, line_distance: Column) -> Column:
    """Tenths of millimetres against millimetres, as ratios; null unless all four sizes are positive, the line distance null unless it is."""
    fine = (width_units > 0) & (height_units > 0) & (document_width > 0) & (document_height > 0)
    return F.when(fine, F.struct((width_units / 10 / document_width).alias("widthRatio"), (height_units / 10 / document_height).alias("heightRatio"), F.when(line_distance > 0, line_distance / 10 / document_height).alias("lineDistanceRatio")))
