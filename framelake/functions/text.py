"""Text functions as Column expressions: normalisation, distance, report fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    """Line feeds as " | "."""
    return F.replace(text, F.lit("\n"), F.lit(" | "))


def normalise(text: Column) -> Column:
    """Without spaces, tabs and bars; null is empty. Other white space stays."""
    return F.translate(F.coalesce(text, F.lit("")), " \t|", "")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over code points."""
    return F.levenshtein(a, b)


def error_rate(got: Column, expected: Column) -> Column:
    """Distance by expected length (1 at least); above 1 for a reading that is too
    long. Both are normalised already."""
    return edit_distance(got, expected) / F.greatest(F.length(expected), F.lit(1))


def tidy(text: Column) -> Column:
    """Carriage return, form feed, vertical tab and tab as spaces; spaces and line
    feeds at the ends go; one line."""
    return one_line(F.trim(F.translate(F.coalesce(text, F.lit("")), "\r\f\v\t", "    "), F.lit(" \n")))


def screen_name(path: Column) -> Column:
    """The file name of a path without its last extension."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")


def confidence(score: Column) -> Column:
    """A score as an integer percentage, halves up."""
    return F.floor(score * 100 + 0.5).cast("int")


# How a report prints its detection time and its texts.
_DET_LINE, _TEXT_FIELD, _PIECE_LINE = r"Det      :\s*([0-9.]+) ms", r'text="([^"]*)', r"(?m)^\s*\["


def report_det_ms(report: Column) -> Column:
    """The detection time of a printed report, NA where it has none."""
    found = F.regexp_extract(report, _DET_LINE, 1)
    return F.when(found == "", "NA").otherwise(found)


def report_texts(report: Column) -> Column:
    """Every recognised text of a printed report, in order."""
    return F.regexp_extract_all(report, F.lit(_TEXT_FIELD), F.lit(1))


def report_pieces(report: Column) -> Column:
    """The number of a report's lines that begin with a bracket."""
    return F.regexp_count(report, F.lit(_PIECE_LINE)).cast("long")


def corners(points: Column) -> Column:
    """Corners as printed: (x,y)-(x,y)-..., coordinates to the nearest integer,
    halves to even."""
    return F.array_join(F.transform(points, lambda p: F.concat(F.lit("("), F.rint(p["x"]).cast("long").cast("string"), F.lit(","), F.rint(p["y"]).cast("long").cast("string"), F.lit(")"))), "-")


def score_text(score: Column) -> Column:
    """A score as the first five characters of its six-digit form."""
    return F.substring(F.format_string("%.6f", score.cast("double")), 1, 5)


def fixed(value: Column, places: int) -> Column:
    """A number of at least zero with this many decimals (three at most), as C prints
    it: the exact binary value decides, and an exact half goes to the even digit."""
    v = value.cast("double")
    whole = F.floor(v)
    scaled = (v - whole) * 2.0**60
    bits = F.floor(scaled).cast("decimal(20,0)")
    unit = F.lit(1 << 60).cast("decimal(20,0)")
    grown = bits * F.lit(10**places).cast("decimal(4,0)")
    digits = F.floor(grown / unit)
    # The quotient of decimals is rounded itself, so the remainder corrects it.
    digits = F.when(digits.cast("decimal(5,0)") * unit > grown, digits - 1).otherwise(digits).cast("long")
    rest = (grown - digits.cast("decimal(5,0)") * unit) * 2
    up = (rest > unit) | ((rest == unit) & ((scaled != F.floor(scaled)) | (digits % 2 == 1)))
    total = whole * 10**places + digits + up.cast("long")
    return F.concat(F.floor(total / 10**places).cast("string"), F.lit("."), F.lpad((total % 10**places).cast("string"), places, "0"))
