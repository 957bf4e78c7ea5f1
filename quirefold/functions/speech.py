"""Normalising text for reading aloud, as columns. Null stays null."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import _col, let, strip
from .numwords import cardinal, ordinal
from .patterns import LEFT, RIGHT

# Abbreviations that end in a full stop, in the order they are applied.
ABBREVIATIONS = {
    "Dr.": "Doctor",
    "Mr.": "Mister",
    "Mrs.": "Misses",
    "Ms.": "Miss",
    "Prof.": "Professor",
    "St.": "Saint",
    "Gov.": "Governor",
    "Gen.": "General",
    "Sgt.": "Sergeant",
    "Cpt.": "Captain",
    "Cpl.": "Corporal",
    "Pvt.": "Private",
    "Rev.": "Reverend",
    "Hon.": "Honorable",
    "etc.": "etcetera",
    "vs.": "versus",
    "e.g.": "for example",
    "i.e.": "that is",
    "viz.": "namely",
    "approx.": "approximately",
    "dept.": "department",
    "no.": "number",
}
# States, whole words.
STATES = {"PA": "Pennsylvania", "CA": "California", "NY": "New York", "TX": "Texas", "FL": "Florida", "IL": "Illinois"}
DIGITS = "0123456789"
#: Digits that no number rule sees, while a year or version is masked.
MASKED = "".join(chr(0xE000 + i) for i in range(10))
# Patterns of years, versions and numbers. The look ahead comes first: it turns most positions away at the least cost.
YEAR = rf"(?=[12]){LEFT}(?:1[89][0-9]{{2}}|20[012][0-9]){RIGHT}"
# the border of a version that ends in a full stop is a letter or digit behind it
VERSION = rf"(?i)(?=v[0-9]){LEFT}v[0-9][0-9.]*(?:(?<=[0-9]){RIGHT}|(?<=\.)(?=[\p{{L}}\p{{N}}_]))"
DECIMAL = rf"(?=[0-9]){LEFT}([0-9]+)\.([0-9]+){RIGHT}"
ORDINAL = rf"(?i)(?=[0-9]){LEFT}[0-9]+(?:st|nd|rd|th){RIGHT}"
INTEGER = rf"(?=[0-9]){LEFT}[0-9]{{1,9}}{RIGHT}"


def expand_abbreviations(c: Column | str) -> Column:
    # the letters come first, the look behind after them: few positions get that far; texts without them are passed over
    quoted = {a: (rf"{p}(?<![\p{{L}}\p{{N}}_]{p})", b) for a, b in ABBREVIATIONS.items() for p in (a.replace(".", r"\."),)}
    rules = quoted | {a: (rf"{a}(?<![\p{{L}}\p{{N}}_]{a}){RIGHT}", b) for a, b in STATES.items()}

    def step(t: Column, item: tuple[str, tuple[str, str]]) -> Column:
        return let(t, lambda x: F.when(x.contains(item[0]), F.regexp_replace(x, *item[1])).otherwise(x))

    return reduce(step, rules.items(), _col(c))


def replace_matches(c: Column, pattern: str, of: Callable[[Column], Column]) -> Column:
    """Each match replaced by of(match); a match stays where that is null."""


    def put(t: Column) -> Column:
        between, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        put_in = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(of(b), b, F.lit("")))), "")
        return F.when(t.rlike(pattern), put_in).otherwise(t)

    return let(c, put)


def protect(c: Column | str) -> Column:
    """Years, then versions, with their digits masked and between underscores, which are word characters."""

    def mask(b: Column) -> Column:
        return F.concat(F.lit("_"), F.translate(b, DIGITS, MASKED), F.lit("_"))

    return replace_matches(replace_matches(_col(c), YEAR, mask), VERSION, mask)


def unprotect(c: Column) -> Column:
    """protect() undone."""
    return let(c, lambda t: F.when(t.contains("_"), F.translate(F.regexp_replace(t, rf"_([vV]?[{MASKED}][{MASKED}.]*)_", "$1"), MASKED, DIGITS)).otherwise(t))


def convert_numbers(c: Column | str) -> Column:
    """Decimals, ordinals and integers in words; years from 1800 to 2029, versions and numbers over 999,999 stay.

    The fraction of a decimal is read as an integer, so `3.05` comes out as `3.5` does.
    """
    return let(_col(c), lambda t: F.when(t.rlike("[0-9]"), _numbers(t)).otherwise(t))


def _numbers(c: Column) -> Column:
    t = F.regexp_replace(protect(c), DECIMAL, "$1 point $2")
    t = replace_matches(t, ORDINAL, lambda b: let(F.regexp_extract(b, "[0-9]+", 0).try_cast("long"), ordinal))
    t = replace_matches(t, INTEGER, lambda b: let(b.try_cast("long"), cardinal))
    return unprotect(t)


def inject_pauses(c: Column | str) -> Column:
    """A full stop at the end of a paragraph that has no end mark."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"\n\n+", "\n\n"), r"([^.!?\n])\n\n", "$1.\n\n")


def final_cleanup(c: Column | str) -> Column:
    """Without markdown signs, runs of spaces and outer white space."""
    return strip(F.regexp_replace(F.translate(_col(c), "#*_`~", ""), "  +", " "))


def preprocess_for_speech(c: Column | str, abbreviations: bool = True, numbers: bool = True, pauses: bool = True) -> Column:
    """All stages in order; each has a switch of its own."""
    t = _col(c)
    t = expand_abbreviations(t) if abbreviations else t
    t = convert_numbers(t) if numbers else t
    t = inject_pauses(t) if pauses else t
    return final_cleanup(t)
