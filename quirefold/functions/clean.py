"""Cleaning of extracted text, as columns. Null stays null, empty stays empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import LINE_END, SPACES, WS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(_col(c), F.lit(SPACES))


def dehyphenate(c: Column | str) -> Column:
    """A hyphen, white space with a line feed: the word goes on; both are deleted."""
    return F.regexp_replace(_col(c), rf"-{WS}*\n{WS}*", "")


def normalize_quotes(c: Column | str) -> Column:
    """Curly quotation marks to straight ones, en dash to a hyphen, em dash to ` -- `, the ellipsis to three dots."""
    plain = F.translate(_col(c), "‘’“”–", "''\"\"-")
    return F.replace(F.replace(plain, F.lit("—"), F.lit(" -- ")), F.lit("…"), F.lit("..."))


def lines(c: Column | str) -> Column:
    """Lines without their ends; an end at the very end makes no further line."""
    return let(F.split(_col(c), LINE_END, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def drop_artifacts(c: Column | str, keep_blank_lines: bool = False) -> Column:
    """Without bare page numbers (one to four digits) and lines under four characters that hold no .!?

    Blank lines count among the short ones, so paragraph breaks go too, unless keep_blank_lines.
    """

    def stays(line: Column) -> Column:
        def of(s: Column) -> Column:
            long = ~s.rlike(r"\A\d{1,4}\z") & ((F.length(s) >= 4) | s.rlike(r"[.!?]"))
            return long | (s == "") if keep_blank_lines else long

        return let(strip(line), of)

    return F.array_join(F.filter(lines(c), stays), "\n")


def collapse_whitespace(c: Column | str) -> Column:
    """At most one empty line in a row; no blanks or tabs before a line feed."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"\n{3,}", "\n\n"), r"[ \t]+\n", "\n")


def clean_text(c: Column | str, keep_blank_lines: bool = False) -> Column:
    """The whole cleaning, in the reference's order."""
    return strip(collapse_whitespace(drop_artifacts(normalize_quotes(dehyphenate(c)), keep_blank_lines)))
