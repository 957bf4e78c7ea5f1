"""Names, labels and counts of chapters, books and chunks, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import _col
from .patterns import NOT_WS


def word_count(c: Column | str) -> Column:
    """Runs of visible characters; 0 for blank text, null for null."""
    return F.size(F.regexp_extract_all(_col(c), F.lit(f"{NOT_WS}+"), F.lit(0)))


def slug(index: Column | str, title: Column | str) -> Column:
    """`02_title_in_lower_case`: letters, digits and spaces are kept, spaces become one underscore."""
    kept = F.trim(F.regexp_replace(F.lower(_col(title)), r"[^\p{L}\p{N} ]", ""))
    return F.concat(F.lpad(_col(index).cast("string"), F.greatest(F.length(_col(index).cast("string")), F.lit(2)), F.lit("0")), F.lit("_"), F.regexp_replace(kept, " +", "_"))


def part_title(n: Column | str) -> Column:
    return F.concat(F.lit("Part "), _col(n).cast("string"))


def chapter_title(n: Column | str) -> Column:
    return F.concat(F.lit("Chapter "), _col(n).cast("string"))


def thousands(n: Column | str) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(_col(n), 0)


def chunk_file(n: Column | str) -> Column:
    """File name of the chunk with this number, counted from 0."""
    return F.format_string("chunk_%04d.wav", _col(n).cast("int"))


def file_stem(path: Column | str) -> Column:
    name = F.regexp_extract(_col(path), r"([^/]*)\z", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")


def output_path(directory: Column | str, stem: Column, index: Column, title: Column, extension: str = "mp3") -> Column:
    """`directory/stem/02_title.mp3`."""
    return F.concat_ws("/", _col(directory), stem, F.concat(slug(index, title), F.lit(f".{extension}")))


def sample_payload(content: Column | str) -> Column:
    """A voice sample's bytes for transport."""
    return F.base64(_col(content))


def suffix(path: Column | str) -> Column:
    """The last suffix of a path's file name in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(_col(path), r"[^/](\.[^./]+)\z", 1))
