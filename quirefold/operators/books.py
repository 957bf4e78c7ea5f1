"""Book-level relations: metadata with defaults, summaries, formats, voices, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import strip
from ..functions.naming import file_stem, suffix, thousands, word_count

# Suffixes and the extractor they go to.
FORMATS = {".pdf": "pdf", ".epub": "epub", ".mobi": "epub", ".azw3": "epub", ".azw": "epub"}


def extractor(path: Column | str, fail: bool = False) -> Column:
    """Which extractor reads a file; null, or with fail an error, for other suffixes."""
    s = suffix(path)
    out = F.when(F.lit(False), F.lit(""))
    for a, b in FORMATS.items():
        out = out.when(s == a, F.lit(b))
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), F.coalesce(s, F.lit(""))))) if fail else out


def with_defaults(books: DataFrame) -> DataFrame:
    """Titles and authors stripped; missing ones are the file's stem (for PDF `Unknown Title`) and `Unknown Author`."""
    blank = lambda c: F.nullif(strip(c), F.lit(""))
    title = F.coalesce(blank("title"), F.when(suffix("source_path") == ".pdf", F.lit("Unknown Title")).otherwise(file_stem("source_path")))
    return books.select("book_id", title.alias("title"), F.coalesce(blank("author"), F.lit("Unknown Author")).alias("author"), "source_path")


def first_metadata(meta: DataFrame) -> DataFrame:
    """(book_id, field, value): of several values of a field the first."""
    return meta.groupBy("book_id", "field").agg(F.min_by("value", "ord").alias("value"))


def counted(chapters: DataFrame) -> DataFrame:
    """chapters with n_words instead of their text, so that no text goes into an exchange; as they are if they have n_words."""
    return chapters if "n_words" in chapters.columns else chapters.withColumn("n_words", F.coalesce(word_count("text"), F.lit(0))).drop("text")


def totals(chapters: DataFrame) -> DataFrame:
    """(book_id, n_chapters, n_words); chapters has text or n_words."""
    return counted(chapters).groupBy("book_id").agg(F.count("*").alias("n_chapters"), F.sum("n_words").alias("n_words"))


def summary(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, summary): the printed overview of each book with chapters; chapters has text or n_words."""
    chapters = counted(chapters)
    words = F.col("n_words")
    line = F.concat(F.lit("  ["), F.lpad(F.col("chapter_idx").cast("string"), F.greatest(F.length(F.col("chapter_idx").cast("string")), F.lit(2)), F.lit("0")), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), thousands(words), F.lit(" words)"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chapter_idx", line.alias("e")))), lambda x: x["e"])
    grouped = chapters.groupBy("book_id").agg(F.count("*").alias("n"), F.sum(words).alias("w"), F.array_join(parts, "\n").alias("ls"))
    name = F.regexp_extract("source_path", r"([^/]*)\z", 1)
    text = F.concat(F.lit("Book:     "), "title", F.lit("\nAuthor:   "), "author", F.lit("\nSource:   "), name, F.lit("\nChapters: "), F.col("n").cast("string"), F.lit("\nWords:    "), thousands("w"), F.lit("\n"), "ls")
    return grouped.join(with_defaults(books), "book_id").select("book_id", text.alias("summary"))


def voice_reference(requests: DataFrame, voices: DataFrame, default: str = "default") -> DataFrame:
    """requests (with voice, a name or null) and the reference of that voice, else of the default's name; an empty reference is none.

    The voice table has a handful of rows and is broadcast.
    """
    dim = F.broadcast(voices.select(F.col("name").alias("__name"), F.nullif("reference_audio", F.lit("")).alias("reference")))
    asked = requests.withColumn("__name", F.coalesce(F.nullif("voice", F.lit("")), F.lit(default)))
    return asked.join(dim, "__name", "left").drop("__name")


def voice_problems(requests: DataFrame, voices: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(book_id, voice, problem) of requests whose voice is unknown, or whose reference is not among files (path): these are read in the default voice.

    The caller decides whether to warn or to stop.
    """
    dim = F.broadcast(voices.select(F.col("name").alias("voice"), F.nullif("reference_audio", F.lit("")).alias("reference")))
    asked = requests.where("voice is not null and voice <> ''").join(dim.withColumn("known", F.lit(True)), "voice", "left")
    problem = F.when(F.col("known").isNull(), "unknown voice")
    if files is not None:
        asked = asked.join(files.select(F.col("path").alias("reference"), F.lit(True).alias("there")).distinct(), "reference", "left")
        problem = problem.when(F.col("reference").isNotNull() & F.col("there").isNull(), "missing reference")
    return asked.select("book_id", "voice", problem.alias("problem")).where("problem is not null")


def usage_report(calls: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(book_id, tokens, n_calls) by book, and with a null book the sum of all: what was used, and so what is paid for."""
    return calls.rollup("book_id").agg(F.coalesce(F.sum(F.coalesce(tokens, F.lit(0))), F.lit(0)).cast("long").alias("tokens"), F.count("*").alias("n_calls"))


def usage(calls: DataFrame, tokens: str) -> DataFrame:
    """(total_tokens): the sum over all calls; missing counts are 0."""
    return calls.agg(F.coalesce(F.sum(F.coalesce(tokens, F.lit(0))), F.lit(0)).cast("long").alias("total_tokens"))
