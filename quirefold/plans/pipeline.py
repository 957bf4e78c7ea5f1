"""The dry run from chapters to chunks, its options, and its sinks."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.chunk import chunks as chunk_array
from ..functions.clean import clean_text
from ..functions.naming import chunk_file, slug, word_count
from ..functions.speech import preprocess_for_speech
from ..operators.synth import backend, render
from ..operators.timeline import pending
from ..sources.settings import Settings

LOG = logging.getLogger("quirefold.pipeline")


def only_chapter(chapters: DataFrame, number: int | None) -> DataFrame:
    """One chapter of each book; all without a number."""
    return chapters if number is None else chapters.where(F.col("chapter_idx") == number)


def spoken(chapters: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """chapters with text cleaned and normalised for speech."""
    flags = {"abbreviations": settings.expand_abbreviations, "numbers": settings.convert_numbers, "pauses": settings.inject_pauses}
    clean = clean_text("text", settings.keep_blank_lines)
    return chapters.withColumn("text", preprocess_for_speech(clean, **flags) if any(flags.values()) else clean)


def chunked(chapters: DataFrame, keys: tuple[str, ...] = ("book_id", "chapter_idx"), size: int = 1000) -> DataFrame:
    """One row for each chunk: keys, chunk_idx from 0, text, n_chars, n_words, file. Empty chapters give none."""
    out = chapters.select(*keys, F.posexplode(chunk_array("text", size)).alias("chunk_idx", "text"))
    return out.select(*keys, "chunk_idx", "text", F.length("text").alias("n_chars"), word_count("text").alias("n_words"), chunk_file("chunk_idx").alias("file"))


def listing(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_idx, title, n_words) of all chapters: what can be asked for."""
    return chapters.select("book_id", "chapter_idx", "title", F.coalesce(word_count("text"), F.lit(0)).alias("n_words"))


def require_chapter(chapters: DataFrame, number: int) -> DataFrame:
    """The chapters of this number; an error, which names some that are there, where no book has one."""
    found = only_chapter(chapters, number)
    if found.isEmpty():
        there = [r[0] for r in chapters.select("chapter_idx").where("chapter_idx is not null").distinct().orderBy("chapter_idx").limit(20).collect()]
        raise ValueError(f"no chapter {number}; there are {there}")
    return found


def run(chapters: DataFrame, settings: Settings = Settings(), chapter: int | None = None, done: DataFrame | None = None, watch: Observation | None = None) -> DataFrame:
    """Chapters (book_id, chapter_idx, title, text) to chunks, without those that are done.

    With watch, the run's progress can be read from it once the chunks are written: chunks, characters and words.
    """
    LOG.info("chunks of %s characters%s", settings.chunk_size, "" if chapter is None else f" of chapter {chapter}")
    picked = only_chapter(chapters, chapter)
    out = chunked(spoken(pending(picked, done) if done is not None else picked, settings), size=settings.chunk_size)
    return out if watch is None else out.observe(watch, F.count(F.lit(1)).alias("chunks"), F.sum("n_chars").alias("chars"), F.sum("n_words").alias("words"))


def rendered(chapters: DataFrame, settings: Settings = Settings(), chapter: int | None = None, done: DataFrame | None = None, reference: bytes | None = None, watch: Observation | None = None) -> DataFrame:
    """The sound of each chunk by the settings' backend; an unknown backend is an error before anything runs."""
    backend(settings.backend)
    LOG.info("rendering by %s in voice %s", settings.backend, settings.voice)
    return render(run(chapters, settings, chapter, done, watch), settings.backend, reference)


def verbose(on: bool = True) -> None:
    """What the package logs: everything, or what is of note."""
    logging.getLogger("quirefold").setLevel(logging.DEBUG if on else logging.INFO)


def write_tables(df: DataFrame, path: str) -> None:
    """The canonical sink: Parquet, written in whole."""
    df.write.mode("overwrite").parquet(path)


def write_texts(chapters: DataFrame, path: str) -> None:
    """One text file's worth of rows for each chapter, in a folder named by its slug, for reading by people."""
    named = chapters.select(F.col("book_id").cast("string").alias("book"), slug("chapter_idx", "title").alias("chapter"), F.coalesce("text", F.lit("")).alias("value"))
    named.write.mode("overwrite").partitionBy("book", "chapter").text(path)
