"""Chapter markers, pending work and manifests of rendered chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running_sum


def duration(c: Column | str) -> Column:
    """Seconds as a number; what is none counts 0."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast("double"), F.lit(0.0))


def latest(df: DataFrame, keys: list[str], by: list[str], keep: list[str] | None = None) -> DataFrame:
    """Of the rows with the same keys the one loaded last, with the columns in keep (all others by default): doubled and late rows count once.

    What is kept goes through the exchange: keep names and counts, not texts; of texts see latest_texts().
    """
    rest = keep if keep is not None else [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__row")).select(*keys, "__row.*")


def latest_texts(df: DataFrame, keys: list[str], by: list[str], id: str = "chapter_id") -> DataFrame:
    """As latest(), for rows with long texts and an id each: the few rows that a later one replaces are taken out, the texts stay where they are.

    Keys, order and id alone are aggregated; the anti join broadcasts the ids that go as long as they are few.
    """
    slim = df.select(*keys, *dict.fromkeys([*by, id]))
    last = slim.groupBy(*keys).agg(F.count("*").alias("__n"), F.max_by(id, F.struct(*by)).alias("__last")).where("__n > 1").drop("__n")
    gone = slim.join(last, keys).where(F.col(id) != F.col("__last")).select(id)
    return df.join(gone, id, "left_anti")


def chapter_markers(chapters: DataFrame, renders: DataFrame) -> DataFrame:
    """(book_id, chapter_idx, title, start_ms, end_ms): where each rendered chapter lies in its book's recording.

    Milliseconds are cut off chapter by chapter, then added up. Unrendered chapters take no room.
    """
    ms = (duration("duration_s") * 1000).cast("long")
    timed = chapters.select("book_id", "chapter_idx", "title").join(renders.select("book_id", "chapter_idx", ms.alias("ms")), ["book_id", "chapter_idx"])
    return running_sum(timed, "book_id", "chapter_idx", F.col("ms"), "end_ms").select("book_id", "chapter_idx", "title", (F.col("end_ms") - F.col("ms")).alias("start_ms"), "end_ms")


def metadata_document(markers: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, document): the FFMETADATA text of each book with more than one marker."""
    entry = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), F.coalesce("title", F.lit("")), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chapter_idx", entry.alias("e")))), lambda x: x["e"])
    grouped = markers.groupBy("book_id").agg(F.array_join(parts, "\n").alias("entries"), F.count("*").alias("n")).where("n > 1")
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), F.coalesce("title", F.lit("")), F.lit("\nartist="), F.coalesce("author", F.lit("")), F.lit("\n\n"))
    return grouped.join(books.select("book_id", "title", "author"), "book_id").select("book_id", F.concat(head, F.col("entries")).alias("document"))


def concat_list(renders: DataFrame) -> DataFrame:
    """(book_id, document): the list of files for joining, in chapter order, quotes escaped."""
    line = F.concat(F.lit("file '"), F.replace("path", F.lit("'"), F.lit("'\\''")), F.lit("'"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chapter_idx", line.alias("e")))), lambda x: x["e"])
    return renders.where("path is not null").groupBy("book_id").agg(F.array_join(parts, "\n").alias("document"))


def pending(chapters: DataFrame, done: DataFrame) -> DataFrame:
    """Chapters without a finished recording."""
    return chapters.join(done.select("book_id", "chapter_idx").distinct(), ["book_id", "chapter_idx"], "left_anti")


def manifest(chapters: DataFrame, done: DataFrame) -> DataFrame:
    """All chapters, finished or not, with that state."""
    state = done.select("book_id", "chapter_idx").distinct().withColumn("is_done", F.lit(True))
    return chapters.join(state, ["book_id", "chapter_idx"], "left").withColumn("is_done", F.coalesce("is_done", F.lit(False)))


def bundles(chapters: DataFrame) -> DataFrame:
    """Books with more than one chapter."""
    return chapters.groupBy("book_id").agg(F.count("*").alias("n_chapters")).where("n_chapters > 1")
