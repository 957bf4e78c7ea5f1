"""From files to books and chapters in one call: each format's extractor gives the same two relations."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import suffix
from ..operators import books, segment, spine
from ..operators.lineage import checkpointed
from .ebooks import convert, read_epub
from .settings import Settings

LOG = logging.getLogger("quirefold.extract")
#: A decoder turns a file's bytes into the texts of its pages, in order.
Decoder = Callable[[bytes], Iterator[str]]


def form_feeds(data: bytes) -> Iterator[str]:
    """Pages of a plain text, between form feeds."""
    yield from data.decode("utf-8", "replace").split("\f")


#: Page decoders by suffix; a PDF library's is registered here by who has one.
DECODERS: dict[str, Decoder] = {".txt": form_feeds}


def read_pages(spark: SparkSession, path: str, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """(source_path, page_idx, text, error) of all files under a path; a file that can't be decoded gives one row with its error and no page."""
    known = dict(DECODERS if decoders is None else decoders)
    files = spark.read.format("binaryFile").load(path).select("path", "content").where(suffix("path").isin(*known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    rows = [(p, i, t, None) for i, t in enumerate(known[p[p.rindex(".") :].lower()](bytes(c)))]
                except Exception as e:  # noqa: BLE001  whatever a decoder raises stays with its file
                    rows = [(p, None, None, f"{type(e).__name__}: {e}"[:2000])]
                yield pd.DataFrame(rows, columns=["source_path", "page_idx", "text", "error"]).astype({"page_idx": "Int32"})

    return files.mapInPandas(run, "source_path string, page_idx int, text string, error string")


def _keyed(files: DataFrame) -> DataFrame:
    """source_path and its book_id, a digest of the path."""
    return files.select("source_path").distinct().withColumn("book_id", F.xxhash64("source_path"))


def from_pages(spark: SparkSession, path: str, settings: Settings = Settings(), decoders: dict[str, Decoder] | None = None) -> tuple[DataFrame, DataFrame]:
    """Books (book_id, title, author, source_path) and chapters of files with pages, by the settings' methods."""
    pages = checkpointed(read_pages(spark, path, decoders))
    keys = _keyed(pages.where("error is null"))
    made = segment.cascade(pages.where("page_idx is not null").join(keys, "source_path").select("book_id", "page_idx", "text"), methods=settings.methods, size=settings.page_split_size)
    none = F.lit(None).cast("string")
    return books.with_defaults(keys.withColumn("title", none).withColumn("author", none)), made.drop("method")


def from_epub(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Books and chapters of EPUB files: spine order, titles of the table of contents, all text in one chapter where no part is long enough."""
    rows = checkpointed(read_epub(spark, path))
    keys = _keyed(rows.where("kind <> 'error'"))
    rows = rows.join(keys, "source_path")
    meta = books.first_metadata(rows.where("kind = 'meta'").select("book_id", F.col("name").alias("field"), "ord", F.col("title").alias("value")))
    named = meta.groupBy("book_id").agg(F.max(F.when(F.col("field") == "title", F.col("value"))).alias("title"), F.max(F.when(F.col("field") == "creator", F.col("value"))).alias("author"))
    found = books.with_defaults(keys.join(named, "book_id", "left"))
    items = rows.where("kind = 'item'").select("book_id", "item_id", "name", "media_type", "content")
    order = rows.where("kind = 'spine'").select("book_id", "ord", "item_id")
    links = rows.where("kind = 'toc'").select("book_id", "ord", F.col("name").alias("href"), "title")
    made = spine.spine_chapters(order, items, links)
    rest = spine.fallback_chapters(made, items, found)
    none = F.lit(None).cast("int")
    return found, made.unionByName(rest).withColumn("page_start", none).withColumn("page_end", none)


def extract(spark: SparkSession, path: str, settings: Settings = Settings(), decoders: dict[str, Decoder] | None = None) -> tuple[DataFrame, DataFrame]:
    """Books and chapters of a file or a folder, by its format: `.epub`; what has a page decoder; `.mobi`, `.azw3` and `.azw` (one file) after conversion.

    An error for other formats, before anything is read.
    """
    known = DECODERS if decoders is None else decoders
    last = path[path.rindex(".") :].lower() if "." in path.rpartition("/")[2] else ""
    LOG.info("reading %s", path)
    if last in (".mobi", ".azw3", ".azw"):
        return from_epub(spark, convert(path))
    if last == ".epub":
        return from_epub(spark, path)
    if last in known:
        return from_pages(spark, path, settings, known)
    raise ValueError(f"unsupported format: {last or path}")
