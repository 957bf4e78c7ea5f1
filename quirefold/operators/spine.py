"""Chapters from the parts of an e-book: spine order, titles, a least length, and the fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_text
from ..functions.html import heading, href_base, html_to_text
from ..functions.naming import chapter_title, word_count
from .lineage import checkpointed
from .scan import running_sum

LEAST_WORDS = 50
DOCUMENT = "application/xhtml+xml"


def flatten_toc(nested: DataFrame, depth: int = 4) -> DataFrame:
    """(book_id, ord, href, title) of the leaves of nested tables of contents.

    nested: book_id and nodes, an array of structs (ord, href, title, nodes) that nest up to `depth`
    levels; sections, which have nodes, give no row of their own.
    """
    level, out = nested.select("book_id", F.explode("nodes").alias("n")), None
    for _ in range(depth):
        names = level.schema["n"].dataType.names
        leaf = level.where(F.size("n.nodes") <= 0) if "nodes" in names else level
        part = leaf.select("book_id", "n.ord", "n.href", "n.title")
        out = part if out is None else out.unionAll(part)
        if "nodes" not in names:
            break
        level = level.where(F.size("n.nodes") > 0).select("book_id", F.explode("n.nodes").alias("n"))
    return out


def toc_titles(links: DataFrame) -> DataFrame:
    """(book_id, href, title): of links to one file the last title; fragments are cut off."""
    return links.groupBy("book_id", href_base("href").alias("href")).agg(F.max_by("title", "ord").alias("title"))


def spine_chapters(spine: DataFrame, items: DataFrame, links: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Chapters in spine order: documents with at least `least` words after cleaning.

    Title: that of the table of contents, else the first heading, else `Chapter n`; empty ones fall through.
    """
    read = items.where(F.col("media_type") == DOCUMENT).select("book_id", "item_id", "name", heading("content").alias("own"), clean_text(html_to_text("content")).alias("text"))
    # each document is read once; numbers need the order of those that are long enough, without their texts
    long = checkpointed(read.where(word_count("text") >= least))
    order = spine.join(long.select("book_id", "item_id", "name", "own"), ["book_id", "item_id"])
    numbers = running_sum(order, "book_id", "ord", F.lit(1), "chapter_idx").withColumn("chapter_idx", F.col("chapter_idx").cast("int"))
    named = numbers.join(toc_titles(links).withColumnsRenamed({"href": "name", "title": "listed"}), ["book_id", "name"], "left")
    title = F.coalesce(F.nullif("listed", F.lit("")), "own", chapter_title("chapter_idx"))
    return named.select("book_id", "item_id", "chapter_idx", title.alias("title")).join(long.select("book_id", "item_id", "text"), ["book_id", "item_id"]).select("book_id", "chapter_idx", "title", "text")


def fallback_chapters(chapters: DataFrame, items: DataFrame, books: DataFrame) -> DataFrame:
    """For books without chapters one chapter with all documents in manifest order, titled as the book."""
    rest = items.where(F.col("media_type") == DOCUMENT).join(chapters.select("book_id").distinct(), "book_id", "left_anti")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("item_id", html_to_text("content").alias("t")))), lambda x: x["t"])
    texts = rest.groupBy("book_id").agg(F.array_join(parts, " ").alias("text"))
    return texts.join(books.select("book_id", "title"), "book_id").select("book_id", F.lit(1).alias("chapter_idx"), "title", clean_text("text").alias("text"))
