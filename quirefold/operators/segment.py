"""Chapters from pages: bookmarks, font sizes, heading patterns, fixed blocks, and their cascade.

A page relation has book_id, page_idx (from 0) and text; doubled rows count once (of differing copies
the least text) and null texts as empty. A chapter relation has book_id, chapter_idx (from 1), title,
text, page_start and page_end.

Every method first places pages in chapters on relations without texts: book_id, page_idx, chapter_idx
and, on one row of each chapter at least, title, page_start and page_end. Then the texts join once and
one ordered aggregate makes the chapters.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_text, lines, strip
from ..functions.naming import part_title
from .lineage import checkpointed
from .scan import running_sum

LOG = logging.getLogger("quirefold.segment")

# What a chapter's heading line begins with.
HEADING = (
    r"(?i)\A(?:"
    r"chapter\s+(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|[ivxlcdm]+)"
    r"|part\s+(?:\d+|one|two|three|four|five|[ivxlcdm]+)"
    r"|prologue|epilogue|introduction|preface|afterword|foreword|acknowledgements?|conclusion|appendix"
    r")(?![\p{L}\p{N}_])"
)
METHODS = ("bookmarks", "font_size", "pattern", "page_split")
PAGES_PER_PART = 20
FIRST_LINES = 5
#: A heading's size against the body's; glyphs of one line lie closer than this.
SCALE, LINE_BAND = 1.4, 5


def unique_pages(pages: DataFrame) -> DataFrame:
    """One row for each page of each book; of differing copies the least text, null as empty."""
    known = pages.where("book_id is not null and page_idx is not null")
    return known.groupBy("book_id", "page_idx").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id").agg((F.max("page_idx") + 1).alias("n_pages"))


def first_lines(text: Column | str, most: int = FIRST_LINES) -> Column:
    """The first lines of a page that are not blank, stripped."""
    return F.slice(F.filter(F.transform(lines(text), strip), lambda x: x != ""), 1, most)


def heading_line(text: Column | str) -> Column:
    """The first of these lines that begins like a chapter's heading; null if none does."""
    return F.get(F.filter(first_lines(text), lambda x: x.rlike(HEADING)), F.lit(0))


def page_heads(pages: DataFrame) -> DataFrame:
    """(book_id, page_idx, heading) of each page, without its text.

    Copies of a page that agree on the heading are settled by it alone; of the few that differ the
    texts are compared.
    """
    known = pages.where("book_id is not null and page_idx is not null").select("book_id", "page_idx", "text", heading_line("text").alias("heading"))
    slim = known.groupBy("book_id", "page_idx").agg(F.count("*").alias("n"), F.count("heading").alias("headed"), F.min("heading").alias("heading"), F.max("heading").alias("other"))
    differ = (F.col("headed") > 0) & ((F.col("headed") < F.col("n")) | (F.col("heading") != F.col("other")))
    few = known.join(slim.where(differ).select("book_id", "page_idx"), ["book_id", "page_idx"], "left_semi")
    least = few.groupBy("book_id", "page_idx").agg(F.min_by("heading", F.struct(F.col("text").isNull(), "text")).alias("heading"))
    return slim.where(~differ).select("book_id", "page_idx", "heading").unionAll(least)


def assemble(pages: DataFrame, placed: DataFrame) -> DataFrame:
    """Chapters, with their method, from pages and the placement of pages; a chapter without pages has an empty text.

    placed: book_id, page_idx, chapter_idx, method, title, page_start, page_end; the last three may
    be null but on one row. The texts of a page's copies come together here, where the least one stays.
    """
    texts = pages.select("book_id", "page_idx", "text")
    rows = placed.join(texts, ["book_id", "page_idx"], "left")
    # null texts behind the others, so that the first of a page's copies is the least text
    grouped = rows.groupBy("book_id", "chapter_idx", "method").agg(
        F.max("title").alias("title"), F.max("page_start").alias("page_start"), F.max("page_end").alias("page_end"),
        F.array_sort(F.collect_list(F.when(F.col("page_idx").isNotNull(), F.struct("page_idx", F.col("text").isNull().alias("gone"), "text")))).alias("held"),
    )
    once = F.filter("held", lambda x, i: (i == 0) | (F.get("held", i - 1)["page_idx"] != x["page_idx"]))
    text = F.array_join(F.transform(once, lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n")
    return grouped.select("book_id", F.col("chapter_idx").cast("int"), "title", clean_text(text).alias("text"), F.col("page_start").cast("int"), F.col("page_end").cast("int"), "method")


def place_by_starts(titled: DataFrame) -> DataFrame:
    """Placement by starts: titled has book_id, page_idx, method and title, which is null but where a chapter begins; pages before the first are left out."""
    placed = running_sum(titled, "book_id", "page_idx", F.when(F.col("title").isNotNull(), 1).otherwise(0), "chapter_idx").where("chapter_idx > 0")
    return placed.select("book_id", "page_idx", "chapter_idx", "method", "title", F.when(F.col("title").isNotNull(), F.col("page_idx") + 1).alias("page_start"), (F.col("page_idx") + 1).alias("page_end"))


def place_by_blocks(heads: DataFrame, size: int, method: Column) -> DataFrame:
    """Placement in blocks of `size` pages."""
    number = (F.floor(F.col("page_idx") / size) + 1).cast("int")
    first = F.col("page_idx") - F.pmod("page_idx", F.lit(size)) + 1
    return heads.select("book_id", "page_idx", number.alias("chapter_idx"), method.alias("method"), part_title(number).alias("title"), first.alias("page_start"), (F.col("page_idx") + 1).alias("page_end"))


def place_whole(heads: DataFrame, method: Column) -> DataFrame:
    """All pages in one chapter titled Book."""
    none = F.lit(None).cast("int")
    return heads.select("book_id", "page_idx", F.lit(1).alias("chapter_idx"), method.alias("method"), F.lit("Book").alias("title"), none.alias("page_start"), none.alias("page_end"))


def place_by_bookmarks(counts: DataFrame, top: DataFrame) -> DataFrame:
    """Placement between the pages of entries, in the order of the entries; top: book_id, ord, title, start; counts: book_id, n_pages.

    Of entries on one page all but the last hold no page, as do entries that point backwards: they
    have one row with a null page.
    """
    numbered = running_sum(top, "book_id", "ord", F.lit(1), "chapter_idx")
    following = numbered.select("book_id", (F.col("chapter_idx") - 1).alias("chapter_idx"), F.col("start").alias("following"))
    spans = numbered.join(following, ["book_id", "chapter_idx"], "left").join(counts, "book_id").withColumn("until", F.coalesce("following", "n_pages").cast("int"))
    held = F.when(F.least("until", "n_pages") > F.col("start"), F.sequence("start", F.least("until", "n_pages") - 1))
    return spans.select("book_id", F.explode_outer(held).alias("page_idx"), "chapter_idx", F.lit("bookmarks").alias("method"), "title", (F.col("start") + 1).alias("page_start"), F.col("until").alias("page_end"))


def at_least_two(starts: DataFrame) -> DataFrame:
    """(book_id) of the books with two rows or more."""
    return starts.groupBy("book_id").count().where("count >= 2").select("book_id")


def by_starts(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """Chapters that begin at the pages of starts (book_id, page_idx, title) and reach to the next; pages before the first are left out.

    A book with fewer than two starts gives nothing. A page has one start at most.
    """
    listed = pages.where("book_id is not null and page_idx is not null").select("book_id", "page_idx").distinct()
    titled = listed.join(at_least_two(starts), "book_id", "left_semi").join(starts.select("book_id", "page_idx", "title"), ["book_id", "page_idx"], "left")
    return assemble(pages, place_by_starts(titled.withColumn("method", F.lit("starts")))).drop("method")


def pattern_chapters(pages: DataFrame) -> DataFrame:
    """Chapters that begin at pages with a heading line among their first lines."""
    heads = checkpointed(page_heads(pages))
    titled = heads.join(at_least_two(heads.where("heading is not null")), "book_id", "left_semi")
    return assemble(pages, place_by_starts(titled.select("book_id", "page_idx", F.lit("pattern").alias("method"), F.col("heading").alias("title")))).drop("method")


def top_entries(toc: DataFrame) -> DataFrame:
    """Top-level entries of tables of contents with their page from 0; pages below 1 count as the first; doubled rows once."""
    top = toc.where("level = 1 and book_id is not null and ord is not null")
    one = top.groupBy("book_id", "ord").agg(F.min_by("title", F.struct("page", "title")).alias("title"), F.min("page").alias("page"))
    return one.select("book_id", "ord", strip(F.coalesce("title", F.lit(""))).alias("title"), F.greatest(F.coalesce(F.col("page") - 1, F.lit(0)), F.lit(0)).alias("start"))


def bookmark_chapters(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapters between the pages of the top-level entries, in the order of the entries.

    Of entries on one page all but the last have an empty text, as have entries that point backwards.
    Books with fewer than two entries give nothing.
    """
    top = checkpointed(top_entries(toc))
    return assemble(pages, place_by_bookmarks(page_counts(pages), top.join(at_least_two(top), "book_id", "left_semi"))).drop("method")


def font_headings(glyphs: DataFrame) -> DataFrame:
    """(book_id, page_idx, title): on each page the first line of glyphs far larger than the book's body text.

    The body's size is the most frequent size, rounded half to even; of equally frequent ones the
    first seen. glyphs: book_id, page_idx, ord, size, top, x0, text.
    """
    sized = glyphs.where("size is not null and size <> 0")
    counts = sized.groupBy("book_id", F.bround("size").alias("rounded")).agg(F.count("*").alias("n"), F.min(F.struct("page_idx", "ord")).alias("seen"))
    best = counts.groupBy("book_id").agg(F.max("n").alias("n"))
    body = counts.join(best, ["book_id", "n"]).groupBy("book_id").agg(F.min_by("rounded", "seen").alias("body"))
    large = sized.join(body, "book_id").where(F.col("size") >= F.col("body") * SCALE)
    tops = large.groupBy("book_id", "page_idx").agg(F.min("top").alias("first_top"))
    line = large.join(tops, ["book_id", "page_idx"]).where(F.abs(F.col("top") - F.col("first_top")) < LINE_BAND)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "ord", "text"))), lambda x: x["text"]), "")
    return line.groupBy("book_id", "page_idx").agg(strip(text).alias("title")).where(F.length("title") > 2)


def font_chapters(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    return by_starts(pages, font_headings(glyphs))


def _listed(pages: DataFrame) -> DataFrame:
    """Pages without their texts; copies do no harm where they all go to one chapter."""
    return pages.where("book_id is not null and page_idx is not null").select("book_id", "page_idx").distinct()


def page_split(pages: DataFrame, size: int = PAGES_PER_PART) -> DataFrame:
    """Blocks of `size` pages, the last one shorter."""
    return assemble(pages, place_by_blocks(_listed(pages), size, F.lit("page_split"))).drop("method")


def whole_book(pages: DataFrame) -> DataFrame:
    """One chapter titled Book over all pages."""
    return assemble(pages, place_whole(_listed(pages), F.lit("none"))).drop("method")


def cascade(pages: DataFrame, toc: DataFrame | None = None, glyphs: DataFrame | None = None, methods: tuple[str, ...] = METHODS, size: int = PAGES_PER_PART) -> DataFrame:
    """For each book the chapters of the first method that finds any, with the method; unknown methods are passed over.

    Headings of pages are read once. Which method a book goes to, and which chapter each page, is settled
    on relations without texts, whatever the number of methods; the texts join once, at the end.
    """
    heads = checkpointed(page_heads(pages))
    counts = heads.groupBy("book_id").agg((F.max("page_idx") + 1).alias("n_pages"), F.count("heading").alias("pattern"))
    top = fonts = None
    named = {}
    if "bookmarks" in methods and toc is not None:
        top = top_entries(toc)
        counts = counts.join(top.groupBy("book_id").agg(F.count("*").alias("bookmarks")), "book_id", "left")
        named["bookmarks"] = F.col("bookmarks") >= 2
    if "font_size" in methods and glyphs is not None:
        try:
            fonts = checkpointed(font_headings(glyphs))
            counts = counts.join(fonts.groupBy("book_id").agg(F.count("*").alias("font_size")), "book_id", "left")
            named["font_size"] = F.col("font_size") >= 2
        except Exception as e:  # noqa: BLE001  whatever glyphs raise, the next method goes on
            LOG.warning("font_size is passed over: %s", e)
    named["pattern"] = F.col("pattern") >= 2
    named["page_split"] = F.lit(True)
    method = F.when(F.lit(False), F.lit(""))
    for name in methods:
        if name in named:
            method = method.when(named[name], F.lit(name))
    chosen = checkpointed(counts.select("book_id", "n_pages", method.otherwise(F.lit("none")).alias("method")))
    rows = heads.join(chosen.select("book_id", "method"), "book_id")
    title = F.when(F.col("method") == "pattern", F.col("heading"))
    started = rows.where("method in ('pattern', 'font_size')")
    if fonts is not None:
        started = started.join(fonts.withColumnRenamed("title", "font"), ["book_id", "page_idx"], "left")
        title = title.otherwise(F.col("font"))
    placed = place_by_starts(started.select("book_id", "page_idx", "method", title.alias("title")))
    placed = placed.unionByName(place_by_blocks(rows.where("method = 'page_split'"), size, F.lit("page_split"))).unionByName(place_whole(rows.where("method = 'none'"), F.lit("none")))
    if top is not None:
        marked = chosen.where("method = 'bookmarks'")
        placed = placed.unionByName(place_by_bookmarks(marked.select("book_id", "n_pages"), top.join(marked.select("book_id"), "book_id", "left_semi")))
    return assemble(pages, checkpointed(placed))
