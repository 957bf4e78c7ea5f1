"""Queries by name, each over its whole tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunk, clean, html, naming, numwords, speech
from ..operators import books, segment, spine, synth, timeline
from ..sources.tables import read
from . import oracle as o
from .pipeline import chunked, only_chapter, run, spoken

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(read(spark, sf_dir, "chapter"))


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chapter")


def _text_query(name: str, of: Callable[[Column], Column], sql: Callable[[str], str] | None, source: Callable[[Column], Column] = lambda c: c, source_sql: str = "text") -> None:
    """One text column in, one out, over all chapters."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _chapters(spark, sf_dir).select("chapter_id", of(source(F.col("text"))).alias("result"))

    f.__name__, f.__doc__ = name, f"{name} of every chapter."
    QUERIES[name] = f
    if sql:
        ORACLE[name] = f"SELECT chapter_id, {sql(source_sql)} AS result FROM chapter"


# Inputs that hold what an operator looks for, put before each chapter's own text.
NOISY_SQL = "concat_ws(chr(10), 'some-', '   word', '12', ' 3 ', 'Yes', 'No.', 'a — b… ‘c’', '', '', '', 'tail  ', text)"
SHORTS = "('Dr. Gen. St. no. etc. PA, NY e.g. i.e. approx. vs. TX ' || text)"

COUNTED = "('In 1984 and 2029-2030 v1.2, V2.10x, v3.4.5 and v1. Dr. 3.14 of 3.05 is the 22nd, 111TH and 1000000th; 1984.5, 192.168.1.1, 1,984 of 1234567890.\n\n\n' || text)"


def _noisy(c: Column) -> Column:
    return F.expr(NOISY_SQL)


_text_query("clean_dehyphenate", clean.dehyphenate, o.dehyphenate)
_text_query("clean_quotes", clean.normalize_quotes, o.quotes)
_text_query("clean_lines", lambda c: clean.strip(clean.collapse_whitespace(clean.drop_artifacts(c))), lambda t: o.strip(o.collapse(o.artifacts(t))), _noisy, NOISY_SQL)
_text_query("clean_text", clean.clean_text, o.clean, _noisy, NOISY_SQL)
_text_query("expand_abbreviations", speech.expand_abbreviations, o.abbreviations, lambda c: F.expr(SHORTS), SHORTS)
_text_query("inject_pauses", speech.inject_pauses, o.pauses)
_text_query("final_cleanup", speech.final_cleanup, o.final)
_text_query("protect_years_versions", speech.protect, o.protected, lambda c: F.expr(COUNTED), COUNTED)
_text_query("numbers_in_text", speech.convert_numbers, o.numbers, lambda c: F.expr(COUNTED), COUNTED)
_text_query("speech_pipeline", lambda c: speech.preprocess_for_speech(clean.clean_text(c)), o.spoken, lambda c: F.expr(COUNTED), COUNTED)
_text_query("word_count", naming.word_count, o.word_count)


@query(f"SELECT p_partkey, {o.cardinal('p_partkey')} AS words FROM part")
def number_cardinal(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", numwords.cardinal(F.col("p_partkey")).alias("words"))


@query(f"WITH w AS (SELECT o_orderkey, {o.cardinal('o_orderkey')} AS c FROM orders) SELECT o_orderkey, {o.ordinal('c')} AS words FROM w")
def number_ordinal(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", numwords.ordinal(F.col("o_orderkey")).alias("words"))


@query(f"SELECT chapter_id, CAST(i - 1 AS INTEGER) AS n, s[i] AS sentence FROM (SELECT chapter_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT chapter_id, {o.sentences('text')} AS s FROM chapter WHERE text IS NOT NULL))")
def sentence_split(spark, sf_dir):
    return _chapters(spark, sf_dir).select("chapter_id", F.posexplode(chunk.sentences("text")).alias("n", "sentence"))


@query(f"SELECT chapter_id, CAST(i - 1 AS INTEGER) AS n, s[i] AS clause FROM (SELECT chapter_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT chapter_id, {o.clauses('text')} AS s FROM chapter WHERE text IS NOT NULL))")
def clause_split(spark, sf_dir):
    return _chapters(spark, sf_dir).select("chapter_id", F.posexplode(chunk.clauses("text")).alias("n", "clause"))


def _chunk_sql(most: int) -> str:
    inner = f"SELECT chapter_id, {o.chunks('text', most)} AS s FROM chapter WHERE text IS NOT NULL"
    return f"SELECT chapter_id, CAST(i - 1 AS INTEGER) AS chunk_idx, s[i] AS text, CAST(length(s[i]) AS INTEGER) AS n_chars, {o.word_count('s[i]')} AS n_words, 'chunk_' || lpad(CAST(i - 1 AS VARCHAR), 4, '0') || '.wav' AS file FROM (SELECT chapter_id, s, unnest(generate_series(1, len(s))) AS i FROM ({inner}))"


@query(_chunk_sql(1000))
def chunk_1000(spark, sf_dir):
    return chunked(_chapters(spark, sf_dir), ("chapter_id",), 1000)


@query(_chunk_sql(100))
def chunk_100(spark, sf_dir):
    return chunked(_chapters(spark, sf_dir), ("chapter_id",), 100)


@query(f"SELECT chapter_id, book_id || '/' || {o.slug('chapter_idx', 'title')} || '.mp3' AS path FROM chapter")
def chunk_paths(spark, sf_dir):
    return _chapters(spark, sf_dir).select("chapter_id", F.when(F.col("title").isNotNull(), naming.output_path(F.col("book_id").cast("string"), F.lit(None), F.col("chapter_idx"), F.col("title"))).alias("path"))


@query(f"SELECT chapter_id, {o.slug('chapter_idx', 'title')} AS slug FROM chapter")
def slug(spark, sf_dir):
    return _chapters(spark, sf_dir).select("chapter_id", naming.slug("chapter_idx", "title").alias("slug"))


# -- HTML: a page made of each chapter --------------------------------------------------------

PAGE_SQL = "'<html><head><title>' || coalesce(title, '') || '</title><style>p { }</style></head><body><script>if (a < b) \"</p>\";</script><h1> </h1><h2><b>' || coalesce(title, '') || '</b></h2><!-- note --><div><p>' || replace(replace(text, chr(10) || chr(10), '</p><p class=\"x\">'), chr(10), '<br/>') || '</p><ul><li>Salt &amp; bread&middot;</li></ul></div></body></html>'"


@query(f"SELECT chapter_id, {o.html_text(f'({PAGE_SQL})')} AS result FROM chapter")
def html_to_text(spark, sf_dir):
    return _chapters(spark, sf_dir).withColumn("page", F.expr(PAGE_SQL)).select("chapter_id", html.html_to_text("page").alias("result"))


@query(f"SELECT chapter_id, {o.heading(f'({PAGE_SQL})')} AS result FROM chapter")
def html_heading(spark, sf_dir):
    return _chapters(spark, sf_dir).withColumn("page", F.expr(PAGE_SQL)).select("chapter_id", html.heading("page").alias("result"))


@query("SELECT book_id, chapter_idx, split_part(path || '#t=' || duration_s::VARCHAR, '#', 1) AS base FROM render")
def href_base(spark, sf_dir):
    return read(spark, sf_dir, "render").select("book_id", "chapter_idx", html.href_base(F.concat("path", F.lit("#t="), F.col("duration_s").cast("string"))).alias("base"))


# -- Books and metadata -----------------------------------------------------------------------

SUFFIX_SQL = r"lower(regexp_extract(source_path, '[^/](\.[^./]+)$', 1))"


@query(f"SELECT book_id, CASE {SUFFIX_SQL} WHEN '.pdf' THEN 'pdf' WHEN '.epub' THEN 'epub' WHEN '.mobi' THEN 'epub' WHEN '.azw3' THEN 'epub' WHEN '.azw' THEN 'epub' END AS extractor FROM book")
def format_dispatch(spark, sf_dir):
    return read(spark, sf_dir, "book").select("book_id", books.extractor("source_path").alias("extractor"))


DEFAULTS_SQL = f"SELECT book_id, coalesce(nullif({o.strip('title')}, ''), CASE WHEN {SUFFIX_SQL} = '.pdf' THEN 'Unknown Title' ELSE regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1') END) AS title, coalesce(nullif({o.strip('author')}, ''), 'Unknown Author') AS author, source_path FROM book"


@query(DEFAULTS_SQL)
def metadata_defaults(spark, sf_dir):
    return books.with_defaults(read(spark, sf_dir, "book"))


@query("WITH m AS (SELECT book_id, 'chapter' AS field, chapter_id AS ord, title AS value FROM chapter) SELECT book_id, field, arg_min(value, ord) AS value FROM m WHERE value IS NOT NULL GROUP BY ALL")
def metadata_first(spark, sf_dir):
    meta = _chapters(spark, sf_dir).where("title is not null").select("book_id", F.lit("chapter").alias("field"), F.col("chapter_id").alias("ord"), F.col("title").alias("value"))
    return books.first_metadata(meta)


CHAPTER_KEYS, CHAPTER_ORDER = ["book_id", "chapter_idx"], ["loaded_at", "chapter_id"]


def _latest_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows of a chapter the one loaded last, with its text."""
    return timeline.latest_texts(_chapters(spark, sf_dir), CHAPTER_KEYS, CHAPTER_ORDER)


def _latest_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with their titles alone; texts are not read."""
    return timeline.latest(_chapters(spark, sf_dir), CHAPTER_KEYS, CHAPTER_ORDER, ["title"])


def _latest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with titles and numbers of words."""
    return timeline.latest(books.counted(_chapters(spark, sf_dir)), CHAPTER_KEYS, CHAPTER_ORDER, ["title", "n_words"])


LATEST_SQL = "(SELECT * FROM chapter QUALIFY row_number() OVER (PARTITION BY book_id, chapter_idx ORDER BY loaded_at DESC, chapter_id DESC) = 1)"


@query(f"SELECT book_id, count(*) AS n_chapters, CAST(sum(coalesce({o.word_count('text')}, 0)) AS BIGINT) AS n_words FROM {LATEST_SQL} GROUP BY book_id")
def book_totals(spark, sf_dir):
    return books.totals(_latest_counts(spark, sf_dir))


@query(
    f"WITH d AS ({DEFAULTS_SQL}), c AS (SELECT book_id, count(*) AS n, CAST(sum(w) AS BIGINT) AS w, string_agg('  [' || lpad(CAST(chapter_idx AS VARCHAR), greatest(length(CAST(chapter_idx AS VARCHAR)), 2)::INTEGER, '0') || '] ' || coalesce(title, '') || ' (' || format('{{:,}}', w) || ' words)', chr(10) ORDER BY chapter_idx) AS ls"
    f" FROM (SELECT *, coalesce({o.word_count('text')}, 0) AS w FROM {LATEST_SQL}) GROUP BY book_id)"
    " SELECT book_id, 'Book:     ' || title || chr(10) || 'Author:   ' || author || chr(10) || 'Source:   ' || regexp_extract(source_path, '([^/]*)$', 1) || chr(10) || 'Chapters: ' || n || chr(10) || 'Words:    ' || format('{:,}', w) || chr(10) || ls AS summary FROM c JOIN d USING (book_id)"
)
def book_summary(spark, sf_dir):
    return books.summary(read(spark, sf_dir, "book"), _latest_counts(spark, sf_dir))


@query("SELECT chapter_id, chapter_idx, title FROM chapter WHERE chapter_idx = 2")
def chapter_filter(spark, sf_dir):
    return only_chapter(_chapters(spark, sf_dir), 2).select("chapter_id", "chapter_idx", "title")


@query(
    "WITH r AS (SELECT book_id, CASE book_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'harbour' WHEN 2 THEN 'almanac' ELSE 'nobody' END AS voice FROM book)"
    " SELECT book_id, voice, nullif(reference_audio, '') AS reference FROM r LEFT JOIN voice v ON v.name = coalesce(nullif(r.voice, ''), 'default')"
)
def voice_lookup(spark, sf_dir):
    k = F.col("book_id") % 4
    asked = read(spark, sf_dir, "book").select("book_id", F.when(k == 1, "harbour").when(k == 2, "almanac").when(k == 3, "nobody").alias("voice"))
    return books.voice_reference(asked, read(spark, sf_dir, "voice"))


@query("SELECT CAST(coalesce(sum(coalesce(floor(value), 0)), 0) AS BIGINT) AS total_tokens FROM events")
def usage_total(spark, sf_dir):
    return books.usage(read(spark, sf_dir, "events").select(F.floor("value").alias("tokens")), "tokens")


@query("SELECT book_id, title AS label, left(title, 30) AS short, right(title, 10) AS tail, 'Part ' || book_id AS part, 'Chapter ' || book_id AS chapter FROM book")
def labels(spark, sf_dir):
    return read(spark, sf_dir, "book").select("book_id", F.col("title").alias("label"), F.left("title", F.lit(30)).alias("short"), F.right("title", F.lit(10)).alias("tail"), naming.part_title("book_id").alias("part"), naming.chapter_title("book_id").alias("chapter"))


@query("SELECT name, base64(encode(coalesce(reference_audio, ''))) AS payload FROM voice")
def sample_payload(spark, sf_dir):
    return read(spark, sf_dir, "voice").select("name", naming.sample_payload(F.encode(F.coalesce("reference_audio", F.lit("")), "utf-8")).alias("payload"))


# -- Segmentation -----------------------------------------------------------------------------

PAGES_SQL = "p AS (SELECT book_id, page_idx, coalesce(min(text), '') AS text FROM page GROUP BY ALL)"


def _starts_sql(starts: str) -> str:
    """Chapters of the relation s (book_id, page_idx, title); both CTEs must be there."""
    return (
        f"WITH {PAGES_SQL}, s AS ({starts}), e AS (SELECT *, lead(page_idx) OVER w AS nxt, row_number() OVER w AS chapter_idx FROM s WINDOW w AS (PARTITION BY book_id ORDER BY page_idx) QUALIFY count(*) OVER (PARTITION BY book_id) >= 2),"
        " t AS (SELECT e.book_id, e.chapter_idx, e.title, e.page_idx + 1 AS page_start, max(p.page_idx) + 1 AS page_end, string_agg(p.text, chr(10) || chr(10) ORDER BY p.page_idx) AS text"
        " FROM e JOIN p ON p.book_id = e.book_id AND p.page_idx >= e.page_idx AND (e.nxt IS NULL OR p.page_idx < e.nxt) GROUP BY ALL)"
        f" SELECT book_id, CAST(chapter_idx AS INTEGER) AS chapter_idx, title, {o.clean('text')} AS text, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end FROM t"
    )


FIRST_SQL = f"list_filter(list_transform({o.lines('text')}, lambda l: {o.strip('l')}), lambda l: l <> '')[1:5]"
HEADING_SQL = r"(?i)\A(?:chapter\s+(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|[ivxlcdm]+)|part\s+(?:\d+|one|two|three|four|five|[ivxlcdm]+)|prologue|epilogue|introduction|preface|afterword|foreword|acknowledgements?|conclusion|appendix)(?:[^\p{L}\p{N}_]|\z)"
MARKED = "CASE WHEN page_idx % 5 = 2 THEN 'Chapter ' || (page_idx // 5 + 1) || chr(10) || text ELSE text END"


@query(f"SELECT book_id, page_idx, {FIRST_SQL} AS first_lines FROM (SELECT book_id, page_idx, coalesce(min(text), '') AS text FROM page GROUP BY ALL)")
def page_first_lines(spark, sf_dir):
    return segment.unique_pages(read(spark, sf_dir, "page")).select("book_id", "page_idx", segment.first_lines("text").alias("first_lines"))


def _marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which every fifth begins with a heading line."""
    head = F.concat(F.lit("Chapter "), (F.floor(F.col("page_idx") / 5) + 1).cast("string"), F.lit("\n"), F.col("text"))
    return segment.unique_pages(read(spark, sf_dir, "page")).withColumn("text", F.when(F.col("page_idx") % 5 == 2, head).otherwise(F.col("text")))


MARKED_PAGES = PAGES_SQL.replace("p AS (", "p AS (SELECT book_id, page_idx, " + MARKED + " AS text FROM (") + ")"
PATTERN_STARTS = f"SELECT book_id, page_idx, h[1] AS title FROM (SELECT book_id, page_idx, list_filter({FIRST_SQL}, lambda l: regexp_matches(l, {o.q(HEADING_SQL)})) AS h FROM p) WHERE len(h) > 0"


@query(_starts_sql(PATTERN_STARTS).replace(PAGES_SQL, MARKED_PAGES))
def pattern_chapters(spark, sf_dir):
    return segment.pattern_chapters(_marked_pages(spark, sf_dir))


PARTS_SQL = f"WITH {PAGES_SQL}, b AS (SELECT book_id, page_idx // 20 + 1 AS chapter_idx, string_agg(text, chr(10) || chr(10) ORDER BY page_idx) AS text, min(page_idx) + 1 AS page_start, max(page_idx) + 1 AS page_end FROM p GROUP BY ALL) SELECT book_id, CAST(chapter_idx AS INTEGER) AS chapter_idx, 'Part ' || CAST(chapter_idx AS INTEGER) AS title, {o.clean('text')} AS text, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end FROM b"


@query(PARTS_SQL)
def page_split(spark, sf_dir):
    return segment.page_split(read(spark, sf_dir, "page"))


TOP_SQL = f"SELECT book_id, ord, {o.strip('coalesce(title, chr(32))')} AS title, greatest(coalesce(page - 1, 0), 0) AS start FROM (SELECT book_id, ord, first(title ORDER BY page, title) AS title, min(page) AS page FROM toc WHERE level = 1 GROUP BY ALL)"
BOOKMARK_SQL = (
    f"WITH {PAGES_SQL}, n AS (SELECT book_id, max(page_idx) + 1 AS n_pages FROM p GROUP BY book_id), top AS ({TOP_SQL}),"
    " e AS (SELECT *, lead(start) OVER w AS nxt, row_number() OVER w AS chapter_idx FROM top WINDOW w AS (PARTITION BY book_id ORDER BY ord) QUALIFY count(*) OVER (PARTITION BY book_id) >= 2),"
    " x AS (SELECT e.*, coalesce(nxt, n_pages) AS until FROM e JOIN n USING (book_id)),"
    " t AS (SELECT x.book_id, x.chapter_idx, x.title, x.start, x.until, coalesce(string_agg(p.text, chr(10) || chr(10) ORDER BY p.page_idx), '') AS text FROM x LEFT JOIN p ON p.book_id = x.book_id AND p.page_idx >= x.start AND p.page_idx < x.until GROUP BY ALL)"
    f" SELECT book_id, CAST(chapter_idx AS INTEGER) AS chapter_idx, title, {o.clean('text')} AS text, CAST(start + 1 AS INTEGER) AS page_start, CAST(until AS INTEGER) AS page_end FROM t"
)


@query(BOOKMARK_SQL)
def toc_bookmarks(spark, sf_dir):
    return segment.bookmark_chapters(read(spark, sf_dir, "page"), read(spark, sf_dir, "toc"))


GLYPHS_SQL = "SELECT user_id AS book_id, CAST(event_id % 7 AS INTEGER) AS page_idx, CAST(event_id AS INTEGER) AS ord, CASE WHEN event_id % 5 = 0 THEN 18.25 ELSE 10.0 + (event_id % 3) / 2 END AS size, CAST(event_id % 11 AS DOUBLE) AS top, CAST(event_id % 13 AS DOUBLE) AS x0, chr(CAST(97 + event_id % 26 AS INTEGER)) AS text FROM events"


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs made from events: mostly body sizes, every fifth one large."""
    e = F.col("event_id")
    size = F.when(e % 5 == 0, F.lit(18.25)).otherwise(F.lit(10.0) + (e % 3) / 2)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), (e % 7).cast("int").alias("page_idx"), e.cast("int").alias("ord"), size.alias("size"), (e % 11).cast("double").alias("top"), (e % 13).cast("double").alias("x0"), F.char(F.lit(97) + e % 26).alias("text"))


def _font_sql(glyphs: str) -> str:
    return (
        f"WITH g AS ({glyphs}), c AS (SELECT book_id, round_even(size, 0) AS r, count(*) AS n, min((page_idx, ord)) AS seen FROM g GROUP BY ALL),"
        " b AS (SELECT book_id, first(r ORDER BY n DESC, seen) AS body FROM c GROUP BY book_id), l AS (SELECT g.* FROM g JOIN b USING (book_id) WHERE size >= body * 1.4),"
        " f AS (SELECT *, min(top) OVER (PARTITION BY book_id, page_idx) AS first_top FROM l)"
        f" SELECT * FROM (SELECT book_id, page_idx, {o.strip('t')} AS title FROM (SELECT book_id, page_idx, string_agg(text, '' ORDER BY top, x0, ord) AS t FROM f WHERE abs(top - first_top) < 5 GROUP BY ALL)) WHERE length(title) > 2"
    )


@query(_font_sql(GLYPHS_SQL))
def font_headings(spark, sf_dir):
    return segment.font_headings(_glyphs(spark, sf_dir))


# A third of the books has glyphs, with a large first line on every fourth page.
PAGE_GLYPHS = (
    "SELECT book_id, page_idx, CAST(page_idx * 100 + i AS INTEGER) AS ord, CASE WHEN page_idx % 4 = 1 AND i < 6 THEN 18.0e0 ELSE 10.0e0 END AS size,"
    " CASE WHEN i < 6 THEN 1.0e0 ELSE 20.0e0 + i END AS top, CAST(i AS DOUBLE) AS x0, chr(CAST(96 + i AS INTEGER)) AS text FROM ({}) WHERE book_id % 3 = 0"
)
SQL_GLYPHS = PAGE_GLYPHS.format("SELECT book_id, page_idx, unnest(generate_series(1, 12)) AS i FROM (SELECT DISTINCT book_id, page_idx FROM page)")


def _page_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "page").select("book_id", "page_idx").distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(12))))
    i, large = F.col("i"), (F.col("page_idx") % 4 == 1) & (F.col("i") < 6)
    return rows.where("book_id % 3 = 0").select("book_id", "page_idx", (F.col("page_idx") * 100 + i).cast("int").alias("ord"), F.when(large, 18.0).otherwise(10.0).alias("size"), F.when(i < 6, 1.0).otherwise(20.0 + i).alias("top"), i.cast("double").alias("x0"), F.char(96 + i).alias("text"))


BOOK_SQL = f"WITH {PAGES_SQL}, t AS (SELECT book_id, string_agg(text, chr(10) || chr(10) ORDER BY page_idx) AS text FROM p GROUP BY book_id) SELECT book_id, CAST(1 AS INTEGER) AS chapter_idx, 'Book' AS title, {o.clean('text')} AS text, CAST(NULL AS INTEGER) AS page_start, CAST(NULL AS INTEGER) AS page_end FROM t"


@query(
    f"WITH k AS ({BOOKMARK_SQL}), f AS ({_starts_sql(_font_sql(SQL_GLYPHS))}), m AS ({_starts_sql(PATTERN_STARTS)}), s AS ({PARTS_SQL}),"
    " a AS (SELECT *, 'bookmarks' AS method FROM k UNION ALL SELECT *, 'font_size' FROM f WHERE book_id NOT IN (SELECT book_id FROM k) UNION ALL SELECT *, 'pattern' FROM m WHERE book_id NOT IN (SELECT book_id FROM k UNION SELECT book_id FROM f)"
    " UNION ALL SELECT *, 'page_split' FROM s WHERE book_id NOT IN (SELECT book_id FROM k UNION SELECT book_id FROM f UNION SELECT book_id FROM m)) SELECT * FROM a"
)
def chapter_cascade(spark, sf_dir):
    """All four methods in their order."""
    return segment.cascade(read(spark, sf_dir, "page"), read(spark, sf_dir, "toc"), _page_glyphs(spark, sf_dir))


@query(f"WITH m AS ({_starts_sql(PATTERN_STARTS)}), b AS ({BOOK_SQL}) SELECT *, 'pattern' AS method FROM m UNION ALL SELECT *, 'none' FROM b WHERE book_id NOT IN (SELECT book_id FROM m)".replace(PAGES_SQL, MARKED_PAGES.replace("page_idx % 5 = 2", "page_idx % 5 = 2 AND book_id % 2 = 0")))
def cascade_fallback(spark, sf_dir):
    """An unknown method is passed over; books without headings become one chapter."""
    plain, marked = segment.unique_pages(read(spark, sf_dir, "page")), _marked_pages(spark, sf_dir)
    return segment.cascade(plain.where("book_id % 2 <> 0").unionByName(marked.where("book_id % 2 = 0")), methods=("unknown", "pattern"))


@query(BOOK_SQL)
def whole_book(spark, sf_dir):
    return segment.whole_book(read(spark, sf_dir, "page"))


# -- Spine ------------------------------------------------------------------------------------

ITEMS_SQL = f"(SELECT book_id, CAST(chapter_idx AS VARCHAR) AS item_id, chapter_idx AS ord, 'c' || (chapter_idx % 6) || '.xhtml' AS name, CASE WHEN chapter_idx % 7 = 0 THEN 'image/png' ELSE 'application/xhtml+xml' END AS media_type, {PAGE_SQL} AS content FROM {LATEST_SQL})"
LINKS_SQL = "(SELECT book_id, ord, 'c' || (page % 6) || '.xhtml#p' || page AS href, title FROM (SELECT DISTINCT book_id, ord, title, page FROM toc))"


def _spine(spark: SparkSession, sf_dir: str, page: str = PAGE_SQL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spine, manifest and links made from chapters and tables of contents."""
    items = _latest_chapters(spark, sf_dir).select("book_id", F.col("chapter_idx").cast("string").alias("item_id"), F.col("chapter_idx").alias("ord"), F.expr("'c' || (chapter_idx % 6) || '.xhtml'").alias("name"), F.when(F.col("chapter_idx") % 7 == 0, "image/png").otherwise(spine.DOCUMENT).alias("media_type"), F.expr(page).alias("content"))
    links = read(spark, sf_dir, "toc").select("book_id", "ord", "title", "page").distinct().select("book_id", "ord", F.expr("'c' || (page % 6) || '.xhtml#p' || page").alias("href"), "title")
    return items.select("book_id", "ord", "item_id"), items.drop("ord"), links


TITLES_SQL = f"SELECT book_id, split_part(href, '#', 1) AS href, arg_max(title, ord) AS title FROM {LINKS_SQL} GROUP BY ALL"


@query(TITLES_SQL)
def toc_title_map(spark, sf_dir):
    return spine.toc_titles(_spine(spark, sf_dir)[2])


SPINE_SQL = (
    f"WITH i AS (SELECT book_id, ord, name, {o.heading('content')} AS own, {o.clean(o.html_text('content'))} AS text FROM {ITEMS_SQL} WHERE media_type = 'application/xhtml+xml'),"
    f" k AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY ord) AS INTEGER) AS chapter_idx FROM i WHERE {o.word_count('text')} >= 50), m AS ({TITLES_SQL})"
    " SELECT k.book_id, chapter_idx, coalesce(nullif(m.title, ''), own, 'Chapter ' || chapter_idx) AS title, text FROM k LEFT JOIN m ON m.book_id = k.book_id AND m.href = k.name"
)


@query(SPINE_SQL)
def spine_chapters(spark, sf_dir):
    return spine.spine_chapters(*_spine(spark, sf_dir))


def _short(sql: str) -> str:
    """Of every fifth book the documents are too short for a chapter."""
    return sql.replace("replace(replace(text,", "replace(replace(CASE WHEN book_id % 5 = 0 THEN left(text, 60) ELSE text END,")


@query(
    f"WITH c AS ({_short(SPINE_SQL)}), r AS (SELECT book_id, string_agg({o.html_text('content')}, ' ' ORDER BY item_id) AS text FROM {_short(ITEMS_SQL)} WHERE media_type = 'application/xhtml+xml' AND book_id NOT IN (SELECT book_id FROM c) GROUP BY book_id)"
    f" SELECT r.book_id, CAST(1 AS INTEGER) AS chapter_idx, b.title, {o.clean('r.text')} AS text FROM r JOIN book b USING (book_id)"
)
def epub_fallback(spark, sf_dir):
    s, items, links = _spine(spark, sf_dir, _short(PAGE_SQL))
    return spine.fallback_chapters(spine.spine_chapters(s, items, links), items, read(spark, sf_dir, "book"))


@query("SELECT DISTINCT book_id, ord, 'c' || page || '.xhtml' AS href, title FROM toc")
def flatten_toc(spark, sf_dir):
    """Tables of contents nested by two levels of sections, and their leaves again."""
    leaf = F.struct("ord", F.expr("'c' || page || '.xhtml'").alias("href"), "title")
    leaves = read(spark, sf_dir, "toc").groupBy("book_id").agg(F.collect_set(leaf).alias("all"))
    part = lambda k: F.filter("all", lambda x: x["ord"] % 3 == k)
    none, deep = (F.from_json(F.lit("[]"), f"array<struct<ord:int,href:string,title:string{more}>>") for more in ("", ",nodes:array<struct<ord:int,href:string,title:string>>"))

    def section(title: str, nodes: Column) -> Column:
        return F.array(F.struct(F.lit(-1).alias("ord"), F.lit("s").alias("href"), F.lit(title).alias("title"), nodes.alias("nodes")))

    def open_leaves(nodes: Column, empty: Column) -> Column:
        return F.transform(nodes, lambda x: F.struct(x["ord"].alias("ord"), x["href"].alias("href"), x["title"].alias("title"), empty.alias("nodes")))

    inner = F.concat(open_leaves(part(1), none), F.filter(section("Inner", part(2)), lambda x: F.size(x["nodes"]) > 0))
    nodes = F.concat(open_leaves(part(0), deep), F.filter(section("Outer", inner), lambda x: F.size(x["nodes"]) > 0))
    return spine.flatten_toc(leaves.select("book_id", nodes.alias("nodes")))


# -- Timeline and resume ----------------------------------------------------------------------

RENDERS_SQL = "(SELECT * FROM render QUALIFY row_number() OVER (PARTITION BY book_id, chapter_idx ORDER BY loaded_at DESC, rendered_at DESC, path DESC) = 1)"
MARKERS_SQL = (
    f"SELECT book_id, chapter_idx, title, CAST(sum(ms) OVER w - ms AS BIGINT) AS start_ms, CAST(sum(ms) OVER w AS BIGINT) AS end_ms FROM (SELECT c.book_id, c.chapter_idx, c.title, CAST(trunc(coalesce(r.duration_s, 0) * 1000) AS BIGINT) AS ms FROM {LATEST_SQL} c JOIN {RENDERS_SQL} r USING (book_id, chapter_idx)) WINDOW w AS (PARTITION BY book_id ORDER BY chapter_idx)"
)


def _renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.latest(read(spark, sf_dir, "render"), ["book_id", "chapter_idx"], ["loaded_at", "rendered_at", "path"])


@query(MARKERS_SQL)
def chapter_markers(spark, sf_dir):
    return timeline.chapter_markers(_latest_titles(spark, sf_dir), _renders(spark, sf_dir))


@query(
    f"WITH m AS ({MARKERS_SQL}), g AS (SELECT book_id, string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms || chr(10) || 'title=' || coalesce(title, '') || chr(10), chr(10) ORDER BY chapter_idx) AS e FROM m GROUP BY book_id HAVING count(*) > 1)"
    " SELECT g.book_id, ';FFMETADATA1' || chr(10) || 'title=' || coalesce(b.title, '') || chr(10) || 'artist=' || coalesce(b.author, '') || chr(10) || chr(10) || e AS document FROM g JOIN book b USING (book_id)"
)
def ffmetadata(spark, sf_dir):
    markers = timeline.chapter_markers(_latest_titles(spark, sf_dir), _renders(spark, sf_dir))
    return timeline.metadata_document(markers, read(spark, sf_dir, "book"))


@query(f"SELECT book_id, string_agg('file ''' || replace(path, '''', '''\\''''') || '''', chr(10) ORDER BY chapter_idx) AS document FROM {RENDERS_SQL} WHERE path IS NOT NULL GROUP BY book_id")
def concat_list(spark, sf_dir):
    return timeline.concat_list(_renders(spark, sf_dir))


@query("SELECT chapter_id, book_id, chapter_idx FROM chapter c WHERE NOT EXISTS (SELECT 1 FROM render r WHERE r.book_id = c.book_id AND r.chapter_idx = c.chapter_idx)")
def resume_pending(spark, sf_dir):
    return timeline.pending(_chapters(spark, sf_dir), read(spark, sf_dir, "render")).select("chapter_id", "book_id", "chapter_idx")


@query("SELECT chapter_id, EXISTS (SELECT 1 FROM render r WHERE r.book_id = c.book_id AND r.chapter_idx = c.chapter_idx) AS is_done FROM chapter c")
def resume_manifest(spark, sf_dir):
    return timeline.manifest(_chapters(spark, sf_dir), read(spark, sf_dir, "render")).select("chapter_id", "is_done")


@query(f"SELECT book_id, count(*) AS n_chapters FROM {LATEST_SQL} GROUP BY book_id HAVING count(*) > 1")
def bundle_gate(spark, sf_dir):
    return timeline.bundles(_latest_titles(spark, sf_dir))


LATEST_TEXT = f"SELECT book_id, chapter_idx, {o.spoken('text')} AS text FROM {LATEST_SQL}"


def _chunk_rows(source: str, most: int) -> str:
    """Chunks of the relation source (book_id, chapter_idx, text)."""
    inner = f"SELECT book_id, chapter_idx, {o.chunks('text', most)} AS s FROM ({source}) WHERE text IS NOT NULL"
    return f"SELECT book_id, chapter_idx, CAST(i - 1 AS INTEGER) AS chunk_idx, s[i] AS text, CAST(length(s[i]) AS INTEGER) AS n_chars, {o.word_count('s[i]')} AS n_words, 'chunk_' || lpad(CAST(i - 1 AS VARCHAR), 4, '0') || '.wav' AS file FROM (SELECT book_id, chapter_idx, s, unnest(generate_series(1, len(s))) AS i FROM ({inner}))"


@query(_chunk_rows(f"SELECT * FROM ({LATEST_TEXT}) c WHERE NOT EXISTS (SELECT 1 FROM render r WHERE r.book_id = c.book_id AND r.chapter_idx = c.chapter_idx)", 1000))
def dry_run(spark, sf_dir):
    """The whole dry run over the latest chapters that have no recording."""
    return run(_latest_chapters(spark, sf_dir), done=read(spark, sf_dir, "render"))


@query(LATEST_TEXT)
def spoken_chapters(spark, sf_dir):
    """Every chapter's text as it is read."""
    return spoken(_latest_chapters(spark, sf_dir)).select("book_id", "chapter_idx", "text")


@query(
    f"WITH c AS ({_chunk_rows(f'SELECT book_id, chapter_idx, text FROM {LATEST_SQL}', 1000)})"
    " SELECT book_id, chapter_idx, CAST(round(sum(n_words * 0.06), 3) AS DOUBLE) AS duration_s, CAST(sum(n_words) AS BIGINT) AS tokens, CAST(sum(44 + greatest(8, n_words * 8)) AS BIGINT) AS n_bytes FROM c GROUP BY ALL"
)
def render_usage(spark, sf_dir):
    """Chunks rendered by the deterministic stand-in: seconds and tokens of each chapter."""
    sound = synth.render(chunked(_latest_chapters(spark, sf_dir)))
    return sound.groupBy("book_id", "chapter_idx").agg(F.round(F.sum("duration_s"), 3).alias("duration_s"), F.sum("tokens").alias("tokens"), F.sum(F.length("audio")).alias("n_bytes"))


@query()
def any_html_to_text(spark, sf_dir):
    """HTML to text by the tolerant parser."""
    return _chapters(spark, sf_dir).withColumn("page", F.expr(PAGE_SQL)).select("chapter_id", html.any_html_to_text()("page").alias("result"))
