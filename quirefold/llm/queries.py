"""The queries of this subpackage, each over its whole tables, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import p1_quality, p2_scans, p3_encoding, p4_canonical, p5_split, p6_sentences, p7_tokens, p9_language
from .p8_mix import mix_sources


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that are mostly a list, a table or junk."""
    return p1_quality.unnatural(_read(spark, sf_dir, "chapter"))


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics and label shares of each chapter, with the corpus' common words."""
    chapters = _read(spark, sf_dir, "chapter")
    return p1_quality.text_quality(chapters, common=p1_quality.common_words(chapters, "text"))


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _read(spark, sf_dir, "chapter").select("chapter_id", "book_id", "text", "page_start", "page_end"), _read(spark, sf_dir, "book").select("book_id", "title", "author")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page furniture, broken words and misread characters by line."""
    return p2_scans.scan_findings(*_scans(spark, sf_dir))[0].select("chapter_id", "line_no", "kind").distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter in continuous paragraphs."""
    return p2_scans.repair_scans(*_scans(spark, sf_dir))


FIELDS = (("chapter_text", "chapter", "chapter_id", "text"), ("book_title", "book", "book_id", "title"), ("book_author", "book", "book_id", "author"))


def _repaired(spark: SparkSession, sf_dir: str, content: bool) -> DataFrame:
    tables = {t: _read(spark, sf_dir, t) for t in ("chapter", "book")}
    model = p3_encoding.character_model(*((tables[t], c) for _, t, _, c in FIELDS))
    counts = {r["key"]: r["n"] for r in model.collect()}
    out = None
    for field, t, key, column in FIELDS:
        part = p3_encoding.repair_encoding(tables[t], key, column, counts, content).withColumnRenamed(key, "row_id").withColumn("field", F.lit(field))
        out = part if out is None else out.unionByName(part)
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values decoded in a wrong encoding, or with lost bytes."""
    return _repaired(spark, sf_dir, False).where("damaged").select("field", "row_id").distinct()


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value restored, with the spans and their encoding pairs."""
    return _repaired(spark, sf_dir, True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chapters that look the same and are stored differently."""
    return p4_canonical.look_alikes(_read(spark, sf_dir, "chapter"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter that looks like a differently stored one, with its class and its number of links."""
    return p4_canonical.look_classes(_read(spark, sf_dir, "chapter"))


def p4_canonical_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and text of each chapter in the one consistent form."""
    return p4_canonical.canonical_form(_read(spark, sf_dir, "chapter")).select("chapter_id", "title", "text", F.hex("look").alias("look"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that must be cut, and those that need a hard cut."""
    return p5_split.needs(_read(spark, sf_dir, "chapter"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every chapter."""
    return p5_split.split_texts(_read(spark, sf_dir, "chapter"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence ends of the chapters in sentence_probe."""
    chapters = _read(spark, sf_dir, "chapter").join(_read(spark, sf_dir, "sentence_probe").select("chapter_id").distinct(), "chapter_id", "left_semi")
    return p6_sentences.sentences(chapters, content=False).select("chapter_id", "sent_end")


def p6_sentences_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every chapter."""
    return p6_sentences.sentences(_read(spark, sf_dir, "chapter"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return p7_tokens.encode_documents(_read(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection: one row for each use of a document."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share reached by each source."""
    return _mix(spark, sf_dir)[1]


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_target"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the documents whose label is missing or wrong, or that mix languages."""
    return p9_language.mislabelled(_read(spark, sf_dir, "documents"))


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and of its paragraphs."""
    return p9_language.languages(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_statistics, p2_found, p2_repaired, p3_found, p3_repaired, p4_found, p4_classes, p4_canonical_form, p5_found, p5_pieces, p6_found, p6_sentences_all, p7_ids, p8_mix, p8_shares, p9_found, p9_languages)
}



def _unicode(points) -> str:
    """Characters as an SQL string."""
    return "(" + " || ".join(f"chr({p})" for p in points) + ")"


def _look_sql(column: str) -> str:
    """A plain skeleton of a column: two texts look the same if their skeletons are equal.

    Unlike the operator it folds every look-alike to Latin, whatever the word's alphabet.
    """
    t = f"nfc_normalize(coalesce({column}, ''))"
    t = f"regexp_replace({t}, '[\\x{{00ad}}\\x{{034f}}\\x{{061c}}\\x{{115f}}\\x{{1160}}\\x{{17b4}}\\x{{17b5}}\\x{{180b}}-\\x{{180e}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{206f}}\\x{{3164}}\\x{{fe00}}-\\x{{fe0f}}\\x{{feff}}\\x{{ffa0}}]', '', 'g')"
    for a, b in ((0xFB00, "ff"), (0xFB01, "fi"), (0xFB02, "fl"), (0xFB03, "ffi"), (0xFB04, "ffl"), (0xFB05, "st"), (0xFB06, "st")):
        t = f"replace({t}, chr({a}), '{b}')"
    alike = {k: v for k, v in (p4_canonical.CYRILLIC | p4_canonical.GREEK).items() if k != v}
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    blank = {c: " " for c in map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))}
    to = alike | wide | blank | {c: "-" for c in p4_canonical.HYPHENS}
    pairs = [(ord(a), ord(b)) for a, b in to.items() if ord(b) < 0x250]
    t = f"translate({t}, {_unicode(a for a, _ in pairs)}, {_unicode(b for _, b in pairs)})"
    return f"regexp_replace(nfc_normalize({t}), '[ \\t\\r]+(\\n|$)', '\\1', 'g')"


ORACLE: dict[str, str] = {
    "p4_found": f"WITH k AS (SELECT chapter_id, coalesce(title, '') AS t, text, {_look_sql('title')} AS lt, {_look_sql('text')} AS lx FROM chapter WHERE text <> '')"
    " SELECT a.chapter_id AS chapter_id_a, b.chapter_id AS chapter_id_b FROM k a JOIN k b ON a.lt = b.lt AND a.lx = b.lx AND a.chapter_id < b.chapter_id WHERE a.t <> b.t OR a.text <> b.text",
    "p5_found": "SELECT chapter_id, 'cut' AS need FROM chapter WHERE length(text) > 1000 UNION ALL SELECT chapter_id, 'hard' FROM chapter WHERE list_max(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: length(x))) > 1000",
}
