"""Cleaning, speech, chunks, names and HTML: stated rows, properties of random texts, and SQL in DuckDB."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold.functions import chunk, clean, html, naming, numwords, speech
from quirefold.plans import oracle


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v"))).collect())]


def random_texts(n, seed, alphabet):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(n)]


def in_sql(expression, values):
    """The values of an SQL expression over the column v."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table x (i int, v varchar)")
    con.executemany("insert into x values (?, ?)", list(enumerate(values)))
    return [r[0] for r in con.execute(f"select {expression} from x order by i").fetchall()]


def test_clean_stated_rows(spark):
    got = apply(spark, clean.clean_text, ["some-\nword", "well-known", "“Hello” said he", "Some text\n42\nMore text", "para one.\n\npara two.", "Yes\nNo.\nOkay", "word—next…", None, "", " \n \n", "\x1c a text \xa0"])
    assert got == ["someword", "well-known", '"Hello" said he', "Some text\nMore text", "para one.\npara two.", "No.\nOkay", "word -- next...", None, "", "", "a text"]


def test_clean_keeps_blank_lines_on_demand(spark):
    assert apply(spark, lambda c: clean.clean_text(c, True), ["para one.\n\npara two."]) == ["para one.\n\npara two."]


def test_clean_of_random_texts(spark):
    texts = random_texts(400, 1, "ab -\n\n\t.!12—–…“’\x0b\x85 \xa0é")
    got = apply(spark, clean.clean_text, texts)
    for before, after in zip(texts, got, strict=True):
        assert after == after.strip() and not re.search(r"\n{3}|[ \t]\n|[“”‘’–—…]", after)
        for line in after.splitlines():
            assert not re.fullmatch(r"\s*[0-9]{1,4}\s*", line) and (len(line.strip()) >= 4 or re.search(r"[.!?]", line))
        # no letter is made up, and none moves
        kept = iter(c for c in before if c.isalpha())
        assert all(c in kept for c in after if c.isalpha())
    assert got == in_sql(oracle.clean("v"), texts)


# Stated rows: numbers and how they are read.
READ = {
    0: ("zero", "zeroth"), 1: ("one", "first"), 2: ("two", "second"), 3: ("three", "third"), 5: ("five", "fifth"), 8: ("eight", "eighth"), 9: ("nine", "ninth"), 12: ("twelve", "twelfth"), 13: ("thirteen", "thirteenth"),
    20: ("twenty", "twentieth"), 21: ("twenty-one", "twenty-first"), 42: ("forty-two", "forty-second"), 100: ("one hundred", "one hundredth"), 101: ("one hundred and one", "one hundred and first"), 999: ("nine hundred and ninety-nine", "nine hundred and ninety-ninth"),
    1000: ("one thousand", "one thousandth"), 1001: ("one thousand and one", "one thousand and first"), 1100: ("one thousand, one hundred", "one thousand, one hundredth"), 1234: ("one thousand, two hundred and thirty-four", "one thousand, two hundred and thirty-fourth"),
    10_000: ("ten thousand", "ten thousandth"), 100_001: ("one hundred thousand and one", "one hundred thousand and first"), 999_999: ("nine hundred and ninety-nine thousand, nine hundred and ninety-nine", "nine hundred and ninety-nine thousand, nine hundred and ninety-ninth"),
}
VALUES = {w: READ_AS for READ_AS, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {w: 10 * k for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}


def value_of(words):
    """The number that words stand for, read from left to right."""
    total = current = 0
    for w in re.findall("[a-z]+", words):
        if w == "hundred":
            current *= 100
        elif w == "thousand":
            total, current = total + current * 1000, 0
        elif w != "and":
            current += VALUES[w]
    return total + current


def test_number_words(spark):
    assert apply(spark, numwords.cardinal, list(READ), "long") == [c for c, _ in READ.values()]
    assert apply(spark, numwords.ordinal, list(READ), "long") == [o for _, o in READ.values()]
    assert apply(spark, numwords.cardinal, [None, 1_000_000, -1], "long") == [None, None, None]


def test_number_words_read_back(spark):
    n = [*range(0, 1300), *range(9990, 10_130), *random.Random(4).sample(range(1_000_000), 1000)]
    words = apply(spark, numwords.cardinal, n, "long")
    assert [value_of(w) for w in words] == n and len(set(words)) == len(set(n))


# Stated rows: what numbers become in a text.
NUMBERS = {
    "There were 42 apples.": "There were forty-two apples.", "1st": "first", "Published in 1984.": "Published in 1984.", "In 2023, things changed.": "In 2023, things changed.", "Pi is 3.14.": "Pi is three point fourteen.", "3.05": "three point five",
    "1984.5": "1984.five", "3.1984": "three.1984", "v1.2": "v1.2", "V2": "V2", "v1.2023": "v1.2023", "v2023": "v2023", "1984th": "one thousand, nine hundred and eighty-fourth", "1th": "first", "1000000": "1000000", "1234567890": "1234567890",
    "1799 1800 2029 2030": "one thousand, seven hundred and ninety-nine 1800 2029 two thousand and thirty", "192.168.1.1": "one hundred and ninety-two point one hundred and sixty-eight.one point one", "1,984": "one,nine hundred and eighty-four",
    "0000042": "forty-two", "_1984_": "_1984_", "22nd of 103": "twenty-second of one hundred and three", "v1.2abc": "v1.2abc", "v1.2nd": "v1.2nd", "é1": "é1", "_._": "_._", "": "",
}


def test_numbers_in_text(spark):
    assert apply(spark, speech.convert_numbers, [*NUMBERS, None]) == [*NUMBERS.values(), None]


def test_masked_years_and_versions(spark):
    digits = str.maketrans("0123456789", speech.MASKED)
    rows = {"in 1984, v1.2": f"in _{'1984'.translate(digits)}_, _{'v1.2'.translate(digits)}_", "1799 v": "1799 v", "x1984": "x1984"}
    assert apply(spark, speech.protect, list(rows)) == list(rows.values())
    assert apply(spark, lambda c: speech.unprotect(speech.protect(c)), list(rows)) == list(rows)


def test_numbers_in_random_text(spark):
    texts = random_texts(600, 2, "0123456789..vV stndrh_,é ")
    got = apply(spark, speech.convert_numbers, texts)
    assert got == in_sql(oracle.numbers("v"), texts)
    for before, after in zip(texts, got, strict=True):
        # digits that are left are those of years, versions, long numbers, or beside letters
        assert all(re.fullmatch(r"\d*", x) is None or not x or len(x) > 6 or re.fullmatch(r"1[89]\d\d|20[012]\d", x) or re.search(r"[vV]\d[\d.]*", before) for x in re.split(r"\W", after))


def test_abbreviations(spark):
    texts = ["Dr. Smith", "fruits, vegetables, etc.", "cats vs. dogs", "He said no.", "PA, NY", "XDr. PAL", None]
    assert apply(spark, speech.expand_abbreviations, texts) == ["Doctor Smith", "fruits, vegetables, etcetera", "cats versus dogs", "He said number", "Pennsylvania, New York", "XDr. PAL", None]


def test_pauses_and_cleanup(spark):
    assert apply(spark, speech.inject_pauses, ["No title\n\nNext", "End.\n\n\n\nNext", 'foo:\n\n"Hi."\n\nx']) == ["No title.\n\nNext", "End.\n\nNext", 'foo:.\n\n"Hi.".\n\nx']
    assert apply(spark, speech.final_cleanup, [" #a *b*  _c_ `~ ", None]) == ["a b c", None]


def test_speech_pipeline(spark):
    assert apply(spark, speech.preprocess_for_speech, ["Dr. Johnson published 3 papers in 1999, etc."]) == ["Doctor Johnson published three papers in 1999, etcetera"]
    assert apply(spark, lambda c: speech.preprocess_for_speech(c, numbers=False), ["Dr. X 3"]) == ["Doctor X 3"]


def test_chunks_stated_rows(spark):
    rows = ["First sentence. Second sentence. Third sentence.", "A " * 500, "Hello world.", "", "  ", "One, two; three: four and five and six and seven."]
    got = apply(spark, lambda c: chunk.chunks(c, 30), rows)
    assert got[0] == ["First sentence.", "Second sentence.", "Third sentence."] and got[2:5] == [["Hello world."], [], []]
    assert got[1][0] == ("A " * 15).strip() and got[5] == ["One, two; three:", "four and five and six and seve", "n."]


@pytest.mark.parametrize("most", [7, 30, 100])
def test_chunks_of_random_texts(spark, most):
    texts = [t for t in random_texts(250, most, "abc .!?,;: \n")] + ["A " * 500, "x" * 1000, "Hello world.", "", "  "]
    got = apply(spark, lambda c: chunk.chunks(c, most), texts)
    for t, cs in zip(texts, got, strict=True):
        assert all(0 < len(c.strip()) and len(c) <= most for c in cs)
        assert "".join("".join(cs).split()) == "".join(t.split())
        # what would have fitted beside the chunk before is there
        whole = [s for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]
        if all(len(s) <= most for s in whole):
            assert all(len(a) + 1 + len(re.split(r"(?<=[.!?])\s+", b)[0]) + 1 > most for a, b in zip(cs, cs[1:]))
    assert got == in_sql(oracle.chunks("v", most), texts)


def test_chunks_of_a_text_of_many_blocks(spark):
    """Borders of blocks leave no mark: chunks of a text that is many blocks long are those that SQL packs in one go."""
    texts = [" ".join(f"Word {i}{'x' * (i % 23)}{'.' if i % 3 else ','}" for i in range(n)) for n in (chunk.BLOCK, chunk.BLOCK * 3 + 1, 5000)]
    assert apply(spark, lambda c: chunk.chunks(c, 50), texts) == in_sql(oracle.chunks("v", 50), texts)


def test_chunks_of_null(spark):
    assert apply(spark, chunk.chunks, [None]) == [None]


def test_names(spark):
    df = spark.createDataFrame([(1, "Chapter One", "a/b/Book.PDF"), (12, "L'été_x\t2²", "x.epub"), (123, "", "noext"), (4, None, None)], "i int, t string, p string")
    rows = df.select(naming.slug("i", "t"), naming.suffix("p"), naming.word_count("t"), naming.chunk_file("i"), naming.thousands(F.col("i") * 1000), naming.file_stem("p")).collect()
    assert [tuple(r) for r in rows] == [("01_chapter_one", ".pdf", 2, "chunk_0001.wav", "1,000", "Book"), ("12_létéx2²", ".epub", 2, "chunk_0012.wav", "12,000", "x"), ("123_", "", 0, "chunk_0123.wav", "123,000", "noext"), (None, None, None, "chunk_0004.wav", "4,000", None)]


PAGE = "<html><head><title>x</title></head><body><script>'</p>'</script><h1></h1><h2>Tw<b>o</b></h2><p>a<i>b</i> &amp; c<br>d<!-- n --></p><li>e</li></body></html>"


def test_html(spark):
    assert apply(spark, html.html_to_text, [PAGE, "<p>no body", None, ""]) == ["Two\nab & c\nd n \ne", "no body", None, ""]
    assert apply(spark, lambda c: html.html_to_text(c, True), [PAGE]) == ["Two\nab & c\nd\ne"]
    assert apply(spark, html.heading, [PAGE, "<h1>A</h1><h1>B</h1>", "<h1></h1><h1>B</h1><h2>C</h2>", "x"]) == ["Two", "A", "C", None]
    assert apply(spark, html.href_base, ["a.xhtml#x", "a", None]) == ["a.xhtml", "a", None]


def test_any_html(spark):
    f = html.any_html_to_text()
    assert apply(spark, f, [PAGE, "<p>open <b>bold", "a < b", None]) == ["Two\nab & c\nd n \ne", "open bold", "a < b", None]
