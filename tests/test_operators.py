"""Segmentation, spine, timeline, books, scans, sources and streams on small relations."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quirefold.operators import audio, books, scan, segment, spine, synth, timeline
from quirefold.plans import pipeline
from quirefold.sources import ebooks, extract, settings
from quirefold.streaming import chunks as stream

PAGE = "book_id long, page_idx int, text string"
TOC = "book_id long, ord int, level int, title string, page int"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_scans_against_brute_force(spark):
    r = random.Random(3)
    data = [(g, i, r.choice([None, 1, 2, 5])) for g in range(3) for i in sorted(r.sample(range(400), 90))]
    df = spark.createDataFrame(data, "g int, i int, v int")
    got = rows(scan.running_sum(df, "g", "i", F.coalesce("v", F.lit(0)), "s", size=16).select("g", "i", "s"))
    want, total = [], {}
    for g, i, v in data:
        total[g] = total.get(g, 0) + (v or 0)
        want.append((g, i, total[g]))
    assert got == want
    got = rows(scan.carry_forward(df, "g", "i", F.col("v"), "c", size=16).select("g", "i", "c"))
    want, last = [], {}
    for g, i, v in data:
        last[g] = v if v is not None else last.get(g)
        want.append((g, i, last[g]))
    assert got == want
    got = rows(scan.next_value(df, "g", "i", "i", "n", size=16).select("g", "i", "n"))
    assert got == [(g, i, data[k + 1][1] if k + 1 < len(data) and data[k + 1][0] == g else None) for k, (g, i, _) in enumerate(data)]


def test_pattern_chapters(spark):
    pages = [(1, 0, "front matter."), (1, 1, "Chapter one\nfirst page."), (1, 2, None), (1, 2, "more."), (1, 3, "PART II of it\nsecond."), (2, 0, "Prologue\nonly one."), (3, 0, "Mild words")]
    got = rows(segment.pattern_chapters(spark.createDataFrame(pages, PAGE)))
    assert got == [(1, 1, "Chapter one", "Chapter one\nfirst page.\nmore.", 2, 3), (1, 2, "PART II of it", "PART II of it\nsecond.", 4, 4)]


def test_bookmarks_on_one_page_backwards_and_zero(spark):
    pages = [(1, i, f"page {i}.") for i in range(4)]
    toc = [(1, 0, 1, " A ", 1), (1, 1, 1, "B", 1), (1, 1, 1, "B", 1), (1, 2, 2, "sub", 2), (1, 3, 1, "C", 3), (1, 4, 1, "D", 0), (2, 0, 1, "alone", 1)]
    got = rows(segment.bookmark_chapters(spark.createDataFrame(pages, PAGE), spark.createDataFrame(toc, TOC)), "chapter_idx")
    assert got == [(1, 1, "A", "", 1, 0), (1, 2, "B", "page 0.\npage 1.", 1, 2), (1, 3, "C", "", 3, 0), (1, 4, "D", "page 0.\npage 1.\npage 2.\npage 3.", 1, 4)]


def test_font_headings(spark):
    body = [(1, p, k, 10.0, 50.0, float(k), "x") for p in range(2) for k in range(5)]
    head = [(1, 0, 10, 14.0, 1.0, 2.0, "b"), (1, 0, 11, 14.0, 3.0, 1.0, "d"), (1, 0, 12, 14.0, 1.0, 1.0, "A"), (1, 0, 13, 14.0, 9.0, 1.0, "no"), (1, 1, 10, 14.0, 1.0, 1.0, "ab")]
    got = rows(segment.font_headings(spark.createDataFrame(body + head, "book_id long, page_idx int, ord int, size double, top double, x0 double, text string")))
    assert got == [(1, 0, "Abd")]


def test_cascade(spark):
    pages = [(b, i, f"Chapter {i + 1}\ntext." if b == 2 else "plain text.") for b in (1, 2, 3) for i in range(3)]
    toc = [(1, 0, 1, "A", 1), (1, 1, 1, "B", 2)]
    p, t = spark.createDataFrame(pages, PAGE), spark.createDataFrame(toc, TOC)
    got = {(r["book_id"], r["method"], r["title"]) for r in segment.cascade(p, t, size=2).collect()}
    assert got == {(1, "bookmarks", "A"), (1, "bookmarks", "B"), (2, "pattern", "Chapter 1"), (2, "pattern", "Chapter 2"), (2, "pattern", "Chapter 3"), (3, "page_split", "Part 1"), (3, "page_split", "Part 2")}
    got = {(r["book_id"], r["method"], r["title"]) for r in segment.cascade(p, t, methods=("unknown", "bookmarks")).collect()}
    assert {x[1:] for x in got if x[0] > 1} == {("none", "Book")}


def test_empty_pages(spark):
    p, t = spark.createDataFrame([], PAGE), spark.createDataFrame([], TOC)
    assert segment.cascade(p, t).count() == 0


def test_spine(spark):
    long = "<p>" + "word " * 50 + "</p>"
    items = [(1, "a", "a.xhtml", spine.DOCUMENT, f"<h1>Own</h1>{long}"), (1, "b", "b.xhtml", spine.DOCUMENT, "<p>short</p>"), (1, "c", "c.xhtml", spine.DOCUMENT, long), (1, "i", "i.png", "image/png", None), (2, "a", "a.xhtml", spine.DOCUMENT, "<p>little text</p>")]
    order = [(1, 0, "b"), (1, 1, "a"), (1, 2, "i"), (1, 3, "c"), (1, 4, "missing"), (2, 0, "a")]
    links = [(1, 0, "a.xhtml#x", ""), (1, 1, "c.xhtml", "first"), (1, 2, "c.xhtml#y", "Last")]
    i = spark.createDataFrame(items, "book_id long, item_id string, name string, media_type string, content string")
    s = spark.createDataFrame(order, "book_id long, ord int, item_id string")
    k = spark.createDataFrame(links, "book_id long, ord int, href string, title string")
    got = spine.spine_chapters(s, i, k)
    assert rows(got.select("book_id", "chapter_idx", "title")) == [(1, 1, "Own"), (1, 2, "Last")]
    b = spark.createDataFrame([(1, "One"), (2, "Two")], "book_id long, title string")
    assert rows(spine.fallback_chapters(got, i, b)) == [(2, 1, "Two", "little text")]


def test_flatten_toc(spark):
    leaf = "struct<ord:int,href:string,title:string>"
    schema = f"book_id long, nodes array<struct<ord:int,href:string,title:string,nodes:array<{leaf}>>>"
    df = spark.createDataFrame([(1, [(0, "a", "A", []), (1, "s", "Section", [(2, "b", "B"), (3, "c", "C")])])], schema)
    assert rows(spine.flatten_toc(df)) == [(1, 0, "a", "A"), (1, 2, "b", "B"), (1, 3, "c", "C")]


def test_markers_cut_before_adding(spark):
    c = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "book_id long, chapter_idx int, title string")
    r = spark.createDataFrame([(1, 1, "p1", "1.2345"), (1, 2, "p2", "2.9999"), (1, 3, "p'3", "bad")], "book_id long, chapter_idx int, path string, duration_s string")
    m = timeline.chapter_markers(c, r)
    assert rows(m) == [(1, 1, "a", 0, 1234), (1, 2, "b", 1234, 4233), (1, 3, "c", 4233, 4233)]
    b = spark.createDataFrame([(1, "T", None)], "book_id long, title string, author string")
    assert timeline.metadata_document(m, b).first()["document"].startswith(";FFMETADATA1\ntitle=T\nartist=\n\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=1234\ntitle=a\n\n[CHAPTER]")
    assert timeline.concat_list(r).first()["document"] == "file 'p1'\nfile 'p2'\nfile 'p'\\''3'"


def test_pending_and_latest(spark):
    c = spark.createDataFrame([(1, 1, "old", 1), (1, 1, "new", 2), (1, 2, "x", 1)], "book_id long, chapter_idx int, title string, loaded_at int")
    assert rows(timeline.latest(c, ["book_id", "chapter_idx"], ["loaded_at"]).select("title")) == [("new",), ("x",)]
    done = spark.createDataFrame([(1, 1), (1, 1)], "book_id long, chapter_idx int")
    assert rows(timeline.pending(c, done).select("title")) == [("x",)]
    assert rows(timeline.manifest(c, done).select("title", "is_done")) == [("new", True), ("old", True), ("x", False)]
    assert rows(timeline.bundles(c)) == [(1, 3)]


def test_books(spark):
    b = spark.createDataFrame([(1, " T ", "", "d/x.PDF"), (2, None, "A", "d/y.z.epub"), (3, "", None, "q.pdf")], "book_id long, title string, author string, source_path string")
    assert rows(books.with_defaults(b).select("book_id", "title", "author")) == [(1, "T", "Unknown Author"), (2, "y.z", "A"), (3, "Unknown Title", "Unknown Author")]
    c = spark.createDataFrame([(1, 2, "two", "a b c"), (1, 1, None, None)], "book_id long, chapter_idx int, title string, text string")
    assert books.summary(b, c).first()["summary"] == "Book:     T\nAuthor:   Unknown Author\nSource:   x.PDF\nChapters: 2\nWords:    3\n  [01]  (0 words)\n  [02] two (3 words)"
    v = spark.createDataFrame([("default", ""), ("x", "x.wav")], "name string, reference_audio string")
    asked = spark.createDataFrame([(1, None), (2, "x"), (3, "gone")], "book_id long, voice string")
    assert rows(books.voice_reference(asked, v)) == [(1, None, None), (2, "x", "x.wav"), (3, "gone", None)]
    assert books.usage(spark.createDataFrame([(1,), (None,)], "t long"), "t").first()[0] == 1
    with pytest.raises(Exception, match="unsupported format"):
        spark.createDataFrame([("a.doc",)], "p string").select(books.extractor("p", fail=True)).collect()


def epub(text: str = "Hi") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("O/a.xhtml", f"<html><body><p>{text}</p></body></html>")
        z.writestr("O/t.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>S</text></navLabel><content src="a.xhtml"/><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml#p"/></navPoint></navPoint></navMap></ncx>')
    return out.getvalue()


def test_epub_reader(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(epub())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    got = ebooks.read_epub(spark, str(tmp_path / "*.epub"))
    kinds = {r["kind"]: r for r in got.collect()}
    assert set(kinds) == {"meta", "item", "spine", "toc", "error"}
    assert kinds["toc"]["title"] == "One" and kinds["toc"]["name"] == "O/a.xhtml#p" and kinds["spine"]["item_id"] == "a"
    with pytest.raises(RuntimeError, match="not installed"):
        ebooks.require_tool("no-such-tool-here")


def test_synth(spark):
    c = spark.createDataFrame([(1, 1, 0, "a b c"), (1, 1, 1, "")], "book_id long, chapter_idx int, chunk_idx int, text string")
    got = synth.render(c).orderBy("chunk_idx").collect()
    assert [(r["tokens"], bytes(r["audio"][:4])) for r in got] == [(3, b"RIFF"), (0, b"RIFF")]
    with pytest.raises(ValueError, match="unknown backend"):
        synth.backend("nothing")


def test_pipeline_and_sinks(spark, tmp_path):
    c = spark.createDataFrame([(1, 1, "One", "Dr. A has 3 cats.\n\nThe end"), (1, 2, "Two", ""), (1, 3, "Three", None)], "book_id long, chapter_idx int, title string, text string")
    assert rows(pipeline.run(c).select("chapter_idx", "text")) == [(1, "Doctor A has three cats. The end")]
    assert rows(pipeline.run(c, chapter=2)) == []
    assert rows(pipeline.run(c, done=c.where("chapter_idx = 1"))) == []
    pipeline.write_texts(c, str(tmp_path / "t"))
    assert (tmp_path / "t" / "book=1" / "chapter=01_one").is_dir()
    assert settings.Settings().chunk_size == 1000
    with pytest.raises(KeyError):
        settings.secret("QUIREFOLD_NO_SUCH_SECRET")


def test_streams(spark, tmp_path):
    import datetime as d

    t = d.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, "One", "A cat.", t), (1, 1, "One", "A cat.", t), (1, 2, "Two", "A dog.", t), (1, 3, "Three", "", t)], "book_id long, chapter_idx int, title string, text string, loaded_at timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream.resume_into(source, str(tmp_path / "out"), str(tmp_path / f"c{_}")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out" / "chunks")).select("chapter_idx", "text")) == [(1, "A cat."), (2, "A dog.")]
    assert rows(spark.read.parquet(str(tmp_path / "out" / "done"))) == [(1, 1), (1, 2), (1, 3)]
    q = stream.chunk_stream(source).writeStream.format("memory").queryName("quires").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.sql("select chapter_idx, text from quires")) == [(1, "A cat."), (2, "A dog.")]


def test_latest_texts(spark):
    data = [(1, 1, 1, "old", 1), (2, 1, 1, "new", 2), (3, 1, 2, "x", 1), (4, 2, 1, None, 1)]
    df = spark.createDataFrame(data, "chapter_id long, book_id long, chapter_idx int, text string, loaded_at int")
    assert rows(timeline.latest_texts(df, ["book_id", "chapter_idx"], ["loaded_at", "chapter_id"]).select("chapter_id")) == [(2,), (3,), (4,)]
    assert timeline.latest_texts(df.limit(0), ["book_id", "chapter_idx"], ["loaded_at", "chapter_id"]).count() == 0


def test_copies_of_pages(spark):
    """The least text of a page's copies counts, for its heading too; a null copy only where there is no other."""
    pages = [(1, 0, "Chapter 1\nb."), (1, 0, "Chapter 1\na."), (1, 0, None), (1, 1, "Zebra line.\n"), (1, 1, "Chapter 9\nc."), (1, 2, "Chapter 2\nd."), (1, 2, "Aa.\nd."), (1, 3, None), (1, 4, "Chapter 5\ne."), (1, 4, "Chapter 5\ne.")]
    got = rows(segment.pattern_chapters(spark.createDataFrame(pages, PAGE)))
    assert got == [(1, 1, "Chapter 1", "Chapter 1\na.", 1, 1), (1, 2, "Chapter 9", "Chapter 9\nc.\nAa.\nd.", 2, 4), (1, 3, "Chapter 5", "Chapter 5\ne.", 5, 5)]


def test_cascade_passes_over_bad_fonts(spark):
    pages = spark.createDataFrame([(1, i, "plain text.") for i in range(3)], PAGE)
    bad = spark.createDataFrame([(1, 0)], "book_id long, page_idx int")
    assert {r["method"] for r in segment.cascade(pages, glyphs=bad).collect()} == {"page_split"}


def test_audio(spark):
    chunks = spark.createDataFrame([(1, 1, 1, "d e"), (1, 1, 0, "a b c"), (1, 2, 0, "f " * 9), (2, 1, 0, "g")], "book_id long, chapter_idx int, chunk_idx int, text string")
    chapters = audio.assemble_chapters(synth.render(chunks))
    got = {(r["book_id"], r["chapter_idx"]): r for r in chapters.collect()}
    assert {k: round(r["duration_s"] * 8000) for k, r in got.items()} == {(1, 1): 40, (1, 2): 72, (2, 1): 8}
    assert audio.probe(bytes(got[1, 1]["audio"])) == got[1, 1]["duration_s"] and audio.probe(b"x") == audio.probe(None) == 0.0
    assert [round(r[0] * 8000) for r in audio.durations(chapters.orderBy("book_id", "chapter_idx")).select("duration_s").collect()] == [40, 72, 8]
    documents = spark.createDataFrame([(1, "doc")], "book_id long, document string")
    (book,) = audio.bundle_books(chapters, documents).collect()
    assert book["book_id"] == 1 and round(audio.probe(bytes(book["audio"])) * 8000) == 112 and book["document"] == "doc" and book["error"] is None
    broken = chapters.unionByName(spark.createDataFrame([(1, 3, b"no wave", 0.0)], "book_id long, chapter_idx int, audio binary, duration_s double"))
    (book,) = audio.bundle_books(broken, documents).collect()
    assert book["audio"] is None and book["error"]
    with pytest.raises(ValueError, match="nothing to join"):
        audio.join_waves([])
    with pytest.raises(RuntimeError, match="not installed"):
        audio.encode_with("no-such-encoder", [])([bytes(got[1, 1]["audio"])])


def test_backends(spark, monkeypatch):
    asked = []

    def send(text, reference):
        asked.append(text)
        if len(asked) < 3:
            raise OSError("busy")
        return b"s", 1.0, 7

    assert synth.Remote(send, pause=0.0, rate=1000).synthesize("x") == (b"s", 1.0, 7) and len(asked) == 3
    with pytest.raises(RuntimeError, match="after 2 tries"):
        synth.Remote(lambda t, r: 1 / 0, tries=2, pause=0.0, rate=1000).synthesize("x")
    loaded = []
    local = synth.Local(lambda device: loaded.append(device) or (lambda t, r: (b"l", 0.5, 1)), "cuda")
    assert [local.synthesize("a"), local.synthesize("b")] == [(b"l", 0.5, 1)] * 2 and loaded == ["cuda"] and synth.backend_name(local) == "Local"
    monkeypatch.setattr(synth, "BACKENDS", dict(synth.BACKENDS))
    synth.register("api", synth.Tone)
    assert synth.backend("api") is synth.Tone


def test_options(spark):
    from pyspark.sql import Observation

    c = spark.createDataFrame([(1, 1, "One", "A cat sat. " * 3), (1, 2, "Two", None)], "book_id long, chapter_idx int, title string, text string")
    assert rows(pipeline.listing(c)) == [(1, 1, "One", 9), (1, 2, "Two", 0)]
    assert rows(pipeline.require_chapter(c, 2).select("title")) == [("Two",)]
    with pytest.raises(ValueError, match="no chapter 3; there are \\[1, 2\\]"):
        pipeline.require_chapter(c, 3)
    watch = Observation("run")
    n = len(pipeline.run(c, watch=watch).collect())
    assert watch.get["chunks"] == n == 1 and watch.get["words"] == 9
    assert pipeline.rendered(c, settings.Settings(backend="tone")).count() == 1
    with pytest.raises(ValueError, match="unknown backend"):
        pipeline.rendered(c, settings.Settings(backend="nothing"))
    pipeline.verbose(True)
    pipeline.verbose(False)


def test_voices_and_usage(spark):
    v = spark.createDataFrame([("default", ""), ("x", "x.wav"), ("y", "y.wav")], "name string, reference_audio string")
    asked = spark.createDataFrame([(1, None), (2, "x"), (3, "gone"), (4, "y")], "book_id long, voice string")
    files = spark.createDataFrame([("x.wav",)], "path string")
    assert rows(books.voice_problems(asked, v, files)) == [(3, "gone", "unknown voice"), (4, "y", "missing reference")]
    assert rows(books.voice_problems(asked, v)) == [(3, "gone", "unknown voice")]
    calls = spark.createDataFrame([(1, 5), (1, None), (2, 3)], "book_id long, tokens long")
    assert {tuple(r) for r in books.usage_report(calls).collect()} == {(1, 5, 2), (2, 3, 1), (None, 8, 3)}


def test_extract(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(epub("Hi there."))
    found, chapters = extract.extract(spark, str(tmp_path / "b.epub"))
    assert [(r["title"], r["author"]) for r in found.collect()] == [("T", "A")]
    assert rows(chapters.select("chapter_idx", "title", "text")) == [(1, "T", "Hi there.")]
    (tmp_path / "pages.TXT").write_text("Chapter 1\nfirst.\fmore.\fChapter 2\nsecond.")
    found, chapters = extract.extract(spark, str(tmp_path / "pages.TXT"))
    assert [r["title"] for r in found.collect()] == ["pages"]
    assert rows(chapters.select("chapter_idx", "title", "page_start", "page_end")) == [(1, "Chapter 1", 1, 2), (2, "Chapter 2", 3, 3)]

    def bad(data):
        raise OSError("damaged")
        yield ""

    assert [r["error"] for r in extract.read_pages(spark, str(tmp_path / "pages.TXT"), {".txt": bad}).collect()] == ["OSError: damaged"]
    with pytest.raises(ValueError, match="unsupported format"):
        extract.extract(spark, "a/b.doc")
    with pytest.raises(RuntimeError, match="not installed"):
        extract.extract(spark, "a/b.mobi")
