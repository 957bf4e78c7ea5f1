"""Text of scanned pages: page furniture, words broken at line ends, misread characters; and the repaired text.

Words of all texts are counted. A word's anagram hash is the sum of powers of its code points, so
a confusion (rn for m, 1 for l) changes it by the same difference wherever it stands: SQL joins
rare words, each hash shifted by the differences of the confusions the word may hold, to frequent
words, verifies the substitution and keeps the most frequent true word. Lines at page edges are
compared with the book's title and author and with one another; a hyphen at a line end is judged
by the counts of the joined word and of the compound.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import checkpointed, count_tokens, map_columns

# What is read for what.
CONFUSIONS = (
    *(("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("!", "i"), ("!", "l"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("ii", "u"), ("rn", "m"), ("ri", "n"), ("li", "h"), ("cl", "d"), ("vv", "w"), ("iii", "m")),
    *(("c", "e"), ("e", "c"), ("m", "rn"), ("h", "li"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("w", "vv"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("b", "6"), ("g", "9"), ("o", "c"), ("c", "o"), ("a", "o"), ("q", "g"), ("tn", "m"), ("fi", "h"), ("ln", "m"), ("nn", "m"), ("rri", "m"), ("in", "m"), ("ni", "m")),
)
#: A true word is at least this often, and this many times as often as the misread one.
FREQUENT, RATIO = 4, 12
#: A single letter read for another of the alphabet needs stronger evidence: either may be right.
LETTER_RATIO = 150
#: Words known to every task; others go through a join.
LEXICON = 60_000
# Hyphens at line ends; the last two are never a compound's own.
HYPHENS = "-‐­¬"
SOFT = "­¬"
TOKEN = re.compile(r"[|!]?[^\W_]+(?:[|!'’\-][^\W_]+)*")
HYPHEN_END = re.compile(rf"[^\W\d_]([{HYPHENS}])\Z")
LAST_WORD = re.compile(r"[|!]?[^\W_]+(?:[|!'’\-][^\W_]+)*\Z")
FIRST_WORD = re.compile(r"\s*([|!]?[^\W_]+(?:[|!'’\-][^\W_]+)*)")
#: A digit or stroke inside a word, or before one.
INSIDE = re.compile(r"[^\W\d_]+[0-9|!]+[^\W\d_]{2,}|[^\W\d_]{3,}[0-9|!]+[^\W\d_]*|[01569|!][^\W\d_]{4,}")
INSIDE_SQL = r"^(?:\p{L}+[0-9|!]+\p{L}{2,}|\p{L}{3,}[0-9|!]+\p{L}*|[01569|!]\p{L}{4,})$"
NUMBER = r"[0-9lIoO|!SsBZzgqb]{1,5}|[ivxlcIVXLC!1|]{1,8}"
BARE = re.compile(rf"[\W_]*(?:(?:page|p[aá]g(?:ina)?|seite|sida|str(?:ona)?|стр|с|σελ)\.?\s*)?({NUMBER})[\W_]*", re.I)
HEADED = re.compile(rf"(?:({NUMBER})(?:\s{{2,}}|\s*\|\s*)(\S.*)|(\S.*?)(?:\s{{2,}}|\s*\|\s*)({NUMBER}))\.?")
MARK = re.compile(r"(\S+) ([A-Z]\d?|\d{1,2})")
DIGITS = str.maketrans("lIoO|!SsBZzgqb", "11001155822996")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower().replace("‐", "-"))


def inside(w: str) -> bool:
    """Whether a part of the word has a digit or stroke in it, however often it is read so."""
    return any(map(INSIDE.fullmatch, w.split("-")))


def number_of(s: str) -> set[int]:
    """What a printed number may mean: as digits, misread ones put right, and as a Roman numeral."""
    out = set()
    d = s.translate(DIGITS)
    if d.isdigit():
        out.add(int(d))
    r = s.lower().replace("!", "i").replace("1", "i").replace("|", "i")
    if r and all(c in ROMAN for c in r):
        v = [ROMAN[c] for c in r]
        out.add(sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True)))
        v = [ROMAN[c] for c in r.replace("l", "i")]
        out.add(sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True)))
    return out


def is_wrapped(lines: list[str]) -> bool:
    """Whether the lines are those of printed pages: a good part goes on in the next line."""
    full = [x.strip() for x in lines if x.strip()]
    on = 0
    for a, b in zip(full, full[1:], strict=False):
        if (a[-1].isalnum() or a[-1] in ",;" or a[-1] in HYPHENS) and len(a) >= 24 and not b[0].isdigit() and not b[0].isupper():
            on += 1
    return on >= max(1, min(3, len(full) - 1)) and on * 4 >= len(full)


def key_of(s: str) -> str:
    """Letters of a heading with the confusions folded away."""
    s = s.lower().translate(str.maketrans("01|!569", "ollisbg"))
    for a, b in (("rn", "m"), ("ii", "u"), ("ri", "n"), ("li", "h"), ("cl", "d"), ("vv", "w")):
        s = s.replace(a, b)
    return "".join(c for c in s if c.isalnum())


def key_column(c: Column) -> Column:
    """key_of() as a column."""
    s = F.translate(F.lower(c), "01|!569", "ollisbg")
    for a, b in (("rn", "m"), ("ii", "u"), ("ri", "n"), ("li", "h"), ("cl", "d"), ("vv", "w")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def _masks(key: str) -> set[str]:
    """The key with each of its characters left open in turn: keys of one length that differ in one character share one."""
    return {f"{key[:i]}?{key[i + 1 :]}" for i in range(len(key))}


def page_lines(lines: list[str], first: int | None, last: int | None) -> tuple[set[int], dict[int, str], set[int]]:
    """Lines (from 0) that are furniture for certain; candidates for running heads with their text; those of them at a page's edge."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    edge = {at[0], at[-1], *at[1:2], *at[-2:-1]}
    width = sorted(len(lines[i].rstrip()) for i in at)[len(at) * 9 // 10]
    # no page is so much wider than its text
    widest = max(75, width * 3 // 2)
    sure: set[int] = set()
    maybe: dict[int, str] = {}
    loose: dict[int, set[int]] = {}

    def fits(values: set[int]) -> bool:
        return any(first <= v <= (last if last is not None else first) for v in values)

    for i in at:
        s = lines[i].strip()
        if len(s) > widest or s[-1] in ",;":
            continue
        if len(s) <= 16 and (m := BARE.fullmatch(s)):
            v = number_of(m[1])
            if first is not None:
                if fits(v):
                    sure.add(i)
            else:
                loose[i] = v
            continue
        if m := HEADED.fullmatch(s):
            n, x = (m[1], m[2]) if m[1] else (m[4], m[3])
            v = number_of(n)
            if v and (first is None or fits(v)) and any(c.isalpha() for c in x):
                sure.add(i)
                continue
    if loose:  # no page numbers known: they must rise by one, or stand at an edge
        up, down = Counter(), Counter()
        for r, v in enumerate(loose.values()):
            up.update({a - r for a in v})
            down.update({a + r for a in v})
        sure |= {i for r, (i, v) in enumerate(loose.items()) if any(up[a - r] > 1 or down[a + r] > 1 for a in v)}
    for k, i in enumerate(at):
        if i in sure:
            continue
        s = lines[i].strip()
        bracket = s[0] == "[" and s[-1] == "]"
        if len(s) > widest or not bracket and s[-1] in ".!?,;:”»\"" + HYPHENS:
            continue
        beside = k and at[k - 1] in sure or k + 1 < len(at) and at[k + 1] in sure
        short = len(lines[i].rstrip()) < width - 10
        capital = s.isupper() or s.istitle()
        if bracket or i in edge or beside and (short or capital) or short or capital:
            if any(c.isalpha() for c in s):
                maybe[i] = s
    # a heading that comes again is a running head
    keys = {i: k for i, s in maybe.items() if len(k := key_of(s)) > 3}
    seen = Counter(m for k in keys.values() for m in _masks(k))
    sure |= {i for i, k in keys.items() if any(seen[m] > 1 for m in _masks(k))}
    place = {i: k for k, i in enumerate(at)}
    outer = {i for i in maybe if i in edge or not {at[place[i] - 1], at[min(place[i] + 1, len(at) - 1)]}.isdisjoint(sure)}
    return sure, {i: s for i, s in maybe.items() if i not in sure}, outer


def broken_lines(lines: list[str], skip: set[int], known, counts=None, wanted: set[str] | None = None) -> tuple[dict[int, int], dict[int, tuple[int, str, str]]]:
    """Lines whose last word goes on ({line: next line}), and the joined words.

    `counts` are those of all words that the lexicon `known` lacks and a hyphen asks for; `wanted`,
    if given, gets these words.
    """
    broken: dict[int, int] = {}
    joined: dict[int, tuple[int, str, str]] = {}
    counts = counts or {}
    n = lambda w: known.get(w) or counts.get(w, 0)
    for i, x in enumerate(lines):
        if i in skip:
            continue
        s = x.rstrip()
        if not s or s[-1] not in HYPHENS or not (m := HYPHEN_END.search(s)):
            continue
        j, passed = i + 1, False
        while j < len(lines) and (j in skip or not lines[j].strip() and passed):
            passed = True
            j += 1
        if j >= len(lines) or not lines[j].strip():
            if m[1] in SOFT:
                broken[i] = j
            continue
        right = FIRST_WORD.match(lines[j])
        left = LAST_WORD.search(s[:-1])
        if not right or not left:
            if m[1] in SOFT:
                broken[i] = j
            continue
        r0 = right[1]
        a, b = left[0].lower().replace("‐", "-"), r0.lower().replace("‐", "-")
        whole, compound = a + b, f"{a}-{b}"
        # with one of the two in the lexicon, the other is rarer
        ask = wanted is not None and whole not in known and compound not in known
        if ask:
            wanted.add(whole)
        if m[1] not in SOFT:
            if r0[0].isupper() and not left[0].isupper():
                continue
            # another form of a compound (its genitive, say)?
            stems = [re.sub(r"['’]\w*\Z", "", w) for w in (whole, compound)]
            if ask:
                wanted.update((compound, a, b, *stems))
            kw, kc = n(whole), n(compound)
            if max(kw, kc) >= FREQUENT:
                if kc > kw:
                    continue
            elif len(a) > 3 and len(b) > 3 and n(a) >= FREQUENT and n(b) >= FREQUENT:
                if kc >= kw:
                    continue
            elif kc > kw or n(stems[1]) > n(stems[0]):
                continue
        broken[i] = j
        joined[i] = (j, a, b)
    return broken, joined


ITEM = T.StructType(
    [T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("cut", T.IntegerType()), T.StructField("next_no", T.IntegerType())]
)
CONFUSED = tuple(sorted({a for a, _ in CONFUSIONS}))


def findings(text: str | None, first: int | None, last: int | None, known: dict[str, int], own: list | None = None) -> list[tuple]:
    """Rows of ITEM for one text: furniture and broken for certain; head and word for the joins to judge.

    A text of which a hyphen, or whether a line is language, can't be judged by the lexicon gives
    only the words it asks for, and itself. With their counts, `own` (word, count, whether it is no misread
    one), it gives its findings, and any other text nothing.
    """
    if not text or "\n" not in text:
        return []
    lines = text.split("\n")
    if not is_wrapped(lines):
        return []
    counts = {r["key"]: r["n"] for r in own or ()}
    rare = {r["key"] for r in own or () if r["good"] and r["n"] >= FREQUENT and not inside(r["key"])}
    sure, maybe, outer = page_lines(lines, first, last)
    asked: set[str] = set()
    broken, joined = broken_lines(lines, sure | set(maybe), known, counts, asked)
    # a candidate that is a text line after all may itself be broken
    more, joined2 = broken_lines(lines, sure, known, counts, asked)
    tokens = [words(x) if i not in sure else [] for i, x in enumerate(lines)]
    for found in tokens:
        if 2 * sum(w in known for w in found) <= len(found):
            asked.update(w for w in found if w not in known)
    if asked and own is None:
        return [*((0, "ask", w, None, None) for w in asked), (0, "text", text, first, last)]
    if not asked and own is not None:
        return []
    out: list[tuple] = [(i + 1, "furniture", None, None, None) for i in sorted(sure)]
    out += [(i + 1, "head", s.strip("[] "), int(i in outer), None) for i, s in maybe.items()]
    for i, j in more.items():
        if i in maybe or i not in broken and (j not in maybe or i in joined2 and (known.get(w := joined2[i][1] + joined2[i][2]) or counts.get(w))):
            broken[i] = j
            if i in joined2:
                joined[i] = joined2[i]
    out += [(i + 1, "broken", None, None, None) for i in sorted(broken)]
    heads: set[int] = set()
    for i, found in enumerate(tokens):
        if not found:
            continue
        if i in joined and found[-1] == joined[i][1]:
            found.pop()
            j, a, b = joined[i]
            w = a + b
            heads.add(j)
            if w not in known and w not in rare:
                out.append((i + 1, "word", w, len(a), j + 1))
        start = 1 if i in heads else 0
        # lines of no known words are no language; of a word or two, only the join with the frequent words can tell
        legible = 2 * sum(w in known or w in rare for w in found) >= len(found)
        few = len(found) < 3
        for w in found[start:]:
            if w in known or w in rare or len(w) < 3 or not legible and not few:
                continue
            if any(c in w for c in CONFUSED):
                out.append((i + 1, "word", w, None, None))
    return out


def anagram_hash(c: Column) -> Column:
    """Sum over the characters of 40 bits of each one's 64-bit hash."""
    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda s, x: s + F.shiftrightunsigned(F.xxhash64(x), 24))


def _hash(s: str) -> int:
    """anagram_hash() of a string."""
    import xxhash

    return sum(xxhash.xxh64_intdigest(c.encode("utf-8", "replace"), seed=42) >> 24 for c in s)


def corrections(counts: DataFrame) -> DataFrame:
    """(word, fix, place): for each rare word that one confusion turns into a frequent word, the most frequent such word and where they differ (from 0).

    A word with a digit or stroke inside need only be rarer than the frequent one. Words longer than
    the longest frequent word and its confusions can have no fix and are passed over.
    """
    often = counts.where((F.col("n") >= FREQUENT) & (F.length("key") > 2))
    longest = (often.agg(F.max(F.length("key"))).first()[0] or 0) + 2
    sized = counts.where(F.length("key").between(2, longest)).select("key", "n")
    true = often.select(F.col("key").alias("fix"), F.col("n").alias("n_fix"), anagram_hash(F.col("key")).alias("h"))
    rare = sized.select(F.col("key").alias("word"), "n", anagram_hash(F.col("key")).alias("h0"))
    confusion = lambda a, b: F.struct(F.lit(a).alias("misread"), F.lit(b).alias("true_part"), F.lit(_hash(b) - _hash(a)).alias("shift"))
    held = rare.withColumn("c", F.explode(F.array(*(F.when(F.col("word").contains(a), confusion(a, b)) for a, b in CONFUSIONS)))).where("c is not null")
    shifted = held.select("word", "n", "c.misread", "c.true_part", (F.col("h0") + F.col("c.shift")).alias("h"))
    same = "filter(sequence(1, length(word)), p -> substring(word, p, length(misread)) = misread and concat(substring(word, 1, p - 1), true_part, substring(word, p + length(misread))) = fix)"
    letters = F.col("misread").rlike(r"^\p{L}$") & F.col("true_part").rlike(r"^\p{L}$")
    roman = F.col("fix").rlike("^[ivxlc]+$")
    digit = F.exists(F.split("word", "-"), lambda part: part.rlike(INSIDE_SQL))
    enough = F.col("n_fix") >= F.when(digit, F.lit(1)).when(letters, F.lit(LETTER_RATIO)).otherwise(F.lit(RATIO)) * F.col("n")
    met = shifted.join(true, "h").where(enough & (F.col("word") != F.col("fix")) & ~roman & (F.abs(F.length("fix") - F.length("word")) < 3)).withColumn("at", F.expr(same)).where(F.size("at") > 0)
    return met.groupBy("word").agg(F.max_by(F.struct("fix", (F.expr("at[0]") - 1).alias("place")), F.struct("n_fix", "fix")).alias("x")).select("word", "x.fix", "x.place")


def scan_findings(chapters: DataFrame, books: DataFrame, lexicon: int = LEXICON) -> tuple[DataFrame, DataFrame]:
    """(chapter_id, row, line_no, kind) of all findings, and (chapter_id, row, line_no, word, fix) of the misread words.

    chapters: chapter_id, book_id, text, page_start, page_end; books: book_id, title, author. Null,
    empty and unpaged texts give no row; each repeated chapter gives its own. Lines count from 1; row
    is a digest of the text, so that different texts under one id keep their findings apart.
    The `lexicon` most frequent words that are no misread ones go to every task; any other word
    and hyphen is judged by a join with the counts, and the findings do not depend on its size. A
    word with a digit or stroke inside is never taken for a true one, however often it occurs:
    counts grow with the corpus. A word is misread only if the join finds what it was.
    """
    counts = checkpointed(count_tokens(chapters, "text", words))
    fixes = checkpointed(corrections(counts))
    good = counts.join(fixes, counts["key"] == fixes["word"], "left_anti")
    known = {r["key"]: r["n"] for r in good.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(lexicon).collect() if not inside(r["key"])}
    shared = chapters.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([chapters.schema["chapter_id"], T.StructField("row", T.LongType()), chapters.schema["book_id"], *ITEM])

    def make():
        lexicon_ = shared.value

        def of(ids, digests, books_, texts, firsts, lasts, owns):
            out = {f.name: [] for f in schema}
            for i, r, b, t, p, q, own in zip(ids, digests, books_, texts, firsts, lasts, owns, strict=True):
                for row in findings(t, p, q, lexicon_, own):
                    for f, v in zip(out, (i, r, b, *row), strict=True):
                        out[f].append(v)
            return out

        return of

    cast = chapters.select("chapter_id", F.xxhash64(F.col("text").cast("string")).alias("row"), "book_id", F.col("text").cast("string"), F.col("page_start").cast("int"), F.col("page_end").cast("int"))
    cast = cast.where(F.instr("text", "\n") > 0)
    cast = cast.withColumn("own", F.lit(None).cast("array<struct<key:string,n:bigint,good:boolean>>"))
    once = checkpointed(map_columns(cast, cast.columns, schema, make))
    # texts whose hyphens and lines the lexicon can't judge come again with the counts of their words; the others stay where they are
    wanted = once.where("kind = 'ask'").select(F.col("chapter_id").alias("__id"), F.col("row").alias("__row"), "key").distinct()
    judged = wanted.join(counts, "key", "left").join(fixes.select(F.col("word").alias("key"), F.lit(False).alias("good")), "key", "left")
    entry = F.when(F.col("n").isNotNull(), F.struct("key", "n", F.coalesce("good", F.lit(True)).alias("good")))
    own = judged.groupBy("__id", "__row").agg(F.collect_list(entry).alias("own"))
    unsettled = once.where("kind = 'text'").select("chapter_id", "row", "book_id", F.col("key").alias("text"), F.col("cut").alias("page_start"), F.col("next_no").alias("page_end"))
    asking = unsettled.join(own, F.col("chapter_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))).drop("__id", "__row")
    items = checkpointed(once.where("kind not in ('ask', 'text')").unionAll(map_columns(asking, asking.columns, schema, make)))

    # running heads: the title or the author, but for misread characters
    names = books.select("book_id", F.explode(F.array("title", "author")).alias("name")).where("name is not null").withColumn("name_key", key_column(F.col("name"))).where(F.length("name_key") > 2)
    # a signature mark: the author's last name and a letter
    last = books.where("author is not null").select("book_id", key_column(F.element_at(F.split(F.trim("author"), r"\s+"), -1)).alias("last_key")).where(F.length("last_key") > 2)
    head = items.where("kind = 'head'").withColumn("head_key", key_column(F.col("key"))).where(F.length("head_key") > 2)
    near = F.levenshtein("head_key", "name_key") <= F.greatest(F.lit(1), F.floor(F.length("name_key") / 8))
    heads = head.join(names, "book_id").where((F.abs(F.length("head_key") - F.length("name_key")) < 4) & near).select("chapter_id", "row", "line_no")
    mark = head.where(F.col("key").rlike(r"^\S+ ([A-Za-z]\d?|\d{1,2})$")).withColumn("mark_key", key_column(F.substring_index("key", " ", 1)))
    alone = (F.col("cut") == 1) & F.col("key").rlike(r"^\p{Lu}\p{L}+ [A-Z]$")
    marks = mark.join(last, "book_id", "left").where((F.levenshtein("mark_key", "last_key") <= 1) | alone).select("chapter_id", "row", "line_no")
    # where the book has no such name: the same head at the page edges of several chapters
    again = head.where("cut = 1").groupBy("book_id", "head_key").agg(F.count("*").alias("times"), F.min("chapter_id").alias("lo"), F.max("chapter_id").alias("hi")).where("times > 2 and lo <> hi")
    marks = marks.unionAll(head.where("cut = 1").join(again, ["book_id", "head_key"], "left_semi").select("chapter_id", "row", "line_no"))
    furniture = items.where("kind = 'furniture'").select("chapter_id", "row", "line_no").unionAll(heads).unionAll(marks).distinct()

    broken = items.where("kind = 'broken'").select("chapter_id", "row", "line_no")

    # of a word broken over two lines, the line that holds the misread character
    asked = items.where("kind = 'word'").withColumnRenamed("key", "word").join(fixes, "word")
    misread = asked.select("chapter_id", "row", F.when(F.col("place") >= F.col("cut"), F.col("next_no")).otherwise(F.col("line_no")).alias("line_no"), "word", "fix")
    found = (
        broken.withColumn("kind", F.lit("broken"))
        .unionAll(misread.select("chapter_id", "row", "line_no", F.lit("misread").alias("kind")))
        .distinct()
        .join(furniture, ["chapter_id", "row", "line_no"], "left_anti")
        .unionAll(furniture.withColumn("kind", F.lit("furniture")))
    )
    return found, misread


def repair_scans(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(chapter_id, repaired): the text in paragraphs, without furniture, broken words joined, misread words corrected.

    Texts without findings come out as they are, null stays null; each repeated chapter gives its own.
    """
    found, misread = scan_findings(chapters, books)
    marks = found.groupBy("chapter_id", "row").agg(F.collect_list(F.struct("line_no", "kind")).alias("marks"))
    fixes = misread.distinct().groupBy("chapter_id", "row").agg(F.collect_list(F.struct("line_no", "word", "fix")).alias("fixes"))
    schema = T.StructType([chapters.schema["chapter_id"], T.StructField("repaired", T.StringType())])
    texts = chapters.select("chapter_id", F.col("text").cast("string").alias("__text")).withColumn("row", F.xxhash64("__text"))
    joined = texts.join(marks, ["chapter_id", "row"], "left").join(fixes, ["chapter_id", "row"], "left")

    def make():
        return lambda ids, texts, m, f: {"chapter_id": ids, "repaired": [paragraphs(t, a or [], b or []) if t is not None else None for t, a, b in zip(texts, m, f, strict=True)]}

    return map_columns(joined, ["chapter_id", "__text", "marks", "fixes"], schema, make)


def _cased(fix: str, word: str) -> str:
    """The fix in the letter case of the word."""
    return fix.upper() if word.isupper() and len(word) > 1 else fix.capitalize() if word[0].isupper() else fix


def paragraphs(text: str, marks: list[dict], fixes: list[dict]) -> str:
    """Lines of a paragraph joined; a paragraph begins behind an empty line or with an indented line."""
    if not marks and not fixes:
        return text
    kinds: dict[int, set[str]] = {}
    for m in marks:
        kinds.setdefault(m["line_no"], set()).add(m["kind"])
    put: dict[int, list[tuple[str, str]]] = {}
    for f in fixes:
        put.setdefault(f["line_no"], []).append((f["word"], f["fix"]))
    lines = text.split("\n")
    bodies = {i: x.strip() for i, x in enumerate(lines, 1) if "furniture" not in kinds.get(i, ())}
    # a word broken over two lines is corrected as a whole: all of it goes to the first line
    full = [i for i, x in bodies.items() if x]
    moved: set[int] = set()
    for i, j in zip(full, full[1:], strict=False):
        if "broken" not in kinds.get(i, ()) or not (at := [*put.get(i, []), *put.get(j, [])]):
            continue
        head = bodies[i].rstrip(HYPHENS)
        left, right = LAST_WORD.search(head), FIRST_WORD.match(bodies[j])
        if not left or not right:
            continue
        word = left[0] + right[1]
        fix = next((b for a, b in at if a == word.lower().replace("‐", "-")), None)
        if fix:
            # the line's mark stays: what follows in the next line is glued
            bodies[i] = head[: left.start()] + _cased(fix, word) + bodies[i][len(head) :]
            bodies[j] = bodies[j][right.end() :]
            moved.add(j)
    out: list[str] = []
    glue = False
    for i, body in bodies.items():
        k, line = kinds.get(i, set()), lines[i - 1]
        for a, b in put.get(i, []):
            body = re.sub(rf"(?<![^\W_]){re.escape(a)}(?![^\W_])", lambda m, b=b: _cased(b, m[0]), body, flags=re.I)
        if not body and i in moved:
            glue = False
            continue
        if not body:
            if not glue:
                out.append("")
            continue
        new = not out or not out[-1] or line[:2].isspace() and len(line[:2]) == 2
        if "broken" in k:
            body = body.rstrip(HYPHENS)
        if glue:
            out[-1] += body
        elif new:
            out.append(body)
        else:
            out[-1] += ("" if out[-1].endswith(("-", "‐")) else " ") + body
        glue = "broken" in k
    return "\n\n".join(p for p in out if p)
