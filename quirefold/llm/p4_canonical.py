"""One consistent form for text that looks the same, and the rows that look the same.

A transducer reads grapheme clusters (a character with the marks and invisible characters behind it).
Its rules for widths, joined letters, blanks, hyphens and invisible characters, its canonical
decompositions and its look-alikes are compiled once and checked for conflicts; its states are the
letters composed so far, with an arc for each mark that composes further, so that the longest
composition wins. Every cluster is looked up once, under the alphabet of its word: a look-alike letter
becomes the letter of that alphabet before its marks are composed. A word's alphabet is that of its
letters without look-alikes, else that of the line's, else Latin, so it depends on the look alone.

Clusters of one character, and those met before, are arrays indexed by a symbol; a cluster met for
the first time goes through the transducer's arcs.
"""

from __future__ import annotations

import functools
import hashlib
import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import checkpointed, map_columns, passes, points

# Letters that look alike, Cyrillic or Greek to Latin.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝѵүАВЕКМНОРСТХІЈЅҮԜԚӀ", "aeopcyxijshdqwvyABEKMHOPCTXIJSYWQI", strict=True))
GREEK = dict(zip("οναϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovacjABEZHIKMNOPTYX", strict=True))
# Accented letters that look alike.
CYRILLIC |= {"ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï", "ѐ": "è", "Ѐ": "È", "ӑ": "ă", "ӓ": "ä", "ӧ": "ö", "ӥ": "ӥ"}
GREEK |= {"ό": "ó", "Ό": "Ό"}
#: Hyphens of the same look.
HYPHENS = "\u2010\u2011\ufe63\uff0d"
#: Invisible characters besides the category Cf.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" + "".join(map(chr, range(0xFE00, 0xFE10)))
NONE, LATIN, CYR, GRK = range(4)
ALPHABETS = (NONE, LATIN, CYR, GRK)
N = sys.maxunicode + 1
#: Clusters of several characters that a worker remembers (one batch may hold more).
HELD = 1 << 16
#: The accent of Greek capitals stands before the letter: such a letter is no look-alike of one with an accent on top.
TONOS = "\u0301"


def _rules() -> dict[str, str]:
    """What single characters become, whatever stands around them; raises if two rules disagree or a result would be changed again."""
    rules: dict[str, str] = {}

    def rule(a: str, b: str) -> None:
        if a != b and rules.setdefault(a, b) != b:
            raise ValueError(f"conflict: {a!r} to {b!r} and {rules[a]!r}")

    wide = (*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFA0), *range(0xFFA1, 0xFFBF), *range(0xFFE0, 0xFFE7), *range(0xFB00, 0xFB07), 0x132, 0x133, *range(0x1C7, 0x1CD), *range(0x1F1, 0x1F4), *range(0x1D400, 0x1D800))
    for c in wide:
        rule(chr(c), "-" if chr(c) in HYPHENS else unicodedata.normalize("NFKC", chr(c)))
    for c in range(N):
        k = unicodedata.category(chr(c))
        if k == "Zs":
            rule(chr(c), " ")
        elif k == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2) and not 0x110BD <= c <= 0x110CD and not 0x13430 <= c <= 0x1343F:  # those are visible
            rule(chr(c), "")
    for c in INVISIBLE:
        rule(c, "")
    for c in HYPHENS:
        rule(c, "-")
    for a, b in rules.items():
        if any(rules.get(x, x) != x for x in b):
            raise ValueError(f"{a!r} becomes {b!r}, which would change again")
    return rules


def _alike() -> tuple[dict[str, str], ...]:
    """For each alphabet, what letters of the others become in it; raises if letters of one look end up apart."""
    latin = {a: b for a, b in (CYRILLIC | GREEK).items() if len(unicodedata.normalize("NFD", a)) == 1 and a != b}
    out: list[dict[str, str]] = [{}, latin, {}, {}]
    for own, table in ((CYR, CYRILLIC), (GRK, GREEK)):
        for a, b in table.items():
            if latin.get(a) == b:
                out[own].setdefault(b, a)
        for a, b in latin.items():
            if a not in table and b in out[own]:
                out[own][a] = out[own][b]
        # two letters of this alphabet with one Latin look are one look
        out[own] |= {a: out[own][b] for a, b in table.items() if latin.get(a) == b and out[own][b] != a}
    for to in out:
        if any(to.get(b, b) != b for b in to.values()):
            raise ValueError("a look-alike would change again")
    return tuple(out)


class Transducer:
    """The compiled tables and arcs; out[alphabet][symbol] is a code point, or from N on the place of a longer (or empty) result."""

    def __init__(self):
        self.rules = _rules()
        self.to = _alike()
        looks = {x for to in self.to for ab in to.items() for x in ab}
        # arcs: letter so far and mark to the composed letter
        self.arcs: dict[tuple[str, str], str] = {}
        composed = [c for c in map(chr, range(N)) if (d := unicodedata.decomposition(c)) and d[0] != "<" and " " in d and unicodedata.normalize("NFC", c) == c]
        for c in composed:
            a, b = (chr(int(x, 16)) for x in unicodedata.decomposition(c).split())
            self.arcs[a, b] = c
        for lead in range(19):  # Hangul, by rule
            for vowel in range(21):
                pair = chr(0xAC00 + (lead * 21 + vowel) * 28)
                self.arcs[chr(0x1100 + lead), chr(0x1161 + vowel)] = pair
                for tail in range(1, 28):
                    self.arcs[pair, chr(0x11A7 + tail)] = chr(ord(pair) + tail)
        # what never begins a cluster
        self.extends = np.zeros(N, bool)
        for c in range(0x300, N):
            x = chr(c)
            if unicodedata.combining(x) or self.rules.get(x) == "":
                self.extends[c] = True
        self.extends[[ord(b) for _, b in self.arcs]] = True
        self.extends[0xAD] = True
        self.bars = np.zeros(N, bool)
        self.bars[[c for c in range(0xA0) if unicodedata.category(chr(c)) == "Cc"]] = True
        script = np.zeros(N, np.uint8)
        for lo, hi, s in ((0x41, 0x24F, LATIN), (0x1E00, 0x1EFF, LATIN), (0x370, 0x3FF, GRK), (0x1F00, 0x1FFF, GRK), (0x400, 0x52F, CYR)):
            for c in range(lo, hi + 1):
                if unicodedata.category(chr(c))[0] == "L":
                    script[c] = s
        self.letters = script
        self.script = np.zeros(N + HELD, np.uint8)
        self.alike = np.zeros(N + HELD, bool)
        self.out = np.tile(np.arange(N + HELD, dtype=np.uint32), (4, 1))
        self.longer: list[str] = []
        self.places: dict[str, int] = {}
        self.script[:N] = script
        self.looks = frozenset(looks)
        for c in range(N):
            x = chr(c)
            if x in self.rules or x in looks or unicodedata.decomposition(x)[:1] not in ("", "<"):
                self._compile(c, x)
        self.changes = (self.out[:, :N] != np.arange(N)).any(0) | self.extends
        self.compiled = len(self.longer)
        self.held: dict[str, int] = {}

    def _compile(self, symbol: int, cluster: str) -> None:
        base = self._apart(cluster)
        marks = len(base) > 1 and not self.letters[ord(base[1])]
        firsts = [x for x in base if self.letters[ord(x)]]
        self.script[symbol] = self.letters[ord(firsts[0])] if firsts else 0
        self.alike[symbol] = bool(firsts) and all(x in self.looks for x in firsts) and not (marks and self._greek_capital(base, 0))
        for s in ALPHABETS:
            text = self._compose(base, s)
            if len(text) == 1:
                self.out[s, symbol] = ord(text)
            else:
                if text not in self.places:
                    self.places[text] = len(self.longer)
                    self.longer.append(text)
                self.out[s, symbol] = N + self.places[text]

    def _greek_capital(self, seq: list[str], i: int) -> bool:
        return self.letters[ord(seq[i])] == GRK and seq[i].isupper() and seq[i + 1 : i + 2] == [TONOS]

    def _apart(self, cluster: str) -> list[str]:
        """The rules' results, decomposed, marks in canonical order."""
        rules = self.rules
        seq = [y for c in cluster for x in rules.get(c, c) for y in unicodedata.normalize("NFD", x)]
        seq = [y for c in seq for y in rules.get(c, c)]
        i = 0
        while i < len(seq):  # stable sort of each run of marks
            j = i
            while j < len(seq) and unicodedata.combining(seq[j]):
                j += 1
            if j - i > 1:
                seq[i:j] = sorted(seq[i:j], key=unicodedata.combining)
            i = max(j, i + 1)
        return seq

    def _compose(self, seq: list[str], alphabet: int) -> str:
        """The letters of the alphabet, then along the arcs as far as marks lead."""
        to = self.to[alphabet]
        out: list[str] = []
        letter, last = -1, 0  # where the letter so far stands, and the class of the mark kept last behind it
        for i, c in enumerate(seq):
            if c in to and not self._greek_capital(seq, i):
                c = to[c]
            k = unicodedata.combining(c)
            if letter >= 0 and (len(out) == letter + 1 or last < k) and (got := self.arcs.get((out[letter], c))):
                out[letter] = got
                continue
            if k == 0:
                letter, last = len(out), 0
            else:
                last = k
            out.append(c)
        return "".join(out)

    def symbol(self, cluster: str) -> int:
        got = self.held.get(cluster)
        if got is None:
            got = self.held[cluster] = N + len(self.held)
            self._compile(got, cluster)
        return got

    def room(self, clusters: int) -> None:
        """Forgets the clusters met before if so many more would not fit, and grows where they alone would not."""
        held = len(self.script) - N
        if len(self.held) + clusters <= held:
            return
        self.held.clear()
        for text in self.longer[self.compiled :]:
            del self.places[text]
        del self.longer[self.compiled :]
        if clusters > held:
            more = clusters - held
            self.script, self.alike = np.append(self.script, np.zeros(more, np.uint8)), np.append(self.alike, np.zeros(more, bool))
            self.out = np.concatenate([self.out, np.zeros((4, more), np.uint32)], 1)


@functools.cache
def transducer() -> Transducer:
    return Transducer()


@functools.cache
def changed() -> frozenset[str]:
    """Characters that the canonical form may change: those with a rule, marks, and letters of other alphabets that look like Latin ones."""
    t = transducer()
    simple = (t.out[NONE, :N] != np.arange(N)) | t.extends | t.alike[:N] & (t.script[:N] > LATIN)
    return frozenset(map(chr, np.flatnonzero(simple).tolist()))


def canonical(texts: list[str | None]) -> list[str | None]:
    """The canonical form of each text; null stays null."""
    out: list[str | None] = [None] * len(texts)
    t = transducer()
    for lo, hi in passes(texts):
        part = [(x or "") + "\n" for x in texts[lo:hi]]
        if all(map(str.isascii, part)):
            cp = points("".join(part))
        else:
            cp = _apply(points("".join(part)), t)
        cp = _no_trailing(cp)
        # line feeds are never changed, so the texts come apart at theirs
        counts = np.cumsum([x.count("\n") for x in part])
        feeds = np.flatnonzero(cp == 10)
        whole = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        a = 0
        for i, c in zip(range(lo, hi), counts, strict=True):
            b = int(feeds[c - 1])
            if texts[i] is not None:
                out[i] = whole[a:b]
            a = b + 1
    return out


def _no_trailing(cp: np.ndarray) -> np.ndarray:
    """Without blanks at line ends, which nobody sees."""
    blank = (cp == 32) | (cp == 9) | (cp == 13)
    hit = np.flatnonzero(blank & np.append(cp[1:] == 10, False))
    if not len(hit):
        return cp
    last = np.maximum.accumulate(np.where(~blank, np.arange(len(cp)), -1))
    drop = np.zeros(len(cp) + 1, np.int32)
    np.add.at(drop, last[hit] + 1, 1)
    np.add.at(drop, hit + 1, -1)
    return cp[np.cumsum(drop[:-1]) == 0]


def _apply(cp: np.ndarray, t: Transducer) -> np.ndarray:
    hot = t.changes[cp]
    if not hot.any() and not (t.letters[cp] > LATIN).any():
        return cp
    ext = t.extends[cp]
    ext[0] = False
    ext[1:] &= ~t.bars[cp[:-1]]
    # the symbol of each cluster: its code point, or that of a cluster of several
    if ext.any():
        start = np.flatnonzero(~ext)
        size = np.diff(np.append(start, len(cp)))
        sym = cp[start].astype(np.int64)
        two, more = np.flatnonzero(size == 2), np.flatnonzero(size > 2)
        pairs, of = np.unique(sym[two] << 21 | cp[start[two] + 1], return_inverse=True)
        strings = ["".join(map(chr, cp[a : a + n].tolist())) for a, n in zip(start[more].tolist(), size[more].tolist(), strict=True)]
        several = dict.fromkeys(strings)
        t.room(len(pairs) + len(several))
        sym[two] = np.array([t.symbol(chr(k >> 21) + chr(k & 0x1FFFFF)) for k in pairs.tolist()], np.int64)[of] if len(pairs) else sym[two]
        sym[more] = [t.symbol(x) for x in strings]
    else:
        sym = cp.astype(np.int64)
    alphabet = np.zeros(len(sym), np.uint8)
    script = t.script[sym]
    if (script > LATIN).any():
        # the alphabet of each word, from its letters without look-alikes; else the line's
        letter = script > 0
        begin = letter & ~np.append(False, letter[:-1])
        word = np.cumsum(begin) - 1
        at = np.flatnonzero(letter)
        plain = ~t.alike[sym[at]]
        n = int(begin.sum())
        votes = np.bincount(word[at][plain] * 4 + script[at][plain], minlength=n * 4).reshape(n, 4)
        line = (np.cumsum(sym == 10) - (sym == 10))[np.flatnonzero(begin)]
        by_line = np.zeros((int(line[-1]) + 1 if n else 0, 4), np.int64)
        np.add.at(by_line, line, votes)
        own = np.where(votes[:, 1:].any(1), votes[:, 1:].argmax(1) + 1, np.where(by_line[:, 1:].any(1), by_line[:, 1:].argmax(1) + 1, LATIN)[line])
        alphabet[at] = own[word[at]]
    out = t.out[alphabet, sym]
    far = np.flatnonzero(out >= N)
    if not len(far):
        return out
    texts = [t.longer[k] for k in (out[far] - N).tolist()]
    size = np.ones(len(out), np.int64)
    size[far] = list(map(len, texts))
    longer = np.zeros(len(out), bool)
    longer[far] = True
    wide = np.repeat(out, size)
    wide[np.repeat(longer, size)] = points("".join(texts))
    return wide


def canonical_form(df: DataFrame, key: str = "chapter_id", columns: tuple[str, ...] = ("title", "text"), content: bool = True) -> DataFrame:
    """key, look and raw (16-byte digests of the canonical and the stored columns together), blank (whether the last column is null or empty) and with content the canonical columns.

    Null columns stay null and count as empty in the digests. Repeated rows stay.
    """
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("look", T.BinaryType()), T.StructField("raw", T.BinaryType()), T.StructField("blank", T.BooleanType())]
        + [T.StructField(c, T.StringType()) for c in columns] * content
    )

    def digest(values):
        h = hashlib.blake2b(digest_size=16)
        for v in values:
            v = (v or "").encode("utf-8", "surrogatepass")
            h.update(len(v).to_bytes(8, "big") + v)
        return h.digest()

    def make():
        def of(keys, *cols):
            form = [canonical(c) for c in cols]
            out = {key: keys, "look": [digest(v) for v in zip(*form, strict=True)], "raw": [digest(v) for v in zip(*cols, strict=True)], "blank": [not v for v in cols[-1]]}
            return out | dict(zip(columns, form, strict=True))

        return of

    cast = df.select(F.col(key).alias("__key"), *(F.col(c).cast("string").alias(f"__{i}") for i, c in enumerate(columns)))
    return map_columns(cast, cast.columns, schema, make)


def _forms(df: DataFrame, key: str, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(key, look, raw) of the rows that look like a differently stored one, and (look, raw, n) of their stored forms."""
    form = checkpointed(canonical_form(df, key, columns, content=False).where(~F.col("blank")).select(key, "look", "raw"))
    # partial counts first: a class with a third of all rows is one row for each stored form
    counts = form.groupBy("look", "raw").agg(F.count("*").alias("n"))
    several = counts.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("look")
    return form.join(several, "look", "left_semi"), counts.join(several, "look", "left_semi")


def look_alikes(df: DataFrame, key: str = "chapter_id", columns: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """(key_a, key_b), a < b: rows whose columns all look the same while one differs in a character; the last column not empty.

    Stored forms meet first, then their rows, so that exact copies of one another are never paired.
    """
    rows, forms = _forms(df, key, columns)
    a, b = forms.select("look", F.col("raw").alias("raw_a")), forms.select("look", F.col("raw").alias("raw_b"))
    pairs = a.join(b, "look").where("raw_a < raw_b").select("raw_a", "raw_b")
    left, right = rows.select(F.col("raw").alias("raw_a"), F.col(key).alias("__a")), rows.select(F.col("raw").alias("raw_b"), F.col(key).alias("__b"))
    met = pairs.join(left, "raw_a").join(right, "raw_b").where("__a <> __b")
    return met.select(F.least("__a", "__b").alias(f"{key}_a"), F.greatest("__a", "__b").alias(f"{key}_b"))


def look_classes(df: DataFrame, key: str = "chapter_id", columns: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """(key, class_id, n_forms, n_links) of every row that look_alikes() pairs with another: the class' least key, its stored forms, and with how many rows this one pairs.

    It grows with the rows, not with the pairs. Rows of a null key have no class of their own; repeated rows each count.
    """
    rows, forms = _forms(df, key, columns)
    least = rows.groupBy("look").agg(F.min(key).alias("class_id"), F.count("*").alias("size"))
    of = forms.groupBy("look").agg(F.count("*").alias("n_forms")).join(least, "look")
    sized = forms.join(of, "look").select("raw", "class_id", F.col("n_forms").cast("long"), (F.col("size") - F.col("n")).alias("n_links"))
    return rows.select(key, "raw").join(sized, "raw").select(key, "class_id", "n_forms", "n_links")
