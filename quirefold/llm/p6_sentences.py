"""Sentences of texts in any language and script, as offsets.

A pushdown automaton reads each line: its stack holds the quotation marks and brackets that are
open, and over the lines the list levels, so that an item's marker ends no sentence. A terminator ends a sentence only if the stack is empty after the closing marks that follow
it, if no abbreviation, initial, ordinal or decimal explains the full stop, and if what follows can
begin a sentence (in scripts with letter case: no small letter, also behind a dash). In scripts
without terminators a blank behind letters enough ends a sentence.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import map_columns

# Abbreviations, lower case, without the last full stop.
#: Before a name, a number or a further word; a sentence never ends with them.
NEVER_LAST = """dr mr mrs ms prof st gen gov sgt cpt cpl pvt rev hon vs vol cf ca approx fig no nr nos pp ed eds
sr sra srta dra ej ex mme mlle mm vgl hr hrsg abb bzw sog evtl ggf dhr mevr mej mw ds ir drs
sig sigg sigra dott dottssa avv ing ecc p.es es д-р г-н г-жа проф им ул стр см рис гл
d.h z.b u.a o.ä i.e e.g t.ex p.ex p.ej bl.a d.v.s s.k f.d d.w.z o.a m.b.t т.е т.к т.н т.н. tj tzw np m.in prof zob ok
κ κα κος δρ αρ σελ π.χ δηλ vb bkz örn yy doç av sn dok डॉ श्री प्रो पं д-ра п проф акад ім вул та.ін
د أ ص م هـ feat resp mt ft messrs capt lt col maj esq adm det insp""".split()
#: Often last in a sentence; they end one if a capital follows.
MAY_END = """etc p.m a.m usw u.s.w itd itp i.t.d enz osv m.fl m.m jr sr inc ltd co corp bros dept est
т.д т.п т.і др и.др ін r w zł г г.г гг в вв р рр н.э до н. э кг км руб коп κ.λπ κλπ κ.ά π.μ μ.μ vs i.d av.j.-c j.-c s.a n.chr v.chr u.s u.k""".split()

OPEN = {"“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "{": "}", "（": "）", "《": "》", "【": "】"}
LOW = {"„": "“”", "‚": "‘’"}
CLOSE = set("”»›」』)]}）》】’")
STOP = ".!?…؟।॥。！？．‼⁇⁈⁉۔։።፧།༎။។៕"
WIDE = "。！？．"
#: Terminators behind which no blank need follow.
CLOSE_UP = "।॥؟።፧།༎။។៕۔"
#: Scripts that have no terminators (Thai, Lao): there a blank between two letters ends a sentence of at least so many of them.
UNMARKED = re.compile("[\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0eb9\u0ebb-\u0edf]")
UNMARKED_BLANK = re.compile("(?<=[\u0e01-\u0e4e\u0e81-\u0edf])[ \u00a0]+(?=[\u0e01-\u0e46\u0e81-\u0ec6])")
UNMARKED_LEAST = 24
#: Words before a day's ordinal in German.
BEFORE_ORDINAL = {"am", "dem", "der", "den", "vom", "zum", "im", "des", "das", "die", "bis", "beim", "ein", "einem", "einen", "sein", "ihr"}
LINE = re.compile("[^\\n\\r\\x0b\\x0c\\u2028\\u2029]+")
#: What the automaton must look at; everything else passes.
EVENT = re.compile("[" + re.escape(STOP + "".join(OPEN) + "".join(LOW) + "".join(CLOSE) + "\"'‘" + "“") + "]")
#: What a list item begins with, and the Roman numerals that count items.
MARKER = re.compile(r"((?:\d{1,3}\.)*\d{1,3}|[A-Za-z]|[IVX]{2,7}|[ivx]{2,7})[.)](?=\s+\S)", re.A)
ROMAN = re.compile(r"x{0,3}(?:ix|iv|v?i{0,3})")
QUOTED = re.compile(r"[.!?,]'(?:\s|$)")
WORD_BEFORE = re.compile(r"[^\s\"“”„«»‹›()\[\]{}—–/]+\Z")
DASH = "-–—―"
#: Blanks inside an abbreviation or before a closing mark.
BLANKS = " \u00a0\u2009\u202f"
#: Last characters of a line behind which a list may begin with any number.
ENDED = frozenset(STOP + ":;：；" + "".join(CLOSE) + "\"'")


@functools.cache
def _trie() -> dict:
    """The abbreviations from their last letter to their first; "" holds whether a sentence may end there."""
    root: dict = {}
    for may, words in ((False, NEVER_LAST), (True, MAY_END)):
        for w in words:
            at = root
            for c in reversed(w.strip(".")):
                at = at.setdefault(c, {})
            at.setdefault("", may)
    return root


@functools.cache
def _combined() -> frozenset[str]:
    """The abbreviations of several words, and what they begin with."""
    return frozenset(".".join(p[: i + 1]) for w in (*NEVER_LAST, *MAY_END) if len(p := w.split(".")) > 1 for i in range(1, len(p)))


def abbreviation(line: str, dot: int) -> bool | None:
    """Whether a sentence may end with the abbreviation before the full stop at `dot`; None if there is none.

    Blanks inside an abbreviation (z. B., т. д.) are passed over.
    """
    at, i, found = _trie(), dot - 1, None
    while i >= 0:
        c = line[i].lower()
        if c not in at:
            if c in BLANKS and i and line[i - 1] == "." and "." in at:
                i -= 1
                continue
            break
        at = at[c]
        i -= 1
        if "" in at and (i < 0 or not (line[i].isalnum() or line[i] in "'’.-" and i and line[i - 1].isalnum() and line[i] != ".")):
            found = at[""]
    return found


def _begins(line: str, at: int) -> str:
    """What the text from `at` on begins with: `up`, `low`, `other` (a caseless letter), `digit`, `none`."""
    n = len(line)
    while at < n:
        c = line[at]
        if c.isalpha():
            return "up" if c.isupper() or c.istitle() else "low" if c.islower() else "other"
        if c.isdigit():
            return "digit"
        at += 1
    return "none"


def _dash_follows(line: str, at: int) -> bool:
    return at < len(line) and line[at] in DASH


def _ordinals(marker: str) -> list[tuple[str, int]]:
    """What a list marker may count: (kind of numbering, place in it)."""
    if marker[-1].isdigit():
        head, _, tail = marker.rpartition(".")
        return [(f"{head}.1", int(tail))]
    case = "I" if marker.isupper() else "i"
    out = [("A" if case == "I" else "a", ord(marker.lower()) - 96)] if len(marker) == 1 else []
    if ROMAN.fullmatch(marker.lower()):
        v = [{"i": 1, "v": 5, "x": 10}[c] for c in marker.lower()]
        out.append((case, sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))))
    return out


def list_marker(line: str, levels: list[list], free: bool) -> int:
    """Length of the list marker that the line begins with, 0 if there is none; `levels` are brought up to date.

    A marker goes on with a level that is open (the levels within it close), or opens one: the first of
    its numbering anywhere. Any other number does so only where the line is `free`: the text before it is at an
    end, or an item.
    """
    m = MARKER.match(line)
    if not m:
        return 0
    ways = _ordinals(m[1])
    for depth in range(len(levels) - 1, -1, -1):
        for kind, n in ways:
            if levels[depth][0] == kind and (n == levels[depth][1] + 1 or free and n > levels[depth][1]):
                del levels[depth + 1 :]
                levels[depth][1] = n
                return m.end(1) + 1
    for kind, n in sorted(ways, key=lambda x: x[1]):
        if n == 1 or free:
            levels.append([kind, n])
            return m.end(1) + 1
    return 0


def line_ends(line: str, marker: int = 0) -> list[int]:
    """Ends (exclusive) of the sentences of one line, without blanks behind them; a list marker of so many characters ends none.

    Marks that open and never close open nothing: the line is read again without them.
    """
    last = _last_marks(line)
    ignored: set[int] = set()
    while True:
        ends, unclosed = _read(line, ignored, last, marker)
        if not unclosed:
            return _without_terminators(line, ends) if UNMARKED.search(line) else ends
        ignored |= unclosed


def _without_terminators(line: str, ends: list[int]) -> list[int]:
    """The ends, and within the pieces that are mostly of a script without terminators those at blanks."""
    out: list[int] = []
    begin = 0
    for end in ends:
        if len(UNMARKED.findall(line, begin, end)) * 2 > end - begin:
            at = begin
            for m in UNMARKED_BLANK.finditer(line, begin, end):
                if len(UNMARKED.findall(line, at, m.start())) >= UNMARKED_LEAST:
                    out.append(m.start())
                    at = m.end()
        out.append(end)
        begin = end
    return out


def _last_marks(line: str) -> dict[str, int]:
    """Where the last of each mark that may close stands; of ' the last that ends a quotation."""
    last = {c: line.rfind(c) for c in "\"”’"}
    last["'"] = max((m.start() + 1 for m in QUOTED.finditer(line)), default=-1) if "'" in line else -1
    return last


def _read(line: str, ignored: set[int], last: dict[str, int], marker: int = 0) -> tuple[list[int], set[int]]:
    """The ends, and the positions of marks that stayed open."""
    n = len(line.rstrip())
    if not n:
        return [], set()
    ends: list[int] = []
    number = int(line[: marker - 1]) if marker and line[: marker - 1].isdecimal() else None  # of the running item
    stack: list[tuple[str, int, bool]] = []  # what closes it, where it opened, whether a colon introduced it
    begin = 0  # of the running sentence
    skip = marker
    for m in EVENT.finditer(line, 0, n):
        i = m.start()
        if i < skip:
            continue
        c = line[i]
        if c not in STOP:
            if i not in ignored:
                _quote(line, i, c, stack, last)
            continue
        # the run of terminators, then what it closes
        j = i + 1
        while j < n and line[j] in STOP:
            j += 1
        k, closed, inside = j, None, bool(stack)
        while k < n:
            d = line[k]
            if stack and d in stack[-1][0]:
                closed = stack.pop()
                k += 1
            elif d in "»›" and stack or d in BLANKS and k + 1 < n and line[k + 1] in "»›" and stack and line[k + 1] in stack[-1][0]:
                k += 1
            elif d in "”»」』)]）" and not stack and d != "”":
                k += 1
            elif d in "”\"" and not stack and (k + 1 >= n or line[k + 1].isspace()) and d != '"':
                k += 1
            elif d in STOP and closed:
                k += 1
            else:
                break
        skip = k
        if stack:
            continue
        if k >= n:
            break
        wide = line[j - 1] in WIDE or c in WIDE
        gap = line[k].isspace()
        if not gap and not wide and line[j - 1] not in CLOSE_UP:
            continue
        t = k
        while t < n and line[t].isspace():
            t += 1
        after = _begins(line, t)
        single = j - i == 1
        if closed and inside and closed[0] not in (")", "]", "）", "}"):
            # a quotation closed: does the sentence around it go on?
            if after == "low" or _dash_follows(line, t) and _goes_on_after_dash(line, t):
                continue
            if after == "other" and not closed[2]:
                lead = line[begin : closed[1]].strip(" —–-\t")
                if not lead or line[t : t + 1] in "とってはがを":
                    continue
            if wide and line[t : t + 1] in "とって" and line[t : t + 2] != "とて":
                continue
        else:
            if set(line[i:j]) <= {"…"} and not gap:
                continue
            if after == "low" and not wide:
                continue
            if _dash_follows(line, t) and _goes_on_after_dash(line, t) and c != ".":
                continue
            if c == "." and single and number is not None and after != "none" and line[begin:i].strip() == str(number + 1):
                # the next item of a list within the line
                number += 1
                continue
            if c == "." and single and _no_stop(line, i, t, after):
                continue
            if (line[i:j] == "..." or "…" in line[i:j]) and after not in ("up", "other", "digit", "none"):
                continue
        ends.append(k)
        begin = t
    if not ends or ends[-1] != n:
        ends.append(n)
    return ends, {s[1] for s in stack}


def _goes_on_after_dash(line: str, t: int) -> bool:
    """A dash, then a small letter, or a caseless word after a dash and a blank: the sentence goes on."""
    while t < len(line) and (line[t] in DASH or line[t].isspace()):
        t += 1
    return t < len(line) and line[t].islower()


def _no_stop(line: str, dot: int, t: int, after: str) -> bool:
    """Whether the single full stop at `dot`, with a blank behind it, belongs to a word or number."""
    m = WORD_BEFORE.search(line, max(0, dot - 40), dot)
    word = m.group() if m else ""
    if len(word) == 1 and word.isupper():
        return True
    # the middle of an abbreviation of several words (z. B.)
    if after != "none" and (nxt := re.match(r"\s?([^\W\d_]{1,2})\.", line[dot + 1 : dot + 6])) and abbreviation(f"{word}.{nxt[1]}.", len(word) + 1 + len(nxt[1])) is not None and f"{word}.{nxt[1]}".lower() in _combined():
        return True
    may = abbreviation(line, dot)
    if may is False:
        return True
    if may:
        return after not in ("up", "other")
    if len(word) == 1 and word.isalpha():
        return not word.islower() or after != "up"
    bare = word.rstrip(".")
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):
        return after != "up" or len(bare) <= 3 and word[0].isupper()
    if word.isdigit() and len(word) <= 2 and after == "up":
        before = line[max(0, m.start() - 40) : m.start()].split()
        return bool(before) and before[-1].lower().strip("(„“,") in BEFORE_ORDINAL
    if re.fullmatch(r"[ivxlc]+", word) and after == "digit":
        return True
    return False


def _quote(line: str, i: int, c: str, stack: list, last: dict[str, int]) -> None:
    if stack and c in stack[-1][0] and not (c in "’'" and i + 1 < len(line) and line[i + 1].isalpha()):
        stack.pop()
        return
    colon = line[max(0, i - 4) : i].rstrip().endswith((":", "："))
    opening = i == 0 or not line[i - 1].isalnum()
    if c in LOW:
        stack.append((LOW[c], i, colon))
    elif c in OPEN:
        # a closing mark in some languages; a » that opens is rare and left alone
        stack.append((OPEN[c], i, colon))
    elif c == '"' and opening and last[c] > i:
        stack.append(('"', i, colon))
    elif c == "”" and opening and not any("”" in s[0] for s in stack) and last[c] > i and i + 1 < len(line) and not line[i + 1].isspace():
        stack.append(("”", i, colon))
    elif c == "‘" and opening and last["’"] > i:
        stack.append(("’", i, colon))
    elif c == "'" and opening and i + 1 < len(line) and line[i + 1].isalpha() and last[c] > i + 1:
        stack.append(("'", i, colon))


def sentence_ends(text: str | None) -> list[int]:
    """Position of the last character of each sentence, the first character being 1."""
    out: list[int] = []
    if not text:
        return out
    levels: list[list] = []
    marker = 0
    done, before = -2, ""  # end of the last line that is not blank, and its last character
    for m in LINE.finditer(text):
        s = m.group()
        a = m.start()
        lead = len(s) - len(s.lstrip())
        body = s[lead:]
        if not body:
            continue
        beside = a - done <= 1 or text[done:a] == "\r\n"
        marker = list_marker(body, levels, not beside or marker > 0 or before in ENDED)
        if not marker and not beside:
            levels.clear()
        out += [a + lead + e for e in line_ends(body, marker)]
        done, before = m.end(), s.rstrip()[-1]
    return out


def sentences(df: DataFrame, key: str = "chapter_id", text: str = "text", content: bool = True) -> DataFrame:
    """(key, sentence_no, sent_start, sent_end, with content the sentence), in order, from 1, ends included.

    Null, empty and blank texts give no sentence; each repeated row gives its own. White space
    belongs to no sentence and a line break ends one.
    """
    ints = [T.StructField(n, T.IntegerType()) for n in ("sentence_no", "sent_start", "sent_end")]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *ints, *[T.StructField("sentence", T.StringType())] * content])

    def make():
        def of(keys, texts):
            out = {f.name: [] for f in schema}
            for k, t in zip(keys, texts, strict=True):
                at = 0
                for i, e in enumerate(sentence_ends(t), 1):
                    while t[at].isspace():
                        at += 1
                    for f, v in zip(out, (k, i, at + 1, e, *[t[at:e]] * content), strict=True):
                        out[f].append(v)
                    at = e
            return out

        return of

    return map_columns(df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")), ["__key", "__text"], schema, make)
