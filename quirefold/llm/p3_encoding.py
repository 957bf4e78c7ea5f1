"""Text that was decoded with the wrong encoding: finding its spans and restoring them.

A hidden Markov model has one clean state, one state for each pair (encoding written in, encoding
read as), and one for lost characters, which replacement characters are. It labels the visible
characters that an 8-bit encoding could have produced, in the runs between blanks that are not all
ASCII. In the clean state a character has its probability under a bigram model of the corpus'
characters; in a pair's state, what the inverse transform makes of it has. The path first takes each
run as a whole, as damage mostly does; in a run that holds sequences of UTF-8 in a wrong reading, or
of which no one state explains all characters, it goes on character by character and may change its
state within the run. Each labelled span gets its state's inverse transform.
"""

from __future__ import annotations

import codecs
import functools
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import count_tokens, map_columns, passes, points, runs
from .p4_canonical import canonical, changed

# Fixed values: (written in, read as); the last are read wrongly twice.
PAIRS = (
    *(("utf-8", x) for x in ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "mac-roman", "iso8859-15", "iso8859-2", "koi8-r")),
    *((x, "cp1252") for x in ("cp1251", "cp1250", "cp1253", "cp1254", "koi8-r", "cp866", "shift_jis", "euc-jp", "gbk", "iso8859-2", "iso8859-5", "iso8859-7", "cp1256", "cp437", "cp850", "mac-roman", "euc-kr", "big5")),
    *((x, "latin-1") for x in ("koi8-r", "cp866", "shift_jis", "euc-jp", "gbk", "cp1251", "cp1256")),
    *((x, "cp1251") for x in ("cp1252", "koi8-r", "cp866", "cp1250", "mac-cyrillic")),
    *((x, "cp1250") for x in ("cp1252", "cp1251", "koi8-r")),
    *((x, "cp437") for x in ("cp1252", "cp1250")),
    *((x, "cp850") for x in ("cp1252",)),
    *((x, "mac-roman") for x in ("cp1252", "gbk", "shift_jis", "euc-jp")),
    *((x, "koi8-r") for x in ("cp1251", "koi8-u")),
    *(("koi8-u", x) for x in ("cp1252", "latin-1", "cp1251")),
    *((x, "cp866") for x in ("cp1251",)),
    ("utf-8", "cp1252", "utf-8", "cp1252"),
    ("utf-8", "latin-1", "utf-8", "latin-1"),
    ("utf-8", "latin-1", "utf-8", "cp1252"),
    ("utf-8", "cp1251", "utf-8", "cp1251"),
)
#: Log probability of leaving a state for one other, against staying.
SWITCH = -9.0
#: The same between two characters of one run.
SWITCH_WITHIN = -5.0
#: What a pair's state must gain over clean in a run before it counts as a witness.
GAIN = 4.0
#: Runs whose least likely step is likelier than this are clean.
COMMON = -7.0
#: Smoothing of the bigram model.
ALPHA = 0.5
LOST = "\ufffd"
CACHE = 200_000
#: Latin letters beside those of another alphabet: no word.
MIXED_WORD = re.compile("[A-Za-z\u00c0-\u024f][\u0370-\u06ff]|[\u0370-\u06ff][A-Za-z\u00c0-\u024f]")
#: A first byte of UTF-8 behind a small letter whose following byte is lost.
CUT_OFF = re.compile(rb"(?<=[a-z])[\xc2-\xc5](?![\x80-\xbf])")


@functools.cache
def _bytes_of(encoding: str) -> dict[int, int]:
    """Code point to byte; bytes that the encoding leaves open stand for the control character of their number."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(ord(c), b)
    for b in range(128, 160):
        out.setdefault(b, b)
    return out


def invert(text: str, pair: tuple[str, ...], errors: str = "strict") -> str | None:
    """The text that gives `text` if written and read as the pair says; None if there is none."""
    try:
        for wrote, read in reversed([pair[i : i + 2] for i in range(0, len(pair), 2)]):
            of = _bytes_of(read)
            data = bytes([of[ord(c)] for c in text])
            text = codecs.decode(data, wrote, errors)
        return text
    except (KeyError, UnicodeDecodeError):
        return None


@functools.cache
def repertoire() -> np.ndarray:
    """1 for code points beyond ASCII that reading bytes in an 8-bit encoding can give; 2 for visible ASCII; 3 for U+FFFD."""
    out = np.zeros(0x110000, np.uint8)
    out[33:127] = 2
    for pair in PAIRS:
        for read in pair[1::2]:
            for c in _bytes_of(read):
                if c > 127:
                    out[c] = 1
    out[0xFFFD] = 3
    return out


@functools.cache
def symbols() -> np.ndarray:
    """Symbol of each code point for the bigram model: ASCII by kind, the repertoire and its alphabets each for itself, other scripts by block."""
    import unicodedata as u

    out = np.zeros(0x110000, np.int32)
    cp = np.arange(0x110000)
    out[:] = 2000 + np.minimum(cp >> 7, 1500)
    out[0x3400:0xA000] = 3800 + cp[0x3400:0xA000] % 200
    out[0xAC00:0xD7B0] = 3601
    for c in range(128):
        out[c] = 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c <= 32 or c == 127 else 5
    single = np.flatnonzero((repertoire() == 1) | ((cp >= 0x80) & (cp < 0x530)))
    out[single] = 10 + np.arange(len(single))
    out[0xFFFD] = 6
    # rare letters of the non-Latin scripts still differ from the common ones
    for c in (*range(0x600, 0x700), *range(0x900, 0x980), *range(0x3040, 0x3100)):
        out[c] = 3700 + (c >> 7) * 2 + (u.category(chr(c)) == "Cn")
    return out


def bigrams(text: str) -> Counter:
    """Counts of a << 12 | b over the symbols of neighbouring characters."""
    cp = points("\n" + text + "\n")
    s = symbols()[cp]
    key = s[:-1] << 12 | s[1:]
    if text.isascii():
        hot = np.zeros(len(key), bool)
    else:
        hot = (cp[1:] > 127) | (cp[:-1] > 127)
    cold = np.bincount(s[:-1][~hot] << 3 | s[1:][~hot], minlength=64)
    out = Counter({(k >> 3) << 12 | (k & 7): int(cold[k]) for k in np.flatnonzero(cold).tolist()})
    if hot.any():
        k, n = np.unique(key[hot], return_counts=True)
        out.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    return out


def character_model(*columns: tuple[DataFrame, str]) -> DataFrame:
    """(key, n): the counts of bigrams() over all rows of the columns; at most 4096 x 4096 keys, some ten thousand in practice."""
    out = None
    for df, c in columns:
        part = count_tokens(df, c, bigrams, "key long, n long", flush=100_000)
        out = part if out is None else out.unionAll(part)
    return out.groupBy("key").agg(F.sum("n").alias("n"))


def undamaged(counts: dict[int, int]) -> dict[int, float]:
    """The bigram counts without what wrong decoding put there.

    A lead and a following byte of UTF-8, as an 8-bit encoding shows them, that are no two letters
    and no quotation, don't stand together in clean text, nor does a capital behind a small letter
    of which one is beyond ASCII. Other pairs lose the share that these have of their characters.
    """
    import unicodedata as u

    sym = symbols()
    char = {int(sym[c]): chr(c) for c in np.flatnonzero((sym >= 10) & (sym < 2000)).tolist()}
    bad = set()
    for read in {p[1] for p in PAIRS if p[0] == "utf-8"}:
        back = {b: chr(c) for c, b in _bytes_of(read).items() if b > 127}
        for lead in range(0xC2, 0xF5):
            for follow in range(0x80, 0xC0):
                x, y = back.get(lead), back.get(follow)
                if x and y and not (u.category(y)[0] == "L" or y in "\xa0’”“‘–—»…"):
                    bad.add(int(sym[ord(x)]) << 12 | int(sym[ord(y)]))
    for k, n in counts.items():
        x, y = char.get(k >> 12, ""), char.get(k & 4095, "")
        if y.isupper() and (k >> 12 == 1 or x.islower()) and y < "\u0250":
            bad.add(k)
    follows, leads, total_a, total_b = Counter(), Counter(), Counter(), Counter()
    for k, n in counts.items():
        total_a[k >> 12] += n
        total_b[k & 4095] += n
        if k in bad:
            follows[k >> 12] += n
            leads[k & 4095] += n
    return {k: n * (1 - follows[k & 4095] / max(total_a[k & 4095], 1)) * (1 - leads[k >> 12] / max(total_b[k >> 12], 1)) for k, n in counts.items() if k not in bad}


@functools.cache
def _utf8_states() -> tuple[int, ...]:
    return tuple(i for i, p in enumerate(PAIRS) if p[0] == "utf-8" and len(p) == 2)


@functools.cache
def _sequences() -> frozenset[str]:
    """A first and a following byte of UTF-8, as its wrong readings show them."""
    out = set()
    for i in _utf8_states():
        back = {b: chr(c) for c, b in _bytes_of(PAIRS[i][1]).items() if b > 127}
        out |= {back[a] + back[b] for a in range(0xC2, 0xF5) for b in range(0x80, 0xC0) if a in back and b in back}
    return frozenset(out)


@functools.cache
def _steps_of(pair: int) -> tuple[dict[str, int], dict[bytes, str]]:
    """A pair's bytes by character, and what single bytes or sequences beyond ASCII were written for."""
    wrote, read = PAIRS[pair][:2]
    single: dict[bytes, str] = {}
    if wrote != "utf-8":
        for b in range(128, 256):
            try:
                single[bytes([b])] = bytes([b]).decode(wrote)
            except UnicodeDecodeError:
                continue
    return {chr(c): b for c, b in _bytes_of(read).items()}, single


def written_for(run: str, i: int, pair: int) -> tuple[int, str] | None:
    """How many characters from i on the pair's state takes as one, and the character they stand for; None if it can't."""
    of, single = _steps_of(pair)
    b = of.get(run[i])
    if b is None:
        return None
    if b < 0x80:
        return 1, run[i]
    if PAIRS[pair][0] != "utf-8":
        c = single.get(bytes([b]))
        return None if c is None or not _legible(c) else (1, c)
    n = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
    if not n or i + n > len(run):
        return None
    try:
        c = bytes([of[x] for x in run[i : i + n]]).decode()
    except (KeyError, UnicodeDecodeError):
        return None
    return (n, c) if _legible(c) else None


class Labeller:
    """The hidden Markov model over a table of bigram counts."""

    def __init__(self, counts: dict[int, int]):
        counts = undamaged(counts)
        total: Counter = Counter()
        single: Counter = Counter()
        for k, n in counts.items():
            total[k >> 12] += n
            single[k & 4095] += n
        grand = sum(single.values()) + 4096 * ALPHA
        self.single = {k: n / grand for k, n in single.items()}
        self.floor = ALPHA / grand
        self.counts, self.total = counts, total
        self.sym = symbols()
        self.char: dict[str, int] = {}
        self.changed = changed()
        self.memo: dict[str, tuple] = {}
        self.within: dict[tuple, tuple] = {}
        self.steps: dict[int, float] = {}

    def _step(self, key: int) -> float:
        """log P(b | a), backed off to P(b)."""
        back = max(self.single.get(key & 4095, 0.0), self.floor)
        got = self.steps[key] = math.log((self.counts.get(key, 0) + 5 * back) / (self.total.get(key >> 12, 0) + 5))
        return got

    def score(self, run: str) -> tuple[float, float]:
        """Log probability of a run between blanks, and that of its least likely step."""
        char, steps = self.char, self.steps
        a, total, least = 4, 0.0, 0.0
        for c in run:
            b = char.get(c)
            if b is None:
                b = char[c] = int(self.sym[ord(c)])
            k = a << 12 | b
            v = steps.get(k)
            if v is None:
                v = self._step(k)
            total += v
            if v < least:
                least = v
            a = b
        v = self._step(a << 12 | 4)
        return total + v, min(least, v)

    def emission(self, run: str) -> tuple[float, dict[int, float], bool]:
        """(log probability if clean, {pair: log probability}, whether a pair is a witness).

        Runs whose every step is common can't gain and are left alone. A run of look-alike letters
        or invisible characters (problem 4) is as clean as its canonical form, at a cost.
        """
        got = self.memo.get(run)
        if got is not None:
            return got
        if len(self.memo) > CACHE:
            self.memo.clear()
        clean, least = self.score(run)
        pairs: dict[int, float] = {}
        witness = False
        if least < COMMON and LOST not in run:
            form = canonical([run])[0] if not self.changed.isdisjoint(run) else run
            if form != run:
                clean = max(clean, self.score(form)[0] - 2.0 - 2.0 * sum(a != b for a, b in zip(run, form, strict=False)) / max(len(run), 1))
            data: dict[str, bytes | None] = {}
            for i, p in enumerate(PAIRS):
                read = p[-1]
                if read not in data:
                    of = _bytes_of(read)
                    try:
                        data[read] = bytes([of[ord(c)] for c in run])
                    except KeyError:
                        data[read] = None
                raw = data[read]
                if raw is None:
                    continue
                if len(p) == 2 and p[0] == "utf-8":
                    t = raw.decode("utf-8", "replace")
                elif len(p) == 2:
                    try:
                        t = raw.decode(p[0])
                    except UnicodeDecodeError:
                        continue
                else:
                    t = invert(run, p) or ""
                gaps = t.count(LOST)
                if not t or t == run or gaps and gaps != len(CUT_OFF.findall(raw)) or not _legible(t):
                    continue
                if p[0] != "utf-8" and (not any(c > "\x7f" and c.isalpha() for c in t) or not _words(t)):
                    continue
                kept = t.replace(LOST, "") if gaps else t
                v = self.score(kept)[0] - 6.0 * gaps - 5.0 * sum("\u2e80" <= c <= "\ud7ff" and not "\u3000" <= c <= "\u30ff" for c in t)
                if v > clean - 12:
                    pairs[i] = v
                    witness |= v > clean + GAIN and (p[0] == "utf-8" or sum(map(str.isalnum, t)) > 2)
        self.memo[run] = got = (clean, pairs, witness)
        return got

    def characters(self, run: str, states: tuple[int, ...]) -> tuple[float, list[tuple[int, int, int]]]:
        """(log probability, spans (start, end, pair)) of the likeliest path over the characters of one run, by the clean state and these pairs."""
        got = self.within.get((run, states))
        if got is not None:
            return got
        if len(self.within) > CACHE:
            self.within.clear()
        n = len(run)
        symbol = lambda c: self.char.get(c) or self.char.setdefault(c, int(self.sym[ord(c)]))
        step = lambda k: v if (v := self.steps.get(k)) is not None else self._step(k)
        # best[i][state]: score, last symbol, where the step began, the state before
        best: list[dict[int, tuple]] = [{} for _ in range(n + 1)]
        best[0][-1] = (0.0, 4, 0, -1)
        for i in range(n):
            if not best[i]:
                continue
            top = max(best[i], key=lambda s: best[i][s][0])
            for s in (-1, *states):
                way = (1, run[i]) if s < 0 else written_for(run, i, s)
                if way is None:
                    continue
                k, c = way
                b = symbol(c)
                for frm in {s, top} & best[i].keys():
                    v, a, _, _ = best[i][frm]
                    v += step(a << 12 | b) + (0.0 if frm == s else SWITCH_WITHIN)
                    if s not in best[i + k] or v > best[i + k][s][0]:
                        best[i + k][s] = (v, b, i, frm)
        ends = {s: v + step(a << 12 | 4) for s, (v, a, _, _) in best[n].items()}
        s = max(ends, key=ends.__getitem__)
        total, i, spans = ends[s], n, []
        while i:
            _, _, j, frm = best[i][s]
            if s >= 0 and (i - j > 1 or run[j] > "\x7f"):
                if spans and spans[-1][0] == i and spans[-1][2] == s:
                    spans[-1] = (j, spans[-1][1], s)
                else:
                    spans.append((j, i, s))
            i, s = j, frm
        self.within[run, states] = got = (total, spans[::-1])
        return got

    def path(self, text: str, runs: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
        """Spans and their states: runs as a whole, and parts of runs where the path changes its state within."""
        labels = self.label(text, runs)
        known = tuple(sorted({s for s in labels if s >= 0 and len(PAIRS[s]) == 2} - set(_utf8_states())))
        spans: list[tuple[int, int]] = []
        states: list[int] = []
        for (a, b), s in zip(runs, labels, strict=True):
            run = text[a:b]
            parts = None
            if s != -2 and self.mixes(run, s, bool(known)):
                clean, pairs, _ = self.emission(run)
                v, parts = self.characters(run, (*_utf8_states(), *known))
                eight_bit = any(PAIRS[x][0] != "utf-8" for _, _, x in parts)
                if v <= (pairs.get(s, clean) if s >= 0 else clean) + (2.0 if s >= 0 else GAIN) or eight_bit and not _words(restore(run, [x[:2] for x in parts], [x[2] for x in parts])):
                    parts = None
            for p, q, x in parts if parts is not None else [(0, b - a, s)]:
                spans.append((a + p, a + q))
                states.append(x)
        return spans, states

    def mixes(self, run: str, state: int, known: bool) -> bool:
        """Whether the characters of a run may need more than one state: UTF-8 sequences that its state does not take as such, or, in a damaged text, a run that nothing explains."""
        if state >= 0 and PAIRS[state][0] == "utf-8":
            return False
        sequences = _sequences()
        if any(x + y in sequences for x, y in zip(run, run[1:], strict=False)):
            return True
        return state == -1 and known and self.score(run)[1] < COMMON

    def label(self, text: str, spans: list[tuple[int, int]]) -> list[int]:
        """State of each run: -1 clean, -2 lost, else the index of its pair."""
        em = [self.emission(text[a:b]) for a, b in spans]
        seen = sorted({i for clean, p, witness in em if witness for i, v in p.items() if v > clean + GAIN})
        if not seen:
            return [-2 if LOST in text[a:b] else -1 for a, b in spans]
        states = [-1, *seen]
        score = [0.0] + [SWITCH] * len(seen)
        back: list[list[int]] = []
        for clean, pairs, _ in em:
            top = max(range(len(states)), key=score.__getitem__)
            best = score[top] + SWITCH
            row, new = [], []
            for k, s in enumerate(states):
                frm, v = (k, score[k]) if score[k] >= best else (top, best)
                row.append(frm)
                # where a pair can't have made the run, or gains nothing, its state still may pass over a clean run at a cost
                new.append(v + (clean if s < 0 else pairs.get(s, clean - 2.0)))
            back.append(row)
            score = new
        k = max(range(len(states)), key=score.__getitem__)
        path = []
        for row in reversed(back):
            path.append(k)
            k = row[k]
        path.reverse()
        out = []
        for (a, b), k, (_, pairs, _w) in zip(spans, path, em, strict=True):
            s = states[k]
            out.append(-2 if LOST in text[a:b] else s if s >= 0 and s in pairs else -1)
        return out


def _legible(text: str) -> bool:
    """No control characters and no private use."""
    return not any(c < " " and c not in "\n\t\r" or "\x7f" <= c <= "\x9f" or "\ue000" <= c <= "\uf8ff" for c in text)


def _words(text: str) -> bool:
    """No word holds letters of two alphabets, or a symbol between its letters."""
    import unicodedata as u

    inner = any(a.isalpha() and c.isalpha() and not b.isalnum() and u.category(b)[0] == "S" for a, b, c in zip(text, text[1:], text[2:], strict=False))
    return not inner and not MIXED_WORD.search(text)


def spans_of(texts: list[str]) -> list[list[tuple[int, int]]]:
    """For each text its runs of repertoire and visible ASCII characters that are not all ASCII; replacement characters are runs of their own."""
    out: list[list[tuple[int, int]]] = []
    for lo, hi in passes(texts):
        part = texts[lo:hi]
        base = np.cumsum([0, *(len(t) + 1 for t in part)])
        cp = points("\n".join(part) + "\n")
        kind = repertoire()[cp]
        a, b = (np.sort(np.concatenate(x)) for x in zip(runs((kind > 0) & (kind < 3)), runs(kind == 3), strict=True))
        high = np.concatenate(([0], np.cumsum(kind & 1)))
        ok = high[b] > high[a]
        a, b = a[ok], b[ok]
        at = np.searchsorted(a, base)
        for k in range(len(part)):
            z = int(base[k])
            out.append(list(zip((a[at[k] : at[k + 1]] - z).tolist(), (b[at[k] : at[k + 1]] - z).tolist(), strict=True)))
    return out


def restore(text: str, spans: list[tuple[int, int]], labels: list[int]) -> str:
    """The text with each labelled span put back; clean and lost spans stay as they are."""
    out, at = [], 0
    for (a, b), s in zip(spans, labels, strict=True):
        if s >= 0:
            out += [text[at:a], invert(text[a:b], PAIRS[s], "replace")]
            at = b
    return "".join([*out, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pair", T.StringType())]))


def repair_encoding(df: DataFrame, key: str, column: str, model: DataFrame | dict[int, int], content: bool = True) -> DataFrame:
    """(key, damaged, lost, with content repaired and spans), one row for each row of df.

    damaged: a span was read in a wrong encoding, or bytes are lost; lost: replacement characters
    remain. repaired has the spans restored; spans lists them (code points from 0) with their pair,
    `lost` for lost ones. Null texts give damaged = false and a null repaired. `model` has the rows
    of character_model(), a bounded alphabet's bigrams, which go to every task.
    """
    shared = df.sparkSession.sparkContext.broadcast(model if isinstance(model, dict) else {r["key"]: r["n"] for r in model.collect()})
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("damaged", T.BooleanType()), T.StructField("lost", T.BooleanType())]
        + [T.StructField("repaired", T.StringType()), T.StructField("spans", SPAN)] * content
    )

    def make():
        model = Labeller(shared.value)

        def of(keys, texts):
            out = {f.name: [] for f in schema}
            for k, t, spans in zip(keys, texts, spans_of([t or "" for t in texts]), strict=True):
                spans, labels = model.path(t, spans) if spans else ([], [])
                row = [k, any(s != -1 for s in labels), any(s == -2 for s in labels)]
                if content:
                    row += [restore(t, spans, labels) if t is not None else None, [(a, b, "lost" if s == -2 else " > ".join(PAIRS[s])) for (a, b), s in zip(spans, labels, strict=True) if s != -1]]
                for f, v in zip(out, row, strict=True):
                    out[f].append(v)
            return out

        return of

    return map_columns(df.select(F.col(key).alias("__key"), F.col(column).cast("string").alias("__text")), ["__key", "__text"], schema, make)
