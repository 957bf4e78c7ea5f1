"""Splitting long texts into overlapping pieces at natural boundaries, by lexical cohesion.

The text is a row of units (sentences and lines). Words hash into a vector for each unit; the
similarity of the blocks of units before and after each unit border forms a curve whose valleys
mark changes of topic. A valley is as deep as the curve falls to it from the peaks on both sides.
Each cut takes the deepest valley in the window of sizes that is left for
the piece; where the window has no unit border, the cut falls back to a clause, a word and last
a hard cut. The next piece begins at least `overlap` characters earlier, at a natural boundary if
there is one within half as much again.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import letter_or_digit, map_columns, passes, points, runs, table

#: The reference's chunk size, in code points, and the least overlap between neighbours.
MAX_CHARS, OVERLAP = 1000, 100
#: A piece that is cut has at least this share of the size; units in a block; size of the word vectors.
LEAST, BLOCK, WIDTH = 0.5, 4, 64
BOUNDARIES = ("paragraph", "line", "sentence", "clause", "word", "hard", "end")
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, HARD, END = range(7)
#: Depth in similarity that a border of this kind counts beyond its valley.
BONUS = np.array([0.30, 0.15, 0.0])

WORDY, BLANK, NEWLINE, STOP, WIDE_STOP, PAUSE, CLOSER, MARK, OTHER = range(9)

PIECE = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("overlap", T.IntegerType()),
        T.StructField("boundary", T.StringType()),
        T.StructField("longest_run", T.IntegerType()),
    ]
)


def _class(c: str) -> int:
    import unicodedata as u

    if c in "\n\r\x0b\x0c\x85\u2028\u2029":
        return NEWLINE
    if c in ".!?…؟।":
        return STOP
    if c in "。！？":
        return WIDE_STOP
    if c in ",;:،、，；：—–":
        return PAUSE
    if c in "\"'”’»›」』)]}“‘":
        return CLOSER
    k = u.category(c)
    if c.isspace():
        return BLANK
    if k[0] == "M" or c in "\u200d\ufe0e\ufe0f":
        return MARK
    return WORDY if k[0] in "LN" else OTHER


@functools.cache
def _lut() -> np.ndarray:
    return table("p5", _class)


@functools.cache
def _mix() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 31, 0x110000, dtype=np.uint64)


def borders(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the kind of boundary before it (END: none), and the unit borders (kinds up to SENTENCE)."""
    n = len(cls)
    kind = np.full(n + 1, END, np.uint8)
    blank = (cls == BLANK) | (cls == NEWLINE)
    begins = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    kind[begins] = WORD
    # the visible character before each word, closing marks skipped
    solid = np.maximum.accumulate(np.where(~blank, np.arange(n), -1))
    at = solid[np.maximum(begins - 1, 0)]
    kind[begins[(at >= 0) & (cls[at] == PAUSE)]] = CLAUSE
    back = at.copy()
    for _ in range(2):
        step = (back > 0) & (cls[np.maximum(back, 0)] == CLOSER)
        back = np.where(step, back - 1, back)
    stop = (back >= 0) & np.isin(cls[np.maximum(back, 0)], (STOP, WIDE_STOP))
    kind[begins[stop]] = SENTENCE
    # scripts without spaces: after the stop and its closing marks; a clause after a pause
    wide = np.flatnonzero(cls[:-1] == WIDE_STOP) + 1 if n > 1 else np.zeros(0, int)
    for _ in range(2):
        step = (wide < n) & (cls[np.minimum(wide, n - 1)] == CLOSER)
        wide = np.where(step, wide + 1, wide)
    wide = wide[(wide < n)]
    wide = wide[~blank[wide] & ~np.isin(cls[wide], (WIDE_STOP, STOP, MARK))]
    kind[wide] = SENTENCE
    pause = np.flatnonzero((cls[:-1] == PAUSE) & ~blank[1:] & np.isin(cls[1:], (WORDY, OTHER))) + 1
    pause = pause[kind[pause] == END]
    kind[pause] = CLAUSE
    lines = np.cumsum(cls == NEWLINE)
    crossed = lines[np.maximum(begins - 1, 0)] - lines[np.maximum(at, 0)] * (at >= 0)
    kind[begins[crossed == 1]] = LINE
    kind[begins[crossed > 1]] = PARAGRAPH
    kind[0] = END
    return kind, np.flatnonzero(kind[:n] <= SENTENCE)


def depths(cp: np.ndarray, cls: np.ndarray, units: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How deep the cohesion valley at each unit border is: how far the cosine of the blocks around it lies below the peaks to its left and right, together.

    A peak is where the curve, going up from the border, first turns down. doc has the document of
    each border, of which the first is its start; blocks and slopes end with their document.
    """
    k = len(units)
    wordy = (cls == WORDY) | (cls == MARK)
    ws, we = runs(wordy)
    if not k or not len(ws):
        return np.zeros(k)
    at = np.flatnonzero(wordy)
    place = np.arange(len(at), dtype=np.uint64) - np.repeat(np.cumsum(we - ws) - (we - ws), we - ws).astype(np.uint64)
    val = _mix()[cp[at]] * (place + np.uint64(1))
    h = (np.add.reduceat(val, np.cumsum(we - ws) - (we - ws)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % WIDTH
    unit = np.searchsorted(units, ws, side="right")
    counts = np.bincount(unit * WIDTH + h, minlength=(k + 1) * WIDTH)[: (k + 1) * WIDTH].reshape(k + 1, WIDTH)
    total = np.zeros((k + 2, WIDTH), np.float32)
    np.cumsum(counts, 0, out=total[1:])
    # unit i + 1 begins with border i
    i = np.arange(1, k + 1)
    first = np.searchsorted(doc, doc, side="left") + 1
    last = np.searchsorted(doc, doc, side="right") + 1
    left = total[i] - total[np.maximum(i - BLOCK, first)]
    right = total[np.minimum(i + BLOCK, last)] - total[i]
    norm = np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))
    alike = np.round(np.einsum("ij,ij->i", left, right) / np.maximum(norm, 1e-9), 6)
    # a document's first border is no valley: the slopes start behind it
    alike[np.append(True, doc[1:] != doc[:-1])] = -1.0
    place = np.arange(k)
    begins = np.append(True, (alike[1:] > alike[:-1]) | (doc[1:] != doc[:-1]))
    peak_left = alike[np.maximum.accumulate(np.where(begins, place, 0))]
    ends = np.append((alike[1:] < alike[:-1]) | (doc[1:] != doc[:-1]), True)
    peak_right = alike[np.minimum.accumulate(np.where(ends, place, k - 1)[::-1])[::-1]]
    return (peak_left - alike) + (peak_right - alike)


def split_many(texts: list[str | None], most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[list[tuple[int, int, int, int]], int]]:
    """For each text its pieces (start, end, overlap with the piece before, kind of boundary at the end) and its longest run of letters and digits."""
    out: list = [([(0, len(t), 0, END)] if t else [], 0) for t in texts]
    long = [i for i, t in enumerate(texts) if t and len(t) > most]
    for lo, hi in passes([texts[i] for i in long]):
        part = [texts[i] for i in long[lo:hi]]
        base = np.cumsum([0, *(len(t) + 1 for t in part)])
        cp = points("\n".join(part) + "\n")
        cls = _lut()[cp]
        kind, units = borders(cls)
        units = np.union1d(units, base[:-1])
        depth = np.round(depths(cp, cls, units, np.searchsorted(base, units, side="right")), 4)
        inner = ~np.isin(units, base)
        units, depth = units[inner], depth[inner]
        depth += BONUS[kind[units]]
        soft = np.flatnonzero(kind[: len(cp)] <= WORD)
        soft = soft[~np.isin(soft, base)]
        a, b = runs(letter_or_digit()[cp].astype(bool))
        longest = np.zeros(len(part), np.int64)
        np.maximum.at(longest, np.searchsorted(base, a, side="right") - 1, b - a)
        at_u, at_s = np.searchsorted(units, base), np.searchsorted(soft, base)
        for k, i in enumerate(long[lo:hi]):
            z = int(base[k])
            u, s = slice(at_u[k], at_u[k + 1]), slice(at_s[k], at_s[k + 1])
            n = len(part[k])
            out[i] = _cuts(n, most, overlap, (units[u] - z).tolist(), depth[u].tolist(), (soft[s] - z).tolist(), kind[z : z + n], cls[z : z + n]), int(longest[k])
    return out


def _cuts(n: int, most: int, overlap: int, units: list[int], depth: list[float], soft: list[int], kind: np.ndarray, cls: np.ndarray) -> list[tuple[int, int, int, int]]:
    out, start, lap = [], 0, 0
    while n - start > most:
        lo, hi = start + max(int(most * LEAST), lap + 1), start + most
        a, b = bisect_left(units, lo), bisect_right(units, hi)
        if a < b:
            window = depth[a:b]
            cut = units[a + window.index(max(window))]
            how = int(kind[cut])
        else:
            near = soft[bisect_left(soft, start + lap + 1) : bisect_right(soft, hi)]
            if near:
                # the last sentence or clause border that leaves a piece of some size; else the last word
                good = next((x for x in reversed(near) if kind[x] <= CLAUSE), -1)
                cut = good if good - start >= most // 4 else near[-1]
                how = int(kind[cut])
            else:
                cut, how = hi, HARD
                while cut > start + lap + 1 and cls[cut] == MARK:
                    cut -= 1
        out.append((start, cut, lap, how))
        # the overlap starts at a sentence border, else a word border, that lies as far back as it must and not half as far again
        back = max(start + 1, cut - overlap)
        near = soft[bisect_left(soft, max(start + 1, cut - overlap - overlap // 2)) : bisect_right(soft, back)]
        begin = next((x for x in reversed(near) if kind[x] <= SENTENCE), near[-1] if near else back)
        while begin > start + 1 and cls[begin] == MARK:
            begin -= 1
        start, lap = begin, cut - begin
    out.append((start, n, lap, END))
    return out


def split_texts(df: DataFrame, key: str = "chapter_id", text: str = "text", most: int = MAX_CHARS, overlap: int = OVERLAP, content: bool = True) -> DataFrame:
    """The pieces of each row's text, in order: key, the columns of PIECE, and with content the piece itself.

    start and end are code points (from 0, end excluded); end - start is at most `most`; overlap is
    the number of characters shared with the piece before: at least the parameter and at most half
    as much again, but less than that piece; together the pieces hold every character.
    longest_run is the whole text's longest run of letters and digits. Null and empty texts give no
    pieces, short texts one; repeated rows are split each for itself.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *PIECE, *[T.StructField("piece", T.StringType())] * content])

    def make():
        def of(keys, texts):
            out = {f.name: [] for f in schema}
            for k, t, (pieces, run) in zip(keys, texts, split_many(texts, most, overlap), strict=True):
                for i, (a, b, lap, how) in enumerate(pieces):
                    row = (k, i, a, b, lap, BOUNDARIES[how], run, *[t[a:b]] * content)
                    for f, v in zip(out, row, strict=True):
                        out[f].append(v)
            return out

        return of

    return map_columns(df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")), ["__key", "__text"], schema, make)


def needs(df: DataFrame, key: str = "chapter_id", text: str = "text", most: int = MAX_CHARS) -> DataFrame:
    """(key, need): `cut` for each text longer than `most`; `hard` too if a run of letters and digits longer than `most` forced a hard cut."""
    pieces = split_texts(df, key, text, most, content=False).where((F.col("piece_no") == 0) & (F.col("boundary") != "end") | (F.col("boundary") == "hard"))
    return pieces.select(
        key, F.explode(F.filter(F.array(F.when(F.col("piece_no") == 0, "cut"), F.when((F.col("boundary") == "hard") & (F.col("longest_run") > most), "hard")), lambda x: x.isNotNull())).alias("need")
    ).distinct()
