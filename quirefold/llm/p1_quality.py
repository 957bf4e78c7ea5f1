"""Text statistics of documents, and whether a document is prose, a list, a table or junk.

Each line gets a symbol from its statistics (how it ends, words, cells in common with its
neighbours, shares of symbols, vowels and repetition, the likelihood of its letters under a bigram
model of the corpus). A hidden Markov model with the states prose, list, table and junk labels the
lines of each document by the likeliest path; the labels' shares of the characters give the
document's kind. The model's probabilities start from stated ones and are fitted by
expectation-maximisation over the lines of all documents.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import checkpointed, count_tokens, map_columns, passes, points, table

STATES = ("prose", "list", "table", "junk")

# Character classes.
LOWER, UPPER, OTHER, DIGIT, SPACE, NEWLINE, STOP, CLOSER, COMMA, DOT, TAB, PIPE, SEMI, DASH, ASCII_SYMBOL, SYMBOL, MARK, PERCENT = range(18)
N_CLASSES = 18
STOPS = "!?。！？।…؟.．"
CLOSERS = "\"'”’»›」』)]}“‘"

# Line symbols.
SENTENCE, WRAPPED, SHORT, BULLET, LEADER, CELLS, NOISE, REPEAT, NEUTRAL, PARAGRAPH = range(10)

# Probability of each symbol in each state, in the order of the symbols above, before fitting.
EMISSION = {
    "prose": (0.20, 0.45, 0.08, 0.004, 0.002, 0.002, 0.002, 0.0005, 0.05, 0.20),
    "list": (0.01, 0.03, 0.46, 0.25, 0.20, 0.005, 0.002, 0.003, 0.04, 0.0001),
    "table": (0.003, 0.01, 0.02, 0.003, 0.01, 0.90, 0.01, 0.004, 0.04, 0.0001),
    "junk": (0.01, 0.01, 0.03, 0.005, 0.01, 0.02, 0.60, 0.265, 0.05, 0.0005),
}
#: Probability that the next line is in the same state, before fitting.
STAY = 0.96
#: Rounds of fitting, and the share of each probability that stays the stated one.
ROUNDS, STATED = 2, 0.5
#: Mean length of words from which a line of one or two is a stretch of letters (a lost space, a key, a hash); it weighs as a line of so many characters.
LONG_WORD, LINE_CHARS = 30, 60
#: How much less likely (in nats a letter) than the text of its script a line of noise is, and letters it must have.
UNLIKELY, LEAST_LETTERS = 2.1, 20
#: The same where letters beyond ASCII are in the line: text in a wrong encoding is unlikely too, but no noise.
UNLIKELY_BEYOND = 5.5
#: Words in a run that comes again, and how often it comes at one distance in endless repetition.
RUN_WORDS, RUN_TIMES = 6, 8

SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("mean_word_length", T.DoubleType()),
        T.StructField("symbol_share", T.DoubleType()),
        T.StructField("punctuated_line_share", T.DoubleType()),
        T.StructField("common_word_share", T.DoubleType()),
        *(T.StructField(f"{s}_share", T.DoubleType()) for s in STATES),
        T.StructField("kind", T.StringType()),
    ]
)


def _class(c: str) -> int:
    import unicodedata as u

    fixed = {"\n": NEWLINE, "\t": TAB, "|": PIPE, ";": SEMI, ",": COMMA, ".": DOT, "%": PERCENT}
    if c in fixed:
        return fixed[c]
    if c in STOPS:
        return STOP
    if c in CLOSERS:
        return CLOSER
    if c in "-–—‐‑":
        return DASH
    cat = u.category(c)
    if cat[0] == "Z" or c in "\r\x0b\x0c\u200b\ufeff":
        return SPACE
    if cat == "Nd":
        return DIGIT
    if cat == "Lu":
        return UPPER
    if cat == "Ll":
        return LOWER
    if cat[0] == "L":
        return OTHER
    if cat[0] == "M":
        return MARK
    return ASCII_SYMBOL if c < "\x80" else SYMBOL


@functools.cache
def _lut() -> np.ndarray:
    return table("p1", _class)


@functools.cache
def _mix() -> np.ndarray:
    """A 64-bit value for each code point, for hashes of words and lines."""
    return np.random.default_rng(7).integers(1, 1 << 62, 0x110000, dtype=np.uint64)


class Model:
    """Logarithms of the emission probabilities (state, symbol) and of the moves between states."""

    def __init__(self, emission: np.ndarray | None = None, moves: np.ndarray | None = None):
        stay = np.full((4, 4), (1 - STAY) / 3)
        np.fill_diagonal(stay, STAY)
        self.emission = np.array([EMISSION[s] for s in STATES]) if emission is None else emission
        self.emission = self.emission / self.emission.sum(1, keepdims=True)
        self.moves = stay if moves is None else moves
        self.emit, self.move = np.log(self.emission), np.log(self.moves)

    def fitted(self, emitted: np.ndarray, moved: np.ndarray) -> Model:
        """The model of the expected counts, of which the stated one keeps its share."""
        stated = Model()
        part = lambda n, p: np.where(n.sum(1, keepdims=True) > 0, (1 - STATED) * n / np.maximum(n.sum(1, keepdims=True), 1e-300) + STATED * p, p)
        return Model(part(emitted, stated.emission), part(moved, stated.moves))


@functools.cache
def _model() -> tuple[np.ndarray, np.ndarray]:
    m = Model()
    return m.emit, m.move


@functools.cache
def _letters() -> np.ndarray:
    """A number below 4096 for each letter and mark, whatever its case; 0 for other characters. Those beyond U+0E80 share numbers."""
    import unicodedata as u

    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if u.category(x)[0] in "LM":
            low = x.lower()
            c = ord(low) if len(low) == 1 else c
            out[c if len(low) != 1 else ord(x)] = c if c < 0xE80 else 0xE80 + c % 384
    return out


def letter_pairs(text: str) -> dict[int, int]:
    """Counts of a << 12 | b over neighbouring letters, by their numbers."""
    at = _letters()[points(text)]
    key = (at[:-1] << 12 | at[1:])[(at[:-1] > 0) & (at[1:] > 0)] if len(at) > 1 else at[:0]
    k, n = np.unique(key, return_counts=True)
    return dict(zip(k.tolist(), n.tolist(), strict=True))


class Letters:
    """How likely a letter is behind another, against what is usual for the block of 128 that the first is in."""

    def __init__(self, counts: dict[int, int]):
        key = np.array(list(counts), np.int64)
        n = np.array(list(counts.values()), float)
        first = np.bincount(key >> 12, weights=n, minlength=4096)
        second = np.bincount(key & 4095, weights=n, minlength=4096)
        back = (second + 0.5) / (second.sum() + 2048)
        table = np.log(2 * back / (first[:, None] + 2))
        table[key >> 12, key & 4095] = np.log((n + 2 * back[key & 4095]) / (first[key >> 12] + 2))
        usual = np.zeros(33)
        block = key >> 19
        total = np.bincount(block, weights=n, minlength=33)
        usual = np.bincount(block, weights=n * table[key >> 12, key & 4095], minlength=33) / np.maximum(total, 1)
        # of a block that the corpus hardly has, nothing is known
        known = total > 5000
        self.excess = np.where(known[np.arange(4096) >> 7, None], table - usual[np.arange(4096) >> 7, None], 0.0).astype(np.float32)

    def of_lines(self, cp: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        """Mean excess of each line's letters; 0 where there are too few."""
        at = _letters()[cp]
        ok = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0) & (line[1:] == line[:-1]) & (line[1:] >= 0))
        total = np.bincount(line[ok], weights=self.excess[at[ok], at[ok + 1]], minlength=n)
        pairs = np.bincount(line[ok], minlength=n)
        return np.where(pairs >= LEAST_LETTERS, total / np.maximum(pairs, 1), 0.0)


def periodic(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether a value comes at least RUN_TIMES times at one and the same distance (places ascend)."""
    n = len(values)
    if n < RUN_TIMES:
        return np.zeros(n, bool)
    order = np.argsort(values, kind="stable")
    v, at = values[order], places[order]
    first = np.append(True, v[1:] != v[:-1])
    group = np.cumsum(first) - 1
    gap = np.append(0, np.diff(at))
    gap[first] = -1
    even = np.append(False, (gap[1:] == gap[:-1]) & ~first[1:] & ~first[:-1])
    out = np.zeros(n, bool)
    out[order] = (np.bincount(group, weights=even) >= RUN_TIMES - 2)[group]
    return out


def line_symbols(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, letters_: Letters | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol and weight of each non-blank line [starts, ends) of cp, the class counts, and whether it ends in punctuation."""
    n = len(starts)
    cls = _lut()[cp]
    # a comma or semicolon before a space is punctuation, not a cell border
    for border in (COMMA, SEMI):
        at = np.flatnonzero(cls == border)
        after = cls[np.minimum(at + 1, len(cp) - 1)]
        cls[at[after == SPACE]] = DASH
    line = (np.cumsum(np.bincount(starts, minlength=len(cp))[: len(cp)]) - 1).astype(np.int32)
    count = np.bincount(np.maximum(line, 0) * np.int64(N_CLASSES) + cls, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    count[:, NEWLINE] = 0
    of = lambda *k: count[:, list(k)].sum(1)

    def per_line(mask: np.ndarray) -> np.ndarray:
        at = line[np.flatnonzero(mask)]
        return np.bincount(at[at >= 0], minlength=n)

    blank = (cls == SPACE) | (cls == NEWLINE) | (cls == TAB)
    before = np.append(True, blank[:-1])
    word_start = ~blank & before
    words = per_line(word_start)
    letters = of(LOWER, UPPER, OTHER)
    solid = count.sum(1) - of(SPACE, TAB)
    digits = count[:, DIGIT]
    # first and last visible character of the line
    vis = np.flatnonzero(~blank)
    first = vis[np.searchsorted(vis, starts)] if n else starts
    last = vis[np.searchsorted(vis, ends) - 1] if n else starts
    last_cls = cls[last]
    # look behind closing marks for the stop
    back = last.copy()
    for _ in range(3):
        step = (cls[back] == CLOSER) & (back > first)
        back = np.where(step, back - 1, back)
    stopped = np.isin(cls[back], (STOP, DOT)) | np.isin(cp[back], [ord(c) for c in ":;"]) & (back > first)
    comma_end = np.isin(cp[last], [ord(c) for c in ",،、，"])
    hyphen_end = last_cls == DASH

    nxt = np.append(cls[1:], NEWLINE)
    # gaps of two spaces or more inside the line
    gap = np.flatnonzero((cls == SPACE) & (nxt == SPACE) & ~before)
    gap = gap[(gap > first[line[gap]]) & (gap < last[line[gap]])] if n else gap
    gaps = np.bincount(line[gap], minlength=n)
    dots = per_line((cls == DOT) & (nxt == DOT))
    comma_digit = per_line((cp == ord(",")) & (nxt == SPACE) & (np.append(cls[2:], [SPACE, SPACE])[: len(cp)] == DIGIT)) if len(cp) > 2 else np.zeros(n, int)
    ascii_letter = ((cp | 32) >= 97) & ((cp | 32) <= 122)
    vowel = np.zeros(128, bool)
    vowel[[ord(c) for c in "aeiouyAEIOUY"]] = True
    vowels = per_line(ascii_letter & vowel[np.minimum(cp, 127)])
    ascii_letters = per_line(ascii_letter)
    not_ascii = per_line((cp > 127) & ~blank)

    # repetition: words equal to one of the last eight, characters equal to one of the last four
    same_words = np.zeros(n, np.int64)
    ws = np.flatnonzero(word_start)
    if len(ws):
        place = np.arange(len(cp), dtype=np.uint64) - np.repeat(ws.astype(np.uint64), np.diff(np.append(ws, len(cp))))[-len(cp):] if ws[0] == 0 else None
        if place is None:
            place = np.arange(len(cp), dtype=np.uint64)
            place[ws[0] :] -= np.repeat(ws.astype(np.uint64), np.diff(np.append(ws, len(cp))))
        val = _mix()[cp] * (place * np.uint64(2) + np.uint64(1))
        val[blank] = 0
        h = np.add.reduceat(val, ws)
        wl = line[ws]
        for k in range(1, min(9, len(ws))):
            at = np.flatnonzero(h[k:] == h[:-k]) + k
            at = at[wl[at] == wl[at - k]]
            same_words = np.maximum(same_words, np.bincount(wl[at], minlength=n))
    # whatever its length, what comes again and again in a document: runs of words, and whole lines
    again = np.zeros(n, np.int64)
    if len(ws) >= RUN_WORDS:
        run = np.zeros(len(ws) - RUN_WORDS + 1, np.uint64)
        for k in range(RUN_WORDS):
            run = run * np.uint64(0x9E3779B97F4A7C15) + h[k : len(ws) - RUN_WORDS + 1 + k]
        wd = doc[wl]
        inside = wd[RUN_WORDS - 1 :] == wd[: len(run)]
        run = run + wd[: len(run)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        hit = np.flatnonzero(inside)
        hit = hit[periodic(run[hit], hit)]
        covered = np.zeros(len(ws) + 1, np.int64)
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + RUN_WORDS, -1)
        again = np.bincount(wl[np.cumsum(covered[:-1]) > 0], minlength=n)
    same_chars = np.zeros(n, np.int64)
    for k in range(1, 5):
        if len(cp) > k:
            at = np.flatnonzero((cp[k:] == cp[:-k]) & ~blank[k:]) + k
            at = at[line[at] == line[at - k]]
            same_chars = np.maximum(same_chars, np.bincount(line[at], minlength=n))
    whole = np.add.reduceat(np.append(val, np.uint64(0)), np.stack([starts, ends], 1).ravel())[::2] if len(ws) else np.zeros(n, np.uint64)
    dup_prev = np.append(False, (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])) & (words > 3) if n else np.zeros(0, bool)

    n_docs = int(doc[-1]) + 1 if n else 1
    lines_in = np.bincount(doc, minlength=n_docs)
    in_turn = periodic(whole + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), np.arange(n)) & (words > 3)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        """How many lines of its document the mask holds, for each line."""
        return np.bincount(doc, weights=mask, minlength=n_docs)[doc]

    def together(c: np.ndarray, least: int) -> np.ndarray:
        """Lines whose count c is at least `least` and the same as in a neighbouring line of the document."""
        ok = c >= least
        up = np.append(False, (c[1:] == c[:-1]) & (doc[1:] == doc[:-1])) if n else ok
        down = np.append(up[1:], False)
        return ok & (up | down)

    gap_rows = (gaps >= 1) & (dots < 3)
    near = np.append(False, gap_rows[:-1] & (doc[1:] == doc[:-1])) | np.append(gap_rows[1:] & (doc[1:] == doc[:-1]), False) if n else gap_rows
    pipes, symbols = count[:, PIPE], of(ASCII_SYMBOL)
    two_columns = together(count[:, COMMA], 1) & ~stopped & (words <= 4) & (cls[last] != COMMA) & (cls[first] != COMMA) if n else gap_rows
    cells = two_columns | together(count[:, TAB], 1) | together(pipes, 2) & (cp[first] == ord("|")) | together(count[:, COMMA], 2) & (stopped == 0) | together(count[:, SEMI], 1) & (words < 3 + count[:, SEMI] * 3) | gap_rows & near & (words < 3 + 4 * (gaps + 1))
    bullet_char = np.isin(cp[first], [ord(c) for c in "*•·-–—▪◦‣+"])
    after_first = cp[np.minimum(first + 1, len(cp) - 1)] if len(cp) else first
    numbered = ((cls[first] == DIGIT) | (cp[first] == ord("("))) & (words > 1) & _numbered(cp, first, last)
    bullet = (bullet_char & (after_first == 32) | numbered) & ~stopped & (words <= 9)
    # a sign that no speech begins with marks items of any length, where most lines have it
    sign = np.isin(cp[first], [ord(c) for c in "*•·▪◦‣+"]) & (after_first == 32) if n else bullet
    bullet |= sign & (np.bincount(doc, weights=sign, minlength=n_docs)[doc] * 2 > lines_in[doc]) if n else sign
    leader = (last_cls == DIGIT) & ((dots >= 3) | (comma_digit >= 1) & (words <= 12) & (digits * 4 >= solid))
    short = ~stopped & ~comma_end & ~hyphen_end & (words <= 6) & (letters > 0) & (solid <= np.where(count[:, OTHER] * 2 > solid, 16 + 40 * (words > 1), 45))
    dense = np.maximum(solid, 1)
    mean_len = solid / np.maximum(words, 1)
    hexlike = (digits + symbols + count[:, PERCENT]) * 1.0 / dense
    plain = not_ascii * 10 < dense
    noise = plain & (solid >= 8) & (
        ((symbols + pipes) * 4 > dense)
        | (ascii_letters >= 8) & (vowels * 100 < ascii_letters * 16)
        | (mean_len > 25) & (solid >= 28) & (dots < 3)
        | (hexlike > 0.35) & ~leader & (letters > 0)
    )
    # lines of code: brackets and signs of operations among few letters
    signs = per_line(np.isin(cp, [ord(c) for c in "(){}[]=<>;:_+*/\\&|^~"]))
    noise |= plain & (signs >= 3) & (signs * 8 > dense) & (letters > 0) & ~leader & ~(cp[first] == ord("|")) & (count[:, TAB] == 0)
    if letters_ is not None and n:
        noise |= (letters_.of_lines(cp, line, n) < np.where(not_ascii > 0, -UNLIKELY_BEYOND, -UNLIKELY)) & (words > 2)
    noise |= (solid >= 8) & (letters + digits + count[:, MARK] == 0) & (symbols + count[:, SYMBOL] + pipes + count[:, STOP] + dots > 4)
    noise |= (count[:, SYMBOL] * 2 > dense) & (letters * 4 < dense) & (solid >= 8)
    repeat = (same_words >= 6) & (same_words * 10 >= words * 7) | (same_chars * 100 >= dense * 85) & (solid >= 16) | dup_prev & np.append(dup_prev[1:], False)

    repeat |= (again * 10 >= words * 8) & (words > 3) | in_turn
    # short lines of which a part ends in punctuation are verse
    marked = per_doc(short | (stopped | comma_end) & (words <= 9) & (solid <= 60)), per_doc((stopped | comma_end) & (words <= 9) & (solid <= 60))
    verse = (marked[1] * 5 >= marked[0]) & (marked[1] > 1) if n else short

    sym = np.full(n, WRAPPED, np.uint8)
    sym[short & ~verse] = SHORT
    sym[stopped | comma_end & (words > 3)] = SENTENCE
    sym[stopped & ((words > 14) | (count[:, OTHER] * 2 > solid) & (solid > 30))] = PARAGRAPH
    sym[(letters == 0) & (solid < 8)] = NEUTRAL
    sym[noise] = NOISE
    sym[leader] = LEADER
    sym[bullet] = BULLET
    sym[cells] = CELLS
    sym[noise & ((symbols + count[:, PERCENT]) * 4 > dense) & ~(cp[first] == ord("|")) & (count[:, TAB] == 0)] = NOISE
    sym[repeat & ~cells & ~leader] = REPEAT
    # a stretch of letters or digits between the lines weighs as a line
    weight = solid.astype(float)
    stretch = (words <= 2) & (mean_len >= LONG_WORD) & (letters + digits + count[:, MARK] >= np.where(count[:, OTHER] * 2 > solid, 1.0, 0.8) * solid)
    excused = stretch & (per_doc(stretch) * 3 <= lines_in[doc]) if n else stretch
    sym[excused], weight[excused] = NEUTRAL, np.minimum(weight[excused], LINE_CHARS)
    return sym, weight, count, stopped


def _numbered(cp: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Lines that begin with a number of up to four digits and a full stop or bracket, then a space."""
    at = first + (cp[first] == ord("("))
    ok = np.zeros(len(first), bool)
    for k in range(1, 5):
        prev = at + k - 1
        end = np.minimum(at + k, len(cp) - 2)
        digit = (cp[np.minimum(prev, len(cp) - 1)] >= 48) & (cp[np.minimum(prev, len(cp) - 1)] <= 57)
        run = digit if k == 1 else run & digit
        ok |= run & ((cp[end] == ord(".")) | (cp[end] == ord(")"))) & (cp[end + 1] == 32) & (end < last)
    return ok


def expected(sym: np.ndarray, doc: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of symbols in states and of moves between states, by the forward and backward passes over the documents' lines."""
    emitted, moved = np.zeros((4, model.emission.shape[1])), np.zeros((4, 4))
    n = len(sym)
    if not n:
        return emitted, moved
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    length = np.diff(np.append(start, n))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    like = model.emission.T
    ahead, scale = np.zeros((n, 4)), np.ones(n)
    top = int(length[0])
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(1, top + 1)]
    for t in range(top):
        at = start[: alive[t - 1] if t else len(start)] + t
        now = (ahead[at - 1] @ model.moves if t else 0.25) * like[sym[at]]
        scale[at] = now.sum(1)
        ahead[at] = now / scale[at][:, None]
    after = np.ones((n, 4))
    for t in range(top - 2, -1, -1):
        at = start[: alive[t]] + t
        nxt = like[sym[at + 1]] * after[at + 1] / scale[at + 1][:, None]
        moved += (ahead[at].T @ nxt) * model.moves
        after[at] = nxt @ model.moves.T
    both = ahead * after
    for k in range(4):
        emitted[k] = np.bincount(sym, weights=both[:, k], minlength=emitted.shape[1])
    return emitted, moved


def viterbi(sym: np.ndarray, doc: np.ndarray, model: Model | None = None) -> np.ndarray:
    """The likeliest state of each line; all documents of the batch take each step together."""
    emit, move = (model.emit, model.move) if model else _model()
    n = len(sym)
    if not n:
        return np.zeros(0, np.uint8)
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    length = np.diff(np.append(start, n))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    back = np.zeros((n, 4), np.uint8)
    score = emit[:, sym[start]].T + math.log(0.25)
    final = score.copy()
    alive = len(start)
    for t in range(1, int(length[0])):
        alive = int(np.searchsorted(-length, -t, side="left"))
        at = start[:alive] + t
        way = score[:alive, :, None] + move[None]
        back[at] = way.argmax(1)
        score = way.max(1) + emit[:, sym[at]].T
        final[:alive] = score
    path = np.zeros(n, np.uint8)
    state = final.argmax(1).astype(np.uint8)
    for t in range(int(length[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-length, -t, side="left"))
        at = start[:alive] + t
        path[at] = state[:alive]
        if t:
            state[:alive] = back[at, state[:alive]]
    return path


def lines_of(texts: list[str | None], common: frozenset[str] | None = None, letters: Letters | None = None) -> dict[str, list]:
    """The statistics of SCHEMA that need no model, and the symbols (one byte a line) and weights (float32) of each text's lines."""
    names = [f.name for f in SCHEMA][:5]
    out: dict[str, list] = {f: [None] * len(texts) for f in (*names, "symbols", "weights")}
    for lo, hi in passes(texts):
        part = [t or "" for t in texts[lo:hi]]
        cp = points("\n".join(part) + "\n")
        size = np.array([len(t) + 1 for t in part])
        cut = np.cumsum(size)
        nl = np.flatnonzero(cp == 10)
        starts, ends = np.append(0, nl[:-1] + 1), nl
        cls = _lut()[cp]
        vis = np.cumsum((cls != SPACE) & (cls != NEWLINE) & (cls != TAB))
        full = vis[ends] > np.where(starts > 0, vis[np.maximum(starts - 1, 0)], 0)
        starts, ends = starts[full], ends[full]
        if not len(starts):
            for i in range(lo, hi):
                out["n_words"][i] = 0 if texts[i] is not None else None
            continue
        doc = np.searchsorted(cut, starts, side="right")
        sym, weight, count, stopped = line_symbols(cp, starts, ends, doc, letters)
        k = len(part)
        lines = np.bincount(doc, minlength=k)
        stops = np.bincount(doc, weights=stopped, minlength=k)
        symbol = np.bincount(doc, weights=count[:, [ASCII_SYMBOL, SYMBOL, PIPE, PERCENT]].sum(1), minlength=k)
        visible = np.bincount(doc, weights=count.sum(1) - count[:, SPACE] - count[:, TAB], minlength=k)
        edge = np.searchsorted(doc, np.arange(k + 1))
        for i, t in enumerate(texts[lo:hi]):
            if t is None:
                continue
            words = t.split()
            n = len(words)
            known = sum(map(common.__contains__, words)) / n if common is not None and n else None
            row = [n, float(visible[i]) / n if n else None, float(symbol[i] / visible[i]) if visible[i] else None, float(stops[i] / lines[i]) if lines[i] else None, known]
            own = slice(edge[i], edge[i + 1])
            for f, v in zip(out, [*row, sym[own].tobytes(), weight[own].astype(np.float32).tobytes()], strict=True):
                out[f][lo + i] = v
    return out


def shares(symbols: list[bytes | None], weights: list[bytes | None], model: Model | None = None) -> dict[str, list]:
    """The label shares and the kind of each document, from its lines; null where it has none."""
    out: dict[str, list] = {f.name: [None] * len(symbols) for f in list(SCHEMA)[5:]}
    sym, doc = _joined(symbols)
    weight = np.frombuffer(b"".join(w or b"" for w in weights), np.float32)
    state = viterbi(sym, doc, model)
    k = len(symbols)
    share = np.stack([np.bincount(doc, weights=weight * (state == s), minlength=k) for s in range(4)], 1)
    share = share / np.maximum(share.sum(1), 1e-9)[:, None]
    for i, x in enumerate(symbols):
        if x:
            kind = "prose" if share[i][0] >= 0.5 else STATES[1 + int(share[i][1:].argmax())]
            for f, v in zip(out, [*map(float, share[i]), kind], strict=True):
                out[f][i] = v
    return out


def _joined(symbols: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all lines of a batch, and the document of each line."""
    return np.frombuffer(b"".join(x or b"" for x in symbols), np.uint8), np.repeat(np.arange(len(symbols)), [len(x or b"") for x in symbols])


def statistics(texts: list[str | None], common: frozenset[str] | None = None, letters: Letters | None = None, model: Model | None = None) -> dict[str, list]:
    """The columns of SCHEMA for a list of texts; null for null texts, kind null where there is no line."""
    got = lines_of(texts, common, letters)
    symbols, weights = got.pop("symbols"), got.pop("weights")
    return got | shares(symbols, weights, model)


def common_words(df: DataFrame, text: str, most: int = 2000) -> DataFrame:
    """(key, n): the `most` most frequent words of all rows; ties by the word."""
    return count_tokens(df, text, str.split).orderBy(F.desc("n"), "key").limit(most)


def letter_model(df: DataFrame, text: str) -> Letters:
    """The bigram model of the letters of all rows; its table has 4096 x 4096 keys at most, some ten thousand in practice."""
    return Letters({r["key"]: r["n"] for r in count_tokens(df, text, letter_pairs, "key long, n long", flush=100_000).collect()})


def fit(lines: DataFrame, rounds: int = ROUNDS) -> Model:
    """The hidden Markov model, fitted on the column `symbols` of all rows; 56 numbers a batch come back each round."""
    model = Model()
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.DoubleType())])
    for _ in range(rounds):

        def make(model=model):
            def of(symbols):
                emitted, moved = expected(*_joined(symbols), model)
                n = np.concatenate([emitted.ravel(), moved.ravel()])
                return {"at": list(range(len(n))), "n": n.tolist()}

            return of

        sums = {r["at"]: r["n"] for r in map_columns(lines, ["symbols"], schema, make).groupBy("at").agg(F.sum("n").alias("n")).collect()}
        n = np.array([sums.get(i, 0.0) for i in range(model.emission.size + 16)])
        model = model.fitted(n[: model.emission.size].reshape(model.emission.shape), n[model.emission.size :].reshape(4, 4))
    return model


def text_quality(df: DataFrame, key: str = "chapter_id", text: str = "text", common: DataFrame | None = None) -> DataFrame:
    """key and the columns of SCHEMA, one row for each row of df.

    Null texts give nulls; empty and blank texts give 0 words and a null kind. Rows with the same
    key stay apart; other columns of df, whatever their names, play no part. With `common` (rows
    (key, n), at most a few thousand: common_words' bound) the share of common words is filled.
    Texts are read twice: for the letters' model, and for the lines' symbols, of which one byte a line
    is kept for fitting and labelling.
    """
    words = frozenset(r["key"] for r in common.collect()) if common is not None else None
    cast = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast((words, letter_model(cast, "__text")))
    plain, labels = list(SCHEMA)[:5], list(SCHEMA)[5:]
    own = T.StructField("__key", df.schema[key].dataType)
    binary = [T.StructField("symbols", T.BinaryType()), T.StructField("weights", T.BinaryType())]

    def lines():
        words, letters = shared.value
        return lambda keys, texts: {"__key": keys} | lines_of(texts, words, letters)

    kept = checkpointed(map_columns(cast, ["__key", "__text"], T.StructType([own, *plain, *binary]), lines))
    model = fit(kept)
    names = [f.name for f in plain]

    def label():
        return lambda keys, *cols: {key: keys} | dict(zip(names, cols, strict=False)) | shares(cols[-2], cols[-1], model)

    schema = T.StructType([T.StructField(key, own.dataType), *plain, *labels])
    return map_columns(kept, ["__key", *names, "symbols", "weights"], schema, label)


def unnatural(df: DataFrame, key: str = "chapter_id", text: str = "text") -> DataFrame:
    """(key, kind): the documents of which most is a list, a table or junk."""
    return text_quality(df, key, text).where(F.col("kind") != "prose").select(key, "kind")
