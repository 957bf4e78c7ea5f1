"""Token ids of texts under a public byte-level BPE vocabulary.

Pre-tokenisation works on arrays of code point classes: letters, numbers, white space, others.
Each character's transition function either keeps the running token or starts one, so the
functions' composition is an associative scan, a running maximum over start positions. The
slices go to a cached pair merging; the slices' offsets can be kept for decoding.

Null and empty texts have no ids: an empty list.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import arrow_schema, passes, points, table

LETTER, NUMBER, SPACE, OTHER = range(4)
#: The characters with the property White_Space.
WHITE = frozenset([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: What stays with a leading apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
CACHE = 400_000


@functools.cache
def _classes() -> np.ndarray:
    import unicodedata as u

    return table("p7", lambda c: SPACE if ord(c) in WHITE else LETTER if (k := u.category(c)[0]) == "L" else NUMBER if k == "N" else OTHER)


def slice_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions at which a slice starts; every document (its first position in doc_starts) starts one."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    cls = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    change = np.append(True, cls[1:] != cls[:-1]) | first[:n]
    # the scan: where the run of each position began
    run = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    start = change.copy()
    # the last blank before a run of another class: a space joins that run, any other blank is a slice
    head = np.flatnonzero(change & (cls != SPACE))
    head = head[head > 0]
    head = head[(cls[head - 1] == SPACE) & ~first[head]]
    joins = cp[head - 1] == 32
    start[head[joins]] = False
    start[head - 1] = True
    # an apostrophe that starts a slice takes its suffix
    lone = np.flatnonzero((cp == 39) & start)
    lone = lone[lone + 1 < n]
    lone = lone[(cls[lone + 1] == LETTER) & ~first[lone + 1] & (run[lone] == lone)]
    if len(lone):
        for s in sorted(SUFFIXES, key=len):
            k = len(s)
            ok = lone[lone + k < n]
            for j, c in enumerate(s, 1):
                ok = ok[(cp[ok + j] == ord(c)) & ~first[ok + j]]
            if not len(ok):
                continue
            start[ok + 1] = False
            end = ok + k + 1
            end = end[end < n]
            start[end] = True
    return np.flatnonzero(start)


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Encoder:
    """Merges the bytes of slices; slices seen before come from a cache of bounded size."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache = ranks, {}

    def merge(self, piece: bytes) -> list[int]:
        """The pair of least rank is merged first, the leftmost of equal ones; a heap keeps long slices fast."""
        ranks = self.ranks
        if (r := ranks.get(piece)) is not None:
            return [r]
        n = len(piece)
        end = list(range(1, n + 1))
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        dead = bytearray(n + 1)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = nxt[i]
            if dead[i] or j >= n or end[j] != e:
                continue
            end[i], dead[j], nxt[i] = e, 1, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (h := prev[i]) >= 0 and (r := ranks.get(piece[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    def ids(self, piece: str) -> list[int]:
        got = self.merge(piece.encode("utf-8", "replace"))
        if len(piece) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = got
        return got

    def encode(self, texts: list[str | None], offsets: bool = False) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text; with offsets, the code point at which each id's slice starts too."""
        out, places, get = [], [], self.cache.get
        for lo, hi in passes(texts):
            part = [t or "" for t in texts[lo:hi]]
            cut = np.cumsum([0, *map(len, part)])
            starts = slice_starts(points("".join(part)), cut[:-1][np.diff(cut) > 0])
            at = np.searchsorted(starts, cut)
            for k, t in enumerate(part):
                s = (starts[at[k] : at[k + 1]] - cut[k]).tolist()
                ids: list[int] = []
                where: list[int] = []
                for a, b in zip(s, [*s[1:], len(t)]):
                    got = get(p := t[a:b]) or self.ids(p)
                    ids += got
                    if offsets:
                        where += [a] * len(got)
                out.append(ids)
                places.append(where)
        return out, places


def vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file; the public package's 50k byte-level one if no path is given."""
    if path is None:
        import public_tokenizers as P

        path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, offsets: bool = False, keep: tuple[str, ...] = (), count: bool = False) -> DataFrame:
    """(key, the columns named in keep, ids, with offsets also starts), one row for each row of df; with count n_tokens instead of ids.

    Null and empty texts give an empty list; repeated rows each give their own. The vocabulary (under
    1 MB, of fixed size) is read on the driver and broadcast. Columns not named play no part.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    ints = T.ArrayType(T.IntegerType())
    what = [T.StructField("n_tokens", T.LongType())] if count else [T.StructField("ids", ints)] + [T.StructField("starts", ints)] * offsets
    schema = T.StructType([df.schema[c] for c in (key, *keep)] + what)
    out = arrow_schema(schema)
    n = 1 + len(keep)

    def run(batches):
        enc = None
        for b in batches:
            enc = enc or Encoder(load_ranks(shared.value))
            step = 2000
            for lo in range(0, b.num_rows, step):
                p = b.slice(lo, step)
                ids, places = enc.encode(p.column(n).to_pylist(), offsets)
                made = [pa.array(map(len, ids), pa.int64())] if count else [_lists(ids)] + [_lists(places)] * offsets
                cols = [p.column(i).cast(out.field(i).type) for i in range(n)] + made
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    return df.select(F.col(key), *keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _lists(rows: list[list[int]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, n_tokens)."""
    return encode_documents(df, key, text, path, keep=keep, count=True)
