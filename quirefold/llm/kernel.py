"""Vectorised text kernels and the Spark plumbing that the operators of this subpackage share.

A batch of texts becomes one array of code points, so that per-character work runs in numpy
instead of Python; lines and words are slices of that array.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.lineage import checkpointed

__all__ = ["arrow_schema", "checkpointed", "count_tokens", "letter_or_digit", "map_columns", "passes", "points", "runs", "table"]

#: Characters that one numpy pass holds at most (a longer single text is a pass of its own).
PASS_CHARS = 1 << 20
#: Arrow bytes whose rows are Python objects at a time (a larger single row is a slice of its own).
SLICE_BYTES = 4 << 20


@functools.cache
def table(name: str, of: Callable[[str], int]) -> np.ndarray:
    """of() of every code point, as an array to index with code points; made once in each worker."""
    return np.fromiter(map(of, map(chr, range(sys.maxunicode + 1))), np.uint8, sys.maxunicode + 1)


@functools.cache
def letter_or_digit() -> np.ndarray:
    """1 for the Unicode categories L and N."""
    return table("ln", lambda c: unicodedata.category(c)[0] in "LN")


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def passes(texts: list[str | None], most: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `most` characters together, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_columns(df: DataFrame, columns: list[str], schema: T.StructType, make: Callable[[], Callable[..., dict[str, list]]]) -> DataFrame:
    """df's columns, in Arrow batches, through the function that make() returns once in each task.

    The function gets one Python list for each column and returns the output columns; rows in and
    out need not match. Empty batches give no rows.
    """
    out = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for b in batches:
            if not b.num_rows:
                continue
            of = of or make()
            step = max(1, b.num_rows * SLICE_BYTES // max(b.nbytes, SLICE_BYTES))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                got = of(*(part.column(i).to_pylist() for i in range(len(columns))))
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def count_tokens(df: DataFrame, column: str, tokens: Callable[[str], Iterable], schema: str = "key string, n long", flush: int = 200_000) -> DataFrame:
    """(key, n): how often tokens() gives each key over all rows.

    Each task counts in Python and hands on its counts whenever it holds `flush` keys, so one
    task's memory is bounded and the shuffle gets partial counts instead of tokens.
    """
    from collections import Counter

    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    out = arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), out.field(0).type), pa.array(list(c.values()), pa.int64())], schema=out)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    c.update(tokens(t))
                    if len(c) > flush:
                        yield give()
                        c.clear()
        if c:
            yield give()

    return df.select(column).where(F.col(column).isNotNull()).mapInArrow(run, kind).groupBy("key").agg(F.sum("n").alias("n"))
