"""Sentence and clause splitting, and packing into chunks of bounded size, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import _col, let, strip
from .patterns import WS

MAX_CHARS = 1000


# The look ahead comes first: it turns most positions away at the least cost.


def sentences(c: Column | str) -> Column:
    """Split at white space behind . ! or ?"""
    return F.split(_col(c), rf"(?={WS})(?<=[.!?]){WS}+", -1)


def clauses(c: Column | str) -> Column:
    """Split at white space behind , ; or :"""
    return F.split(_col(c), rf"(?={WS})(?<=[,;:]){WS}+", -1)


#: Parts that one fold holds: an array grows by copies, so long texts are packed block by block.
BLOCK = 512


def _flushed(s: Column) -> Column:
    """What is finished, with the current chunk."""
    return F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"]))


def _pack(parts: Column, start: Column, most: int, long: Callable[[Column, Column], Column] | None = None) -> Column:
    """Greedy packing: struct(out, cur) after all parts; a part that does not fit flushes what is there and becomes the current one, or goes to `long` if it is too long for a chunk."""

    def add(s: Column, p: Column) -> Column:
        fits = F.length(s["cur"]) + F.length(p) + 1 <= most
        step = F.when(fits, F.struct(s["out"].alias("out"), strip(F.concat(s["cur"], F.lit(" "), p)).alias("cur")))
        if long is not None:
            step = step.when(F.length(p) > most, long(s, p))
        return step.otherwise(F.struct(_flushed(s).alias("out"), p.alias("cur")))

    return F.aggregate(parts, start, add)


def chunks(c: Column | str, most: int = MAX_CHARS) -> Column:
    """Chunks of at most `most` characters, cut at sentences, in long sentences at clauses, else hard; none is blank.

    One fold over the sentences inside the JVM; the clauses of a long sentence are a fold within it.
    The sentences come in blocks, of which each has its own array, so that the cost grows with the text and not with its square.
    """
    none = F.array().cast("array<string>")
    state = lambda out, cur: F.struct(out.alias("out"), cur.alias("cur"))
    by_clauses = lambda s, p: _pack(clauses(p), state(_flushed(s), F.lit("")), most)

    def blocks(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda i: F.slice(parts, i, F.lit(BLOCK)))

    def add_block(s: Column, b: Column) -> Column:
        return let(_pack(b, state(none, s["cur"]), most, by_clauses), lambda r: F.struct(F.array_append(s["done"], r["out"]).alias("done"), r["cur"].alias("cur")))

    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.lit("").alias("cur"))
    last = lambda s: F.concat(F.flatten(s["done"]), F.when(s["cur"] == "", none).otherwise(F.array(s["cur"])))
    packed = F.aggregate(let(sentences(c), blocks), start, add_block, last)
    pieces = F.transform(
        packed,
        lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)), F.lit(most)), lambda i: strip(F.substring(x, i, F.lit(most))))),
    )
    return F.filter(F.flatten(pieces), lambda x: strip(x) != "")
