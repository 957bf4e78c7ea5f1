"""English number words of integers up to 999,999, as columns.

Style: `one thousand, two hundred and thirty-four`, `one thousand and one`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import let

# Number words.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def _pick(words: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), at.cast("int"))


def _below_hundred(n: Column) -> Column:
    tens = _pick(TENS, F.floor(n / 10))
    return F.when(n < 20, _pick(SMALL, n)).when(n % 10 == 0, tens).otherwise(F.concat(tens, F.lit("-"), _pick(SMALL, n % 10)))


def _below_thousand(n: Column) -> Column:
    hundreds = F.concat(_pick(SMALL, F.floor(n / 100)), F.lit(" hundred"))
    return F.when(n < 100, _below_hundred(n)).when(n % 100 == 0, hundreds).otherwise(F.concat(hundreds, F.lit(" and "), _below_hundred(n % 100)))


def cardinal(n: Column) -> Column:
    """Words of n from 0 to 999,999; null for null and beyond."""
    n = n.cast("long")
    low = n % 1000
    thousands = F.concat(_below_thousand(F.floor(n / 1000)), F.lit(" thousand"))
    words = (
        F.when(n < 1000, _below_thousand(n))
        .when(low == 0, thousands)
        .when(low < 100, F.concat(thousands, F.lit(" and "), _below_hundred(low)))
        .otherwise(F.concat(thousands, F.lit(", "), _below_thousand(low)))
    )
    return F.when((n >= 0) & (n <= 999_999), words)


def ordinal(n: Column) -> Column:
    """The ordinal of n from 0 to 999,999: the last word of the cardinal put into its ordinal form."""
    return let(cardinal(n), _ordinal_of)


def _ordinal_of(words: Column) -> Column:
    head, last = F.regexp_extract(words, r"\A(.*?)([a-z]+)\z", 1), F.regexp_extract(words, r"\A(.*?)([a-z]+)\z", 2)
    form = F.when(last.endswith("y"), F.regexp_replace(last, "y$", "ieth")).otherwise(F.concat(last, F.lit("th")))
    for a, b in ORDINALS.items():
        form = F.when(last == a, b).otherwise(form)
    return F.concat(head, form)
