"""Width, blank and digit normalisation with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
#: Zero of every decimal digit block of the Basic Multilingual Plane that a keyboard may yield.
_ZEROS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50)
_DIGITS_FROM = "".join(chr(z + d) for z in _ZEROS for d in range(10))
_DIGITS_TO = "0123456789" * len(_ZEROS)
BLANK = r"[\s   -‍  ⁠　﻿]"


def narrow(c: Column) -> Column:
    """Full-width letters, digits and signs as ASCII."""
    return F.translate(c, _WIDE, _ASCII)


def no_blanks(c: Column) -> Column:
    return F.regexp_replace(c, BLANK + "+", "")


def number_text(c: Column) -> Column:
    """Digits of other scripts, other minus signs and other decimal marks as ASCII."""
    marks_from, marks_to = ",٫·∙−‐‑–﹣", "....-----"
    return F.translate(narrow(c), _DIGITS_FROM + marks_from, _DIGITS_TO + marks_to)


def first_number(c: Column) -> Column:
    """The number in a text, null if there is none; a digit that follows a letter (cmH2O) begins none.

    Most texts are plain numbers, which a cast reads at once; only the others go through translation and a pattern.
    """
    found = F.regexp_extract(number_text(c), r"(?<![A-Za-z0-9.])(-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    plain = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(plain), plain), F.nullif(found, F.lit("")).try_cast("double"))


def once(df: DataFrame, *keep: str, **computed: Column) -> DataFrame:
    """df with computed columns that are evaluated once per row: filters on them stay above, since a generator is between."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in computed.items()]))))


def epoch_us(c: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 on the clock that the value shows, whatever the session's zone."""
    return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))


def fixed(x: Column, digits: int = 0) -> Column:
    """x as text with 0, 1 or 2 digits behind the point, rounded as C and Python do: by its exact binary value, ties to even."""
    a = F.abs(x)
    k = F.floor(a * 10**digits)
    # twice the scale times a, as a sum of doubles without error, held against the odd number 2 k + 1
    first, *rest = {0: (2,), 1: (16, 4), 2: (128, 64, 8)}[digits]
    total, lost = a * first, F.lit(0.0)
    for part in rest:
        y = a * part
        s = total + y
        lost = lost + (total - (s - (s - total))) + (y - (s - total))
        total = s
    over = (total - (2 * k + 1)) + lost
    n = F.when(over > 0, k + 1).when(over < 0, k).otherwise(k + k % 2).cast("long")
    sign = F.when(x < 0, "-").otherwise("")
    if digits == 0:
        return F.concat(sign, n.cast("string"))
    return F.concat(sign, F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))


def shortest(x: Column) -> Column:
    """x as text without a fraction of 0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")
