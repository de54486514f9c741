"""Column helpers shared by the jobs: trimming, tokens, keys, rounding.

Everything here returns a Spark ``Column`` built from JVM functions, so the
jobs stay inside whole-stage code generation.
"""
from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, functions as F

# The characters that count as white space, including the
# separators U+001C..U+001F and the Unicode spaces, but not U+FEFF.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regular-expression class, then without the
# line feed for patterns that must stay on one line.
WS = "\\t-\\r\\x1c-\\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
HS = "\\t\\x0b-\\r\\x1c-\\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same set for Java alone, where the Unicode class tests faster than ranges.
TOKEN_GAP = r"(?U)[\s\x1c-\x1f]+"
BOM = "\ufeff"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wstrip(c: Column | str) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(as_col(c), F.lit(WS_CHARS))


def wstrip_long(c: Column | str) -> Column:
    """The same for long texts, most of which have nothing to strip: looking for
    the end to strip from costs several passes over the text."""
    def strip(t: Column) -> Column:
        blank = reduce(operator.or_, (F.startswith(t, F.lit(w)) | F.endswith(t, F.lit(w)) for w in WS_CHARS))
        return F.when(blank, wstrip(t)).otherwise(t)

    return F.get(F.transform(F.array(as_col(c)), strip), F.lit(0))


def is_blank(c: Column | str) -> Column:
    """True for null and for white-space-only text; stops at the first other
    character."""
    return F.coalesce(~F.regexp_like(as_col(c), F.lit(f"[^{WS}]")), F.lit(True))


def not_blank(c: Column | str) -> Column:
    return ~is_blank(c)


def empty_to_null(c: Column | str) -> Column:
    """The one place where an empty string becomes null; it does not trim."""
    return F.nullif(as_col(c), F.lit(""))


def tokens(c: Column | str) -> Column:
    """White-space tokens; blank text has none."""
    return F.filter(F.split(as_col(c), TOKEN_GAP), lambda t: t != "")


def word_count(c: Column | str) -> Column:
    return F.size(tokens(c))


def prefix_key(c: Column | str, order: str = "strip_cut", length: int = 80) -> Column:
    """Prefix key of a text: ``strip_cut`` strips first, ``cut_strip`` last."""
    c = as_col(c)
    if order == "strip_cut":
        # the far end of a long text matters only when the cut ends in white space
        cut = F.substring(F.ltrim(c, F.lit(WS_CHARS)), 1, length)
        return F.when(F.regexp_like(cut, F.lit(rf"[{WS}]\z")), F.substring(wstrip(c), 1, length)).otherwise(cut)
    if order == "cut_strip":
        return wstrip(F.substring(c, 1, length))
    raise ValueError(f"unknown key order: {order}")


def normalise_label(c: Column | str) -> Column:
    """Strip, then delete byte-order marks; the result is not stripped again."""
    return F.replace(wstrip(c), F.lit(BOM), F.lit(""))


def r4(c: Column) -> Column:
    """Round half to even at four decimals."""
    return F.bround(c, 4)


def score_units(c: Column | str) -> Column:
    """A score of four decimals as a whole number of 1/10000, so that sums of
    scores do not depend on the order of the rows."""
    return F.bround(as_col(c) * 10000).cast("bigint")


def exact_units(c: Column | str) -> Column:
    """The same, but an error for a score outside [-1, 1] or with more than
    four decimals, which the units could not stand for."""
    c = as_col(c)
    units = score_units(c)
    right = c.isNull() | ((F.abs(units) <= 10000) & (F.abs(c * 10000 - units) < 1e-6))
    return F.when(right, units).otherwise(F.raise_error(F.lit("a score is outside [-1, 1] or has more than four decimals: round it first")))


def article(descriptor: Column) -> Column:
    """``an`` before a vowel letter, else ``a``."""
    first = F.lower(F.substring(descriptor, 1, 1))
    return F.when(first.isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def split_trim(c: Column, pattern: str) -> Column:
    """Split, strip every part, drop blank parts."""
    return F.filter(F.transform(F.split(c, pattern), wstrip), lambda t: t != "")
