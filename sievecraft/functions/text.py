"""Text expressions: strip, normalise, token estimate, n-gram-set fingerprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points a Unicode-aware strip/split treats as blank.
WHITESPACE_CODE_POINTS = (
    0x0009, 0x000A, 0x000B, 0x000C, 0x000D,
    0x001C, 0x001D, 0x001E, 0x001F, 0x0020,
    0x0085, 0x00A0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(chr(p) for p in WHITESPACE_CODE_POINTS)
# The same set as a pattern. The outer class is a plain bitmap for Latin text; the
# exotic blanks are looked at only within their own range, which makes splitting
# three times faster than one flat class.
WHITESPACE_RUN = (
    r"[\s\x1C-\x1F\x85\xA0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]+"
)

CHARS_PER_TOKEN = 4  # fixed value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain Python variable would paste the expression at every use, and inside
    a lambda that means once per element.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Lower-cased words; blank text gives one empty word."""
    return F.split(strip(F.lower(c)), WHITESPACE_RUN)


def normalize(c: Column) -> Column:
    """Lower case, single blanks between words, none outside."""
    return F.array_join(words(c), " ")


def strip_key(c: Column) -> Column:
    """Identity of a text up to outer whitespace."""
    return F.md5(strip(c))


def est_tokens(c: Column) -> Column:
    return F.call_function("div", F.length(c), F.lit(CHARS_PER_TOKEN))


def distinct_ngrams(w: Column, n: int) -> Column:
    """Distinct word n-grams of an array of at least ``n`` words."""

    def gram(i: Column) -> Column:
        parts = [F.get(w, i)]
        for k in range(1, n):
            parts += [F.lit(" "), F.get(w, i + k)]
        return F.concat(*parts)

    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), gram))


def ngram_fingerprint(c: Column, n: int = 5) -> Column:
    """md5 of the sorted set of word n-grams, of the whole text if shorter.

    Word order and multiplicity beyond the n-gram set do not matter. Everything
    stays inside the row: nothing is exploded or shuffled to get the key.
    """

    def digest(w: Column) -> Column:
        grams = F.sort_array(distinct_ngrams(w, n))
        return F.md5(F.when(F.size(w) < n, F.array_join(w, " ")).otherwise(F.array_join(grams, "\n")))

    return let(words(c), digest)
