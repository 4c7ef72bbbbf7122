"""Normalisation, tokens and similarity of names and addresses, all as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import gestalt

# The ASCII punctuation, the legal suffixes and the white space that names are normalised by.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SUFFIXES = "inc incorporated llc ltd limited pvt private corp corporation co company gmbh sa plc pty bv llp lp holdings group services enterprises".split()
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"
# What counts as a postal code, and as a number.
POSTAL = r"(?i)\b(\d{5,6}|[A-Z]\d[A-Z]\s?\d[A-Z]\d|[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})\b"
NUMBER = r"\b\d+\b"

_SUFFIX = rf"(?iU)\b(?:{'|'.join(SUFFIXES)})\b"
_EDGES = rf"^{WHITE}|{WHITE}$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(x: Column | str) -> Column:
    """Null as empty, white space at the ends gone."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), _EDGES, "")


def normalize_text(x: Column | str) -> Column:
    """Lower case, each punctuation character a space; nothing is collapsed or trimmed."""
    return F.translate(F.lower(F.coalesce(_c(x), F.lit(""))), PUNCTUATION, " " * len(PUNCTUATION))


def normalize_name(x: Column | str) -> Column:
    """normalize_text without legal suffixes, wherever they stand, and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_text(x), _SUFFIX, " "), WHITE, " "))


def normalize_country(x: Column | str) -> Column:
    return F.lower(stripped(x))


def tokens(norm: Column | str, min_len: int = 2) -> Column:
    """Words of at least min_len characters, in order, repeats kept."""
    return F.filter(F.split(_c(norm), WHITE), lambda t: F.length(t) >= min_len)


def char_ngrams(norm: Column | str, n: int = 3) -> Column:
    """Code-point n-grams of the text without white space; a shorter text is its own one, an empty text has none."""
    bare = F.regexp_replace(_c(norm), WHITE, "")

    def grams(holder: Column) -> Column:
        size = F.length(holder)
        many = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(holder, i, F.lit(n)))
        return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(holder)).otherwise(many)

    # the array of one binds the cleaned text, so that it is computed once a row and not once an n-gram
    return F.get(F.transform(F.array(bare), grams), F.lit(0))


def postal_codes(x: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(x), F.lit(POSTAL), F.lit(1)), lambda m: F.upper(F.replace(m, F.lit(" "), F.lit("")))))


def numeric_tokens(x: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(NUMBER), F.lit(0)))


def hashed(x: Column | str) -> Column:
    """The distinct members of an array as 64-bit hashes: pairs carry and compare 8 bytes a member, not strings."""
    return F.transform(F.array_distinct(_c(x)), lambda t: F.xxhash64(t))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Common members of arrays without repeats."""
    return F.size(F.array_intersect(_c(a), _c(b)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of arrays without repeats; 0 where they share nothing, also if both are empty. Without a branch, so that Spark
    computes an overlap once a row, wherever it stands."""
    both = overlap(a, b)
    return both / F.greatest(F.size(_c(a)) + F.size(_c(b)) - both, F.lit(1))


def levenshtein_ratio(a: Column | str, b: Column | str) -> Column:
    """1 - distance / longer length; 1 for two empty texts, 0 for one."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).when(F.least(F.length(a), F.length(b)) == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


@F.pandas_udf(DoubleType())
def _gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(gestalt.ratios(a, b), dtype="float64")


def gestalt_ratio(a: Column | str, b: Column | str) -> Column:
    """The Ratcliff-Obershelp ratio, for runs that want it instead of levenshtein_ratio. The only one that needs Python."""
    a, b = _c(a), _c(b)
    short = F.least(F.length(a), F.length(b)) == 0
    return F.when(short, F.when(a == b, 1.0).otherwise(0.0)).otherwise(_gestalt(a, b))


def length_ratio(a: Column | str, b: Column | str) -> Column:
    longest = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.least(F.length(_c(a)), F.length(_c(b))) / longest)
