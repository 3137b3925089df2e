"""Column expressions over text: tokens, stop words, n-grams, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora.functions.constants import (
    CHUNK_WORDS, ENGLISH_STOP_WORDS, EXCERPT_CHARS, EXCERPT_WIDTH, TOKEN_PATTERN,
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coalesce_text(primary="clean_text", fallback="text") -> Column:
    """Cleaned text when present, else the raw text."""
    return F.coalesce(_c(primary), _c(fallback))


def tokenize(text, pattern: str = TOKEN_PATTERN) -> Column:
    """Lower-case word tokens (two or more word characters)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(pattern), F.lit(0))


def remove_stop_words(tokens, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """Drop stop words keeping order and repeats (``array_except`` would
    de-duplicate). ``isin`` over literals becomes a hash-set lookup."""
    stop = list(stop_words)
    return F.filter(_c(tokens), lambda t: ~t.isin(stop))


def ngrams(tokens, min_n: int = 1, max_n: int = 1) -> Column:
    """All n-grams for n in [min_n, max_n], words joined by one space,
    grouped by n then position. Each n is the one before, with the next word
    put behind every gram."""
    t = _c(tokens)
    none = F.array().cast("array<string>")
    parts, grams = [], t
    for n in range(1, max_n + 1):
        if n > 1:
            rest = F.greatest(F.size(t) - (n - 1), F.lit(0))
            grams = F.when(F.size(t) >= n, F.zip_with(
                F.slice(grams, 1, rest), F.slice(t, n, rest), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(none)
        if n >= min_n:
            parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def truncate_tokens(tokens, max_tokens: int) -> Column:
    return F.slice(_c(tokens), 1, max_tokens)


def text_length(text) -> Column:
    return F.char_length(_c(text)).cast("bigint")


def excerpt(text, chars: int = EXCERPT_CHARS, width: int = EXCERPT_WIDTH) -> Column:
    """First ``chars`` characters, whitespace runs collapsed, wrapped into
    lines of at most ``width`` characters joined by ``<br>``. Words longer
    than ``width`` are not hyphenated."""
    flat = F.trim(F.regexp_replace(F.substring(_c(text), 1, chars), r"\s+", " "))
    wrapped = F.regexp_replace(flat, rf"(.{{1,{width}}})(\s+|$)", "$1<br>")
    return F.regexp_replace(wrapped, r"<br>$", "")


def word_chunks(text, size: int = CHUNK_WORDS) -> Column:
    """Consecutive runs of ``size`` whitespace-separated words, re-joined
    by one space (array of chunk strings)."""
    words = F.filter(F.split(F.trim(_c(text)), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(size)),
                    lambda i: F.array_join(F.slice(words, i + 1, size), " ")))


def shorten_label(label, max_words: int = 3, sep: str = ", ") -> Column:
    return F.array_join(F.slice(F.split(_c(label), sep), 1, max_words), sep)
