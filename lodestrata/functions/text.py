"""Tokens, windows of tokens and phrase matching as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tokenizer is any function from a text column to an array column.
Tokenizer = Callable[[Column], Column]


def tokens(text: Column) -> Column:
    """Parts between single spaces. Empty parts count; an empty text is one empty token."""
    return F.split(text, " ", -1)


def bound_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a lambda an expression would be computed per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def windows(parts: Column, size: int, last: int) -> Column:
    """Sliding windows of ``size`` tokens, joined by a space.

    With n tokens: none for n = 0, the token for n = 1, one window of all for
    n < size; else the windows start at 0 to n - ``last``, the latest ones shorter where
    ``last`` < ``size``.
    """

    def of(t: Column) -> Column:
        n = F.size(t)
        starts = F.sequence(F.lit(1), F.greatest(n - last + 1, F.lit(1)))
        many = F.when(n - last + 1 < 1, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(t, i, size), " ")))
        return F.when(n == 0, F.array().cast("array<string>")).when((n == 1) | (n < size), F.array(F.array_join(t, " "))).otherwise(many)

    return bound_once(parts, of)


def has_phrase(parts: Column, phrase: list[str]) -> Column:
    """Whether the phrase's tokens stand side by side. An empty phrase is never found.

    Presence of each token is asked first: most rows fail there.
    """
    if not phrase:
        return F.lit(False)
    k = len(phrase)
    wanted = F.array(*map(F.lit, phrase))

    def of(t: Column) -> Column:
        found = F.size(t) >= k
        for token in dict.fromkeys(phrase):
            found = found & F.array_contains(t, token)
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1)))
        return found & F.exists(starts, lambda i: F.slice(t, i, k) == wanted)

    return bound_once(parts, of)
