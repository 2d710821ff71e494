"""Strict, default-filling coercion of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULTS = {"smallint": "0", "int": "0", "bigint": "0", "float": "0", "double": "0", "string": "", "boolean": "false"}


def trimmed(text: Column) -> Column:
    """Without any Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def empty_to_default(text: Column, kind: str) -> Column:
    """Null or blank gives the type's default, anything else must parse (an error otherwise)."""
    return F.coalesce(F.nullif(trimmed(text), F.lit("")), F.lit(DEFAULTS[kind])).cast(kind)


def number_list(text: Column, most: int = 65535) -> Column:
    """``[1|2| x |3]`` as an array: items that are no number in range are left out, order and repeats stay.

    White space outside the brackets doesn't count: `` [1|2] `` has both numbers.
    """
    inner = F.btrim(trimmed(F.coalesce(text, F.lit(""))), F.lit("[]"))
    items = F.transform(F.split(inner, r"\|", -1), lambda x: trimmed(x).try_cast("int"))
    return F.filter(items, lambda v: v.between(0, most))
