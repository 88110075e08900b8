"""Text search, key hashes and sort keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_text_match(text: Column, terms: str) -> Column:
    """Whether a text contains every blank-separated term, in any case and order; no terms match everything."""
    found = F.lit(True)
    for t in terms.lower().split():
        found = found & F.contains(F.lower(text), F.lit(t))
    return found


def glob_to_regex(pattern: str) -> str:
    """A shell pattern (``*``, ``?``, ``[..]``) as an anchored regular expression for ``rlike``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = pattern[i + 1 : end]
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def md5_key(c: Column) -> Column:
    """The first 32 bits of the MD5 of a key as a number."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def shard_of(c: Column, shards: int) -> Column:
    """Shard of a key: its MD5 number modulo the number of shards."""
    return F.pmod(md5_key(c), F.lit(shards)).cast("int")


def lenient_number(c: Column) -> Column:
    """A text read as a number where it is one, else null."""
    return c.try_cast("double")


def lenient_equals(a: Column, b: Column) -> Column:
    """Equality that compares numerically where both sides read as numbers, else as text in any case."""
    x, y = lenient_number(a), lenient_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(a.cast("string")) == F.lower(b.cast("string")))


def natural_order(c: Column) -> list[Column]:
    """Sort keys: nulls first, then numbers by value, then other texts in any case."""
    number = lenient_number(c)
    return [c.isNotNull().asc(), number.isNull().asc(), number.asc(), F.lower(c.cast("string")).asc()]
