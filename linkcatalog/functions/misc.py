"""Small helpers: shards, base-62 ids, prompt lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def parse_shard(text: str) -> tuple[int, int]:
    """``i/N`` with 0 <= i < N <= 16."""
    m = re.fullmatch(r"\s*(\d+)\s*/\s*(\d+)\s*", text)
    if not m or not 0 < int(m[2]) <= 16 or int(m[1]) >= int(m[2]):
        raise ValueError(f"not a shard: {text!r}")
    return int(m[1]), int(m[2])


def shard_of(key: Column, total: int) -> Column:
    """The last hex digit of an id modulo the number of shards."""
    return F.conv(F.right(key, F.lit(1)), 16, 10).cast("int") % total


def owner_id(code: Column) -> Column:
    """A base-62 number, least digit first; null for other characters or zero."""
    value = F.aggregate(
        F.sequence(F.lit(1), F.length(code)),
        F.lit(0).cast("decimal(38,0)"),
        lambda a, i: (a * 62 + F.instr(F.lit(BASE62), F.substr(F.reverse(code), i, F.lit(1))) - 1).cast("decimal(38,0)"),
    )
    return F.when(code.rlike("^[0-9A-Za-z]+$") & (value > 0), value.cast("string"))


def link_lines(urls: Column) -> Column:
    """``[i] url`` lines of an array."""
    return F.array_join(F.transform(urls, lambda u, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), u)), "\n")


def closure(tables: set[str], references: dict[str, set[str]]) -> set[str]:
    """All tables that ``tables`` refer to, themselves included."""
    out, left = set(), list(tables)
    while left:
        t = left.pop()
        if t not in out:
            out.add(t)
            left += references.get(t, ())
    return out
