"""Text helpers beyond the built-in functions, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_words(c: Column, delimiters: str) -> Column:
    """Words between any of the delimiter characters, empty ones left out."""
    return F.filter(F.split(c, f"[{re.escape(delimiters)}]"), lambda w: F.length(w) > 0)


def trim_non_letters(c: Column, side: str = "both") -> Column:
    """Without the leading and/or trailing characters that are not ASCII letters."""
    head, tail = r"^[^A-Za-z]+", r"[^A-Za-z]+$"
    return F.regexp_replace(c, {"head": head, "tail": tail, "both": f"{head}|{tail}"}[side], "")


def hamming_distance(a: Column, b: Column) -> Column:
    """Number of places that differ; null unless both texts are equally long."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x)))


def to_number(c: Column, kind: str = "double") -> Column:
    """The number a text spells, "nan" and "inf" included; null where it spells none."""
    return c.try_cast(kind)


def quote_csv(c: Column) -> Column:
    """The text as a CSV field, quotes doubled."""
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def positions(text: Column, part: str) -> Column:
    """All places (from 1) at which a part occurs, overlapping ones included; empty where there is none."""
    n = F.length(text) - len(part) + 1
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(len(part))) == part))


def like(c: Column, pattern: str, escape: str = "\\") -> Column:
    """LIKE, in which a character behind `escape` stands for itself."""
    parts, rest = [], iter(pattern)
    for x in rest:
        if x == escape:
            parts.append(re.escape(next(rest, escape)))
        else:
            parts.append({"%": ".*", "_": "."}.get(x, re.escape(x)))
    return c.rlike("(?s)\\A" + "".join(parts) + "\\z")


def code_points(c: Column) -> Column:
    """The text's characters as numbers (UTF-32)."""
    units = F.hex(F.encode(c, "UTF-32"))
    found = F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0))), lambda i: F.conv(F.substr(units, i * 8 + 1, F.lit(8)), 16, 10).cast("int"))
    return F.when(F.length(c) > 0, found).when(F.length(c) == 0, F.array().cast("array<int>"))


def from_code_points(c: Column) -> Column:
    """The text of an array of characters' numbers, the reverse of `code_points`."""
    units = F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return F.decode(F.unhex(units), "UTF-32")


def merge(*tables: DataFrame) -> DataFrame:
    """The words of any number of tables in one, repeated ones kept."""
    return reduce(DataFrame.unionByName, tables)
