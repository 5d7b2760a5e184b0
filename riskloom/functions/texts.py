"""Short texts for people, and measures of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clip(text: Column, width: int = 88) -> Column:
    """White space collapsed, and cut at a word near ``width`` with dots after it."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    cut = F.substring(flat, 1, width - 3)
    space = F.length(cut) - F.locate(" ", F.reverse(cut))  # place of the last blank from 0; the length if there is none
    at_word = F.when((F.locate(" ", cut) > 0) & (space > width * 0.6), F.left(cut, space)).otherwise(cut)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(at_word, F.lit("...")))


def human_size(n: Column) -> Column:
    """Kilobytes below a megabyte, else megabytes with one digit; halves go to the even digit."""
    kb = F.concat(F.bround(n / 1024.0, 0).cast("bigint").cast("string"), F.lit(" KB"))
    mb = F.concat(F.format_string("%.1f", F.bround(n / 1048576.0, 1)), F.lit(" MB"))
    return F.when(n < 1024 * 1024, kb).otherwise(mb)


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def joined_some(values: Column, most: int, tail: str = " and {} more") -> Column:
    """The first ``most`` of an array, comma-separated, and how many more there are."""
    before, after = tail.split("{}")
    more = F.concat(F.lit(before), (F.size(values) - most).cast("string"), F.lit(after))
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(F.size(values) > most, more).otherwise(""))


def _bits(text: str | None) -> float:
    """Bits per character; characters are counted as code points, sorted."""
    if not text:
        return 0.0
    _, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)
    share = n / n.sum()
    return float(-(share * np.log2(share)).sum()) + 0.0


@F.pandas_udf(T.DoubleType())
def entropy(text: pd.Series) -> pd.Series:
    """Bits per character of whole texts, zero for none: one pass over each, in Arrow batches."""
    return text.map(_bits, na_action=None).astype("float64")


def entropy_of_short(text: Column) -> Column:
    """``entropy`` inside the JVM, for strings of one kind of letters: a pass for each distinct character."""
    letters = F.split(text, "")
    n = F.length(text).cast("double")
    of = F.transform(F.array_distinct(letters), lambda c: n - F.length(F.replace(text, c, F.lit(""))).cast("double"))
    return F.when(F.coalesce(n, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(-F.aggregate(of, F.lit(0.0), lambda s, c: s + F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0)))


def lasted(days: Column) -> Column:
    """A span in hours below a day, days below sixty, else months."""
    hours = F.concat(F.greatest(F.lit(1), F.bround(days * 24).cast("bigint")).cast("string"), F.lit(" hours"))
    whole = F.concat(F.bround(days).cast("bigint").cast("string"), F.lit(" days"))
    months = F.concat(F.bround(days / 30.44).cast("bigint").cast("string"), F.lit(" months"))
    return F.when(days < 1, hours).when(days < 60, whole).otherwise(months)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression that Java reads as Python does."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[^" + body[1:] + "]" if body.startswith("!") else "[" + ("\\" + body if body.startswith("^") else body) + "]")
            i = end + 1
        else:
            out.append(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c)
    return "^" + "".join(out) + "$"
