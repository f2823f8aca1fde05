"""Scalar helpers on columns: coercion, text normalisers, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A number, or null if the text is none."""
    return c.try_cast("double")


def currency(c: Column) -> Column:
    """Signs and blanks stripped, parentheses as minus; null if no number is left."""
    bare = F.regexp_replace(c, r"[$,\s]", "")
    return F.regexp_replace(bare, r"^\((.*)\)$", r"-$1").try_cast("double")


def currency_or_text(c: Column) -> Column:
    """The number in a money text as text, or the text as it is if there is none."""
    return F.coalesce(currency(c).cast("string"), c)


def loose_number(c: Column) -> Column:
    """Null and empty text as 0, as browsers read them; null for other text that is no number."""
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(0.0)).otherwise(c.try_cast("double"))


def folded(c: Column) -> Column:
    """Placeholders as null."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "nan", "none", "null"), t)


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, trimmed, in capitals."""
    return F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def clip(c: Column, lo: float, hi: float) -> Column:
    """Null stays null: least and greatest would skip it."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def compact(c: Column, sign: str = "$") -> Column:
    """Money: B and M with one decimal, K and less as whole numbers, halves up; the amount without its sign picks the unit."""
    size, mark = F.abs(c), F.lit(sign)
    one = lambda d: F.format_string("%.1f", F.round(c / d, 1))
    whole = lambda x: F.floor(x + 0.5).cast("bigint").cast("string")
    return F.when(size >= 1e9, F.concat(mark, one(1e9), F.lit("B"))).when(size >= 1e6, F.concat(mark, one(1e6), F.lit("M"))).when(size >= 1e3, F.concat(mark, whole(c / 1e3), F.lit("K"))).otherwise(F.concat(mark, whole(c)))


def titled(c: Column) -> Column:
    """Words with a capital, but and/of in small letters and St with a stop."""
    word = lambda w: F.when(F.upper(w) == "ST", "St.").when(F.upper(w).isin("AND", "OF"), F.lower(w)).otherwise(F.initcap(w))
    return F.array_join(F.transform(F.split(c, " "), word), " ")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
