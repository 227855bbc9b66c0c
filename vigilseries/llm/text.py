"""Text expressions shared by the corpus operators. White space is ASCII white space throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def column(name: str) -> Column:
    """The column of that exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(text: Column) -> Column:
    """A missing text counts as empty."""
    return F.coalesce(text, F.lit(""))


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole(text), SPACE, " ")


def word_array(text: Column) -> Column:
    return F.filter(F.split(whole(text), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words are where white space, or the start, meets something else."""
    marked = F.regexp_replace(whole(text), WORD, "w")
    return F.length(F.translate(marked, SPACE_CHARS, "")).cast("long")


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_struct(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns of ``df`` as one, so that no name can clash with an operator's own."""
    return F.struct(*[column(c) for c in df.columns if c not in without])
