"""Text and time helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def squash(query) -> Column:
    """Trim all Unicode white space at both ends and lower-case (``trim`` removes blanks only)."""
    return F.lower(F.regexp_replace(_col(query), r"(?U)^\s+|\s+$", ""))


def tokens(text) -> Column:
    """Lower-cased words, split at white space."""
    return F.array_remove(F.split(F.lower(_col(text)), r"\s+"), "")


def related(a: Column, b: Column) -> Column:
    """One text is a prefix of the other."""
    return F.startswith(a, b) | F.startswith(b, a)


def iso_millis(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stable_id(*parts) -> Column:
    """A replayable identifier; random ids would change when a task is run again."""
    return F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts]))
