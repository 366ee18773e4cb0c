"""Text helpers: all built-in expressions, evaluated inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from linewatch.defaults import PAIR_SEPARATOR, PAIR_WIDTH, SPOOL_LENGTH, SPOOL_MARKER, TAG_MARKER


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_number(col: Column | str) -> Column:
    """Measurement text read as a double; unreadable text gives NULL, never an error."""
    return _c(col).try_cast("double")


def bracket_tag(col: Column | str, marker: str = TAG_MARKER) -> Column:
    """The part between the first and second ``marker`` (case-sensitive; to the end when
    there is one marker), trimmed of spaces and brackets at both ends.

    ``'Gripper at work pos Key [3]'`` gives ``'3'``; no marker gives ``''``.
    """
    return F.btrim(F.split_part(_c(col), F.lit(marker), F.lit(2)), F.lit(" []"))


def spool_code(col: Column | str, marker: str = SPOOL_MARKER, length: int = SPOOL_LENGTH) -> Column:
    """``length`` characters after the first ``marker``; from the start if it is absent."""
    c = _c(col)
    return c.substr(F.locate(marker, c) + 1, F.lit(length))


def pair_label(col: Column | str, width: int = PAIR_WIDTH, sep: str = PAIR_SEPARATOR) -> Column:
    """Short pair label: first ``width`` characters, ``' & '``, then ``width`` after ``sep`` and a space."""
    c = _c(col)
    return F.concat(F.left(c, F.lit(width)), F.lit(f" {sep} "), c.substr(F.locate(sep, c) + 2, F.lit(width)))
