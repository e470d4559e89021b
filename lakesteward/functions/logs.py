"""Expressions over log text.

The patterns spell out Unicode classes because ``\\w`` and ``\\d`` are ASCII-only in Java.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks and the line shapes that decide a failure summary.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LOG4J_PREFIX = r"^\p{Nd}{2}/\p{Nd}{2}/\p{Nd}{2} \p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}"
CAUSE_WORDS = ["Error", "Exception", "Failure", "Failed"]
CAUSE_NAME = r"^[\p{L}\p{N}_.$]+(?:Error|Exception|Failure|Failed)(?::.*)?$"
CAUSED_BY = "Caused by:"


def decode_utf8_replace(data: Column) -> Column:
    """Bytes as text, each invalid sequence replaced by U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def strip_line(line: Column) -> Column:
    """Without the blanks at both ends, Unicode ones included."""
    return F.btrim(line, F.lit(BLANKS))


def split_at_line_ends(text: Column) -> Column:
    """Array of the texts between line ends; a final line end adds an empty one.

    ``\\R`` knows all line ends but three, which are first turned into one that it knows. That is
    three times as fast as a pattern that lists them.
    """
    for separator in ("\x1c", "\x1d", "\x1e"):
        text = F.replace(text, F.lit(separator), F.lit("\x0b"))
    return F.split(text, r"\R")


def split_lines(text: Column) -> Column:
    """Array of lines; a final line end does not add an empty line."""
    def without_empty_end(parts: Column) -> Column:
        return F.slice(parts, F.lit(1), F.size(parts) - (F.element_at(parts, -1) == "").cast("int"))

    # wrapped as a lambda over one element, so that the text is split once and not per mention
    return F.get(F.transform(F.array(split_at_line_ends(text)), without_empty_end), 0)


def is_log4j_line(line: Column) -> Column:
    return (F.substring(line, 3, 1) == "/") & line.rlike(LOG4J_PREFIX)


def is_cause_line(line: Column) -> Column:
    """A stripped line that names an error: ``Caused by: …`` or ``some.NameError[: …]``.

    A log4j line fits neither form. Plain substring tests keep most lines away from the pattern.
    """
    word = reduce(or_, (line.contains(w) for w in CAUSE_WORDS))
    return line.startswith(CAUSED_BY) | (word & line.rlike(CAUSE_NAME))
