"""Placeholder substitution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve_template(text: Column, params: dict[str, str]) -> Column:
    """Replace every ``{name}`` in order of ``params``; unknown placeholders stay as they are."""
    for name, value in params.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.lit(value))
    return text
