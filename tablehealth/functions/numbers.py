"""Rounding of published numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def published(value: Column | str, digits: int) -> Column:
    """Round to ``digits`` decimals from the exact binary value, ties to even.

    ``round`` and ``bround`` look at the shortest decimal text of a double, which
    turns 62.15 (stored slightly below) into a tie. Comparisons inside operators
    always use the unrounded value; only result columns pass through here.
    """
    column = F.col(value) if isinstance(value, str) else value
    return F.replace(F.format_number(column.cast("double"), digits), F.lit(","), F.lit("")).try_cast("double")
