"""String building with the missing-value and number rules of the labels."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glue(*parts) -> Column:
    """Concatenate literals (str) and columns; a missing column reads ``NA``."""
    return F.concat(
        *(
            F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("NA"))
            for p in parts
        )
    )


def number_text(value: Column, digits: int) -> Column:
    """A rounded number without a trailing ``.0`` and without a negative zero."""
    rounded = F.round(value, digits) + F.lit(0.0)
    return F.regexp_replace(rounded.cast("string"), r"\.0$", "")


def drop_first(value: Column, fragment: str) -> Column:
    """Remove the first occurrence of a literal fragment; later ones stay."""
    return F.regexp_replace(value, "(?s)^(.*?)" + re.escape(fragment), "$1")


def has_item(items: Column, item: str) -> Column:
    """Membership that is false, not missing, for a missing list."""
    return F.coalesce(F.array_contains(items, item), F.lit(False))


def filled(value: Column) -> Column:
    """Neither missing nor empty."""
    return value.isNotNull() & (value != "")
