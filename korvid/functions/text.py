"""Text functions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_ascii(c: Column) -> Column:
    """Lower-case ASCII letters only: accented capitals stay as they are."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def tokenise(c: Column) -> Column:
    """Different ASCII words of letters and digits, folded; every other character separates. Null gives null."""
    return F.array_distinct(F.filter(F.split(fold_ascii(c), "[^a-zA-Z0-9]+"), lambda t: t != ""))
