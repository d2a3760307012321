"""Column forms of number and string rules that differ from Spark's own: rounding half up, integer prefixes,
Unicode white space, truthiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: code points that count as white space or line ends
WHITE_SPACE = r"\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The greatest integer that a double counts exactly; longer numbers are taken as this.
GREATEST = 9_007_199_254_740_991


def round_half_up(y: Column) -> Column:
    """Nearest integer, halves towards plus infinity; null stays null."""
    below = F.floor(y)
    return (below + F.when(y - below >= 0.5, 1).otherwise(0)).cast("long")


def is_blank(s: Column) -> Column:
    """Whether nothing but white space is in s."""
    return ~s.rlike(f"[^{WHITE_SPACE}]")


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\\z", "")


def strip_space(s: Column) -> Column:
    return F.regexp_replace(s, f"[{WHITE_SPACE}]+", "")


def integer_prefix(s: Column) -> Column:
    """The integer that s begins with after white space, else null."""
    found = F.regexp_extract(s, f"^[{WHITE_SPACE}]*([+-]?[0-9]+)", 1)
    return F.when(found != "", F.coalesce(found.try_cast("long"), F.lit(GREATEST)))
