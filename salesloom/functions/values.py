"""Number and text conversions. ANSI mode is on in Spark 4, so every cast of text is a try_cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_number(col: Column, default: float | None = None, dtype: str = "decimal(18,2)") -> Column:
    """Text to number; thousands commas are allowed, anything unreadable becomes ``default``."""
    number = F.regexp_replace(F.trim(col.cast("string")), ",", "").try_cast(dtype)
    return number if default is None else F.coalesce(number, F.lit(default).cast(dtype))


def ratio(top: Column, bottom: Column, alt: float | None = 0.0) -> Column:
    """Guarded division: ``alt`` where the bottom is zero or missing."""
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if alt is None else F.coalesce(value, F.lit(float(alt)))


def blank_to_null(col: Column) -> Column:
    """A key that is empty after trimming, or the literal ``(Blank)``, counts as missing."""
    return F.when((F.trim(col) != "") & (F.trim(col) != "(Blank)"), col)


def typed_to_text(col: Column, dtype: str) -> Column:
    """Cells as text: null -> "", booleans lower case, integral floats without the ``.0``."""
    if dtype == "boolean":
        text = F.when(col, "true").otherwise("false")
        return F.when(col.isNull(), "").otherwise(text)
    if dtype in ("double", "float"):
        large = F.when(F.abs(col) >= 2.0**53, _whole_text(col.cast("double")))
        text = large.when(col == F.floor(col), col.try_cast("decimal(38,0)").cast("string"))
        return F.coalesce(text, col.cast("string"), F.lit(""))
    return F.coalesce(col.cast("string"), F.lit(""))


def _whole_text(col: Column) -> Column:
    """The digits of a whole double below 2 ** 126: its parts above and below 2 ** 63 are exact longs."""
    size = F.abs(col)
    high = F.floor(F.when(size < 2.0**126, size) / 2.0**63)
    low = (size - high.cast("double") * 2.0**63).cast("long").cast("decimal(19,0)")
    digits = (high.cast("decimal(19,0)") * F.lit(str(2**63)).cast("decimal(19,0)") + low).cast("string")
    return F.concat(F.when(col < 0, "-").otherwise(""), digits)


def join_nonempty(cols: list[Column], sep: str = ", ", default: str = "—") -> Column:
    """Join the non-empty values; ``default`` when none is left."""
    kept = F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in cols]), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, sep)).otherwise(default)


def default_text(col: Column, default: str = "—") -> Column:
    return F.coalesce(col.cast("string"), F.lit(default))


# A column whose name holds one of these is shown as money.
MONEY_NAMES = ("amount", "revenue", "profit", "cost", "expense", "plan", "actual", "sales")


def format_value(name: str, col: Column, dtype: str) -> Column:
    """Display text by column name and type: money, trimmed decimals, grouped integers."""
    numeric = dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") or dtype.startswith("decimal")
    if not numeric:
        return F.coalesce(col.cast("string"), F.lit(""))
    if any(hint in name.lower() for hint in MONEY_NAMES):
        text = F.format_number(col.cast("double"), 2)
    elif dtype in ("int", "bigint", "smallint", "tinyint"):
        text = F.format_string("%,d", col.cast("bigint"))
    else:
        text = F.regexp_replace(F.format_number(col.cast("double"), 4), r"\.?0+$", "")
    return F.when(col.isNull(), "").otherwise(text)


def is_guid(col: Column) -> Column:
    """36 characters, four of them dashes."""
    return (F.length(col) == 36) & (F.length(F.regexp_replace(col, "-", "")) == 32)


def strip_suffix(col: Column, suffix: str = ".md") -> Column:
    """Where the value ends in the suffix, every occurrence of it goes."""
    return F.when(col.endswith(suffix), F.replace(col, F.lit(suffix), F.lit(""))).otherwise(col)


def text_list(values) -> Column:
    """A literal array of strings; short lists only (rules, word lists)."""
    return F.array(*[F.lit(v) for v in values])


def contains_any(col: Column, words) -> Column:
    """Case-insensitive substring test against a short word list."""
    low = F.lower(col)
    test = F.lit(False)
    for word in words:
        test = test | low.contains(word.lower())
    return test
