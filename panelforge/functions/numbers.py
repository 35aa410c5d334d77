"""Numbers and their texts: parsing, rounding for display, unit suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of display.
MINUS, NONE, RANGE = "−", "—", "～"


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def parse_value(cell: Column) -> Column:
    """A CSV cell as a double; empty is null."""
    return F.nullif(F.trim(cell), F.lit("")).try_cast("double")


def parse_number(cell: Column, decimal: str = ".") -> Column:
    """Vendor numbers: grouping dropped, ``#N/A``, ``N/A`` and ``--`` null, either decimal mark."""
    t = F.trim(F.coalesce(cell, F.lit("")))
    bare = F.regexp_replace(t, "[\\s' ’]", "")
    plain = F.translate(F.replace(bare, F.lit("."), F.lit("")), ",", ".") if decimal == "," else F.replace(bare, F.lit(","), F.lit(""))
    return F.when((t == "") | t.rlike("(?i)^#N/A|^N/A$|^--$"), None).otherwise(plain.try_cast("double"))


def fixed(x: Column, places: int) -> Column:
    """Rounded half away from zero, with guard digits against binary noise; the sign goes if nothing is left."""
    r = F.round(F.round(x, 12), places)
    text = F.format_string(f"%.{places}f", F.abs(r).cast(f"decimal(38,{places})").cast("double"))
    return F.when(r < 0, F.concat(F.lit(MINUS), text)).otherwise(text)


def fmt(x: Column, places: int = 2, scale: float = 1.0, suffix: str = "", signed: bool = False) -> Column:
    """Display text: a typographic minus, a plus where asked for, a dash for null."""
    body = fixed(x * scale, places)
    if signed:
        body = F.when(F.round(x * scale, places) > 0, F.concat(F.lit("+"), body)).otherwise(body)
    return F.when(x.isNull() | F.isnan(x), F.lit(NONE)).otherwise(F.concat(body, F.lit(suffix)))


def fmt_pct(x: Column, places: int = 1, signed: bool = False) -> Column:
    return fmt(x, places, 100.0, "%", signed)


def fmt_pp(x: Column, places: int = 2) -> Column:
    return fmt(x, places, 100.0, "pp", True)


def fmt_lp(x: Column, places: int = 2) -> Column:
    return fmt(x, places, 1.0, " lp", True)


def fmt_ratio(x: Column, places: int = 2) -> Column:
    return F.when(x.isNull(), F.lit(NONE)).otherwise(F.concat(F.lit("×"), fixed(x, places)))


def delta_arrow(x: Column) -> Column:
    return F.when(x > 0, "▲").when(x < 0, "▼").otherwise("")


def machine_text(cell: Column) -> Column:
    """A display cell back to a machine number's text."""
    bare = F.regexp_replace(F.translate(cell, MINUS + "×+", "-"), "[%,\\s]|pp$|lp$", "")
    return F.when(bare.rlike("^-?[0-9]+(\\.[0-9]+)?$"), bare).otherwise(F.lit(""))
