"""Column expressions that clean measurements and texts. No Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many nanomolar one unit is, by the unit's lower-case name with a plain u (fixed values).
NANOMOLAR = {"nm": 1.0, "um": 1000.0}


def plain_unit(unit: Column) -> Column:
    """Lower case, and both micro signs (U+03BC, U+00B5) as u."""
    return F.translate(F.lower(unit), "μµ", "uu")


def to_nanomolar(value: Column, unit: Column) -> Column:
    """value in nanomolar; null for other units and for nulls."""
    name, out = plain_unit(unit), F.lit(None).cast("double")
    for known, factor in NANOMOLAR.items():
        out = F.when(name == known, value.cast("double") * F.lit(factor)).otherwise(out)
    return out


def potency(nanomolar: Column) -> Column:
    """9 - log10: the negative decimal logarithm of a molar value. Null for values that are not positive."""
    return F.lit(9.0) - F.log10(nanomolar)


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]*>", ""))


def strip_short(text: Column, least: int = 3) -> Column:
    """Texts without tags; those of fewer than least characters become empty."""
    plain = strip_tags(text)
    return F.when(F.length(plain) < least, F.lit("")).otherwise(plain)


def lenient_number(text: Column) -> Column:
    """Digits with signs and points as a double, anything else (exponents too) null."""
    return F.when(F.regexp_like(text, F.lit(r"^[0-9.\-]+$")), text.try_cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def null_to_nan(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(float("nan")))


def nan_or_null_to_zero(value: Column) -> Column:
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    """value within [low, high]; null stays null, NaN becomes high."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))
