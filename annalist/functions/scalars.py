"""Scalar functions over the text and numbers of snapshots, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: days before each month of a year without leap days.
MONTH_STARTS = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]


def date_parts(stamp: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of ``Y.M.D``, null where malformed."""
    return tuple(F.regexp_extract(stamp, r"^(\d{1,4})\.(\d{1,2})\.(\d{1,2})$", i).try_cast("int") for i in (1, 2, 3))


def year_fraction(stamp: Column) -> Column:
    """y + (m - 1) / 12 + (d - 1) / 365 of ``Y.M.D``; 0 where malformed."""
    y, m, d = date_parts(stamp)
    return F.coalesce(y + (m - 1) / F.lit(12.0) + (d - 1) / F.lit(365.0), F.lit(0.0))


def month_shift(stamp: Column, back: Column) -> Column:
    """The first of the month ``back`` months before a ``Y.M.D``."""
    y, m, _ = date_parts(stamp)
    months = y * 12 + (m - 1) - back
    return F.concat_ws(".", F.floor(months / 12).cast("string"), (F.pmod(months, F.lit(12)) + 1).cast("string"), F.lit("1"))


def game_days(stamp: Column) -> Column:
    """Days since year 0 in a calendar without leap years."""
    y, m, d = date_parts(stamp)
    return y * 365 + F.element_at(F.array(*map(F.lit, MONTH_STARTS)), m) + d - 1


def year_of(stamp: Column) -> Column:
    return F.substring_index(stamp, ".", 1)


def whole_number(text: Column) -> Column:
    """An int by truncating the number in text; 0 for what is none or not finite."""
    v = text.try_cast("double")
    return F.coalesce(F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v.cast("long")), F.lit(0).cast("long"))


def losses(n: Column) -> Column:
    """Casualties in people where a counter of thousands went over 32 bits."""
    return F.when(n < 0, n + 4294967).otherwise(n)


def half_even(x: Column, digits: int) -> Column:
    """x to so many decimals (0 to 15), where a double's exact binary value decides and only true ties go to the even digit.

    F.round() and F.bround() decide by a double's shortest decimal: 2.675 is a tie there, but lies below one. Here twice
    the scaled value is an exact sum of two doubles, its product and that product's error, which is held against the
    odd number between the two candidates. Null, NaN and infinite stay; so does what has no such digits left.
    """
    x = x.cast("double")
    scale, split = 2.0 * 10.0**digits, 134217729.0  # 2^27 + 1 halves a double's bits
    a = F.abs(x)
    p = a * F.lit(scale)
    c, d = a * F.lit(split), scale * split
    a_high, s_high = c - (c - a), d - (d - scale)
    a_low, s_low = a - a_high, scale - s_high
    error = a_low * F.lit(s_low) - (((p - a_high * F.lit(s_high)) - a_low * F.lit(s_high)) - a_high * F.lit(s_low))
    low = F.floor(p / 2)
    over = (p - (low * 2 + 1)) + error
    whole = low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), F.lit(1)).otherwise(F.lit(0))
    out = whole.cast("double") / F.lit(scale / 2)
    return F.when(F.isnan(x) | (p >= F.lit(2.0**53)) | x.isNull(), x).otherwise(F.when(x < 0, -out).otherwise(out))


def clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def hull_power(gun: Column, hull: Column, evasion: Column, torpedo: Column, heavy: Column) -> Column:
    """gun * hull / (1 - evasion), a torpedo's attack added to the gun against heavy hulls."""
    return (gun + F.when(heavy, torpedo).otherwise(F.lit(0.0))) * hull / (1 - evasion)


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def is_tag(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Z][A-Z0-9]{2}$"), F.lit(False))


def titled(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def compact_count(n: Column) -> Column:
    """1,234 as 1.2k, and so on for millions and billions."""
    out = F.when(n < 1000, n.cast("string"))
    for size, mark in ((1_000, "k"), (1_000_000, "m"), (1_000_000_000, "bn")):
        out = out.when(n < size * 1000, F.concat(F.format_number(n / size, 1), F.lit(mark)))
    return out.otherwise(F.concat(F.format_number(n / 1_000_000_000, 1), F.lit("bn")))


def unsold_percent(supply: Column, sold: Column) -> Column:
    """What of a supply was not sold, in percent, at least 0; null without a supply."""
    return F.when(supply > 0, F.greatest(F.lit(0.0), (supply - sold) / supply * 100))
