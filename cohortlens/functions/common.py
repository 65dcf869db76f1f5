"""Small Column builders shared by all operators (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den) -> Column:
    """num / den, null when den is 0 or null (ANSI mode would raise)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num, den, dp: int | None = None) -> Column:
    """100 * num / den, optionally rounded half-up to ``dp`` places."""
    v = safe_div(num, den) * 100.0
    return F.round(v, dp) if dp is not None else v


def floor_days(later, earlier) -> Column:
    """Whole days between two timestamps, floored (pandas ``Timedelta.days``).

    Negative when ``later`` precedes ``earlier``; unlike ``datediff`` it does
    not count calendar-day boundaries.
    """
    # timestamp_diff on wall-clock (timestamp_ntz) values: independent of the
    # session time zone and of DST changes, like naive pandas timestamps.
    micros = F.timestamp_diff("MICROSECOND", _c(earlier).cast("timestamp_ntz"), _c(later).cast("timestamp_ntz"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def exact_sum(x) -> Column:
    """Sum of money, hours and other decimal data held as doubles.

    Summed as decimals (six places), so the result does not depend on the
    order of the partial sums and a value that sits on a half stays there.
    """
    return F.sum(_c(x).cast("decimal(28,6)"))


def exact_avg(x) -> Column:
    """``exact_sum`` over the number of non-null values, as a double."""
    return safe_div(exact_sum(x), F.count(_c(x)))


def _rounded(rounding, x, dp: int) -> Column:
    # A double is rounded by its shortest decimal form; beyond 10^26 it has no
    # decimal places left to round.
    x = _c(x)
    exact = rounding(x.try_cast("decimal(38,12)"), dp).cast("double")
    return F.coalesce(exact, x.cast("double"))


def round_half_up(x, dp: int) -> Column:
    """SQL ``ROUND(x::numeric, dp)``: half away from zero, result double."""
    return _rounded(F.round, x, dp)


def round_half_even(x, dp: int) -> Column:
    """pandas ``Series.round(dp)``: banker's rounding, result double."""
    return _rounded(F.bround, x, dp)
