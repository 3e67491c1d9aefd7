"""Scalar column expressions.

All of them are compositions of built-in functions, so they stay inside
whole-stage code generation.

Number policy (one rule everywhere, mirrored by the SQL oracles):

* money stays ``decimal(18,2)``; every SUM of money is cast back to it;
* counts stay ``bigint``;
* ratios, averages and percentages are taken in DOUBLE from *exact* sums and
  counts, and rounded last with :func:`round_half` (``round(x * 10^d) / 10^d``).
  Rounding to an integer is half-away-from-zero in every engine, so this
  gives the same digits in Spark and in the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x) -> Column:
    """Cast to the money type ``decimal(18,2)``."""
    return _c(x).cast(MONEY)


def round_half(x, digits: int = 2) -> Column:
    """Round a DOUBLE to ``digits`` places, ties away from zero."""
    scale = float(10 ** digits)
    # "+ 0.0" turns a negative zero into +0.0 (IEEE), so -0.001 rounds to 0.0 everywhere
    return F.round(_c(x).cast("double") * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def ratio(num, den, digits: int | None = 2) -> Column:
    """``num / NULLIF(den, 0)`` in DOUBLE, optionally rounded."""
    value = _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))
    return value if digits is None else round_half(value, digits)


def pct(num, den, digits: int | None = 2) -> Column:
    """``100 * num / NULLIF(den, 0)`` in DOUBLE, optionally rounded."""
    value = F.lit(100.0) * _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))
    return value if digits is None else round_half(value, digits)


def avg_of(total, count, digits: int | None = 2) -> Column:
    """Average from an exact total and a count (decomposable AVG)."""
    return ratio(total, count, digits)


def percentile_from_histogram(values: list, counts: list, p: float) -> Column:
    """PERCENTILE_CONT(p) of a multiset given as ``counts[k]`` copies of ``values[k]`` (ascending).

    Linear interpolation between the order statistics at floor/ceil of
    ``p * (n - 1)``, as the SQL aggregate does; NULL when the multiset is empty.
    """
    cnt = [_c(c) for c in counts]
    n = sum(cnt[1:], cnt[0])
    h = (n - F.lit(1)).cast("double") * F.lit(float(p))
    lo, hi = F.floor(h), F.ceil(h)

    def value_at(pos: Column) -> Column:
        expr, cum = None, None
        for v, c in zip(values[:-1], cnt[:-1]):
            cum = c if cum is None else cum + c
            expr = (F.when(pos < cum, F.lit(v)) if expr is None
                    else expr.when(pos < cum, F.lit(v)))
        last = F.lit(values[-1])
        return last if expr is None else expr.otherwise(last)

    v_lo, v_hi = value_at(lo).cast("double"), value_at(hi).cast("double")
    return F.when(n > 0, v_lo + (h - lo) * (v_hi - v_lo))


def nullif_blank(x, trim: bool = True) -> Column:
    """``NULLIF(TRIM(x), '')``: empty strings become NULL before a cast."""
    col = F.trim(_c(x)) if trim else _c(x)
    return F.nullif(col, F.lit(""))


def pg_initcap(x) -> Column:
    """PostgreSQL INITCAP: lower everything, upper the first letter of each word.

    A word starts after any character that is not a letter or digit (Spark's
    own ``initcap`` only starts words after white space). Implemented by
    splitting after every non-alphanumeric character and upper-casing the
    first character of each piece.
    """
    lowered = F.lower(_c(x))
    parts = F.split(lowered, r"(?<=[^\p{L}\p{N}])")
    capped = F.transform(
        parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.when(lowered.isNull(), F.lit(None).cast("string")).otherwise(F.array_join(capped, ""))


def pg_concat_ws(sep: str, *cols) -> Column:
    """PostgreSQL CONCAT(a, sep, b, ...): NULL arguments are skipped, never NULL."""
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])


def date_days_between(end, start) -> Column:
    """``end::date - start::date`` as an integer count of calendar days."""
    return F.datediff(_c(end).cast("date"), _c(start).cast("date"))


def extract_days_between(end, start) -> Column:
    """``EXTRACT(DAY FROM end - start)``: whole days of the interval, toward zero."""
    return F.extract(F.lit("DAY"), _c(end) - _c(start))


def micros_between(end, start) -> Column:
    """``end - start`` in whole microseconds (no time zone involved for TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def epoch_days_between(end, start) -> Column:
    """``EXTRACT(EPOCH FROM end - start) / 86400``: fractional days (DOUBLE)."""
    return micros_between(end, start).cast("double") / F.lit(86400000000.0)
