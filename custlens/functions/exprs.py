"""Column helpers shared by the operators.

All helpers return built-in Catalyst expressions, so they stay inside
whole-stage codegen; none of them reads the clock — the evaluation time
``as_of`` is always an argument and becomes a literal (constant-folded).

Two day-count families exist because the reference has two engines:

* SQL family (``julianday('now') - julianday(d)``): a *fractional* day
  difference; ``CAST(.. AS INTEGER)`` truncates toward zero, threshold
  tests use the uncast fraction.
* profile family (``(now - d).dt.days``): floor of the difference.

Dates are ``DateType`` (midnight), so ``as_of - d`` in days is
``datediff(as_of_date, d) + f`` with ``f`` the time-of-day fraction of
``as_of`` — a Python constant.  That keeps every rule exact and free of
time-zone arithmetic.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(as_of: datetime | date) -> tuple[date, float]:
    if isinstance(as_of, datetime):
        secs = as_of.hour * 3600 + as_of.minute * 60 + as_of.second + as_of.microsecond / 1e6
        return as_of.date(), secs / 86400.0
    return as_of, 0.0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def whole_days_since(as_of, col) -> Column:
    """Profile family: floor((as_of - d) in days); equals datediff for f < 1."""
    d, _ = _parts(as_of)
    return F.datediff(F.lit(d), _c(col))


def sql_days_since(as_of, col) -> Column:
    """SQL family: CAST(julianday(as_of) - julianday(d) AS INTEGER) (truncate toward 0)."""
    d, f = _parts(as_of)
    dd = F.datediff(F.lit(d), _c(col))
    if f == 0.0:
        return dd
    return F.when(dd < 0, dd + 1).otherwise(dd)


def fractional_days_since(as_of, col) -> Column:
    """julianday(as_of) - julianday(d) as a double (threshold tests)."""
    d, f = _parts(as_of)
    return F.datediff(F.lit(d), _c(col)).cast("double") + F.lit(f)


def within_last_days(as_of, col, days: int) -> Column:
    """``julianday(as_of) - julianday(d) <= days`` rewritten as ``d >= cutoff``.

    A bare comparison of the raw column with a date literal reaches the
    Parquet scan as a pushed filter (row-group min/max and partition
    pruning), unlike the arithmetic form.
    """
    if isinstance(as_of, datetime):
        cutoff = as_of - timedelta(days=days)
        cdate = cutoff.date() if cutoff.time() == time(0) else cutoff.date() + timedelta(days=1)
    else:
        cdate = as_of - timedelta(days=days)
    return _c(col) >= F.lit(cdate)


def safe_div(num, den) -> Column:
    """num / den, null when den is 0 or null (SQLite semantics; ANSI-safe)."""
    return _c(num) / F.nullif(_c(den), F.lit(0))


def at_least_one(col) -> Column:
    """NumPy ``maximum(x, 1)``: null stays null (Spark's greatest skips nulls)."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(1)))


def clip(col, lo: float, hi: float) -> Column:
    """NumPy ``clip``: null stays null."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def money_round(col, scale: int = 2, half_even: bool = False) -> Column:
    """A float sum or mean of money, rounded: half away from zero, or half to even.

    Sums are plain double sums, whose last bits depend on the order of summation; a
    mean of cents that is exactly a tie must not round by them.  The value
    is rounded by way of 8 decimals, which is wider than that noise and far narrower than the
    distance of other means of cents to a tie.  Beyond 1e15 a double has no cents."""
    c = _c(col).cast("double")
    d = c.cast("decimal(38,8)")
    rounded = (F.bround(d, scale) if half_even else F.round(d, scale)).cast("double")
    return F.when(F.abs(c) < 1e15, rounded).otherwise(c)


def month_start(col) -> Column:
    """First day of the month: a date to group by, formatted afterwards."""
    return F.trunc(_c(col), "month")


def month(col) -> Column:
    """strftime('%Y-%m', d)."""
    return F.date_format(_c(col), "yyyy-MM")


def sql_round(col, scale: int = 2) -> Column:
    """SQL ROUND: half away from zero."""
    return F.round(_c(col), scale)


def pd_round(col, scale: int = 2) -> Column:
    """pandas ``.round``: half to even."""
    return F.bround(_c(col), scale)


def first_match(cases: list[tuple[Column, str]], default: str | None) -> Column:
    """CASE WHEN c1 THEN v1 WHEN c2 THEN v2 ... ELSE default END / np.select."""
    expr = None
    for cond, val in cases:
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def with_scalar(df, row_df, name: str):
    """``df`` with the one row of ``row_df`` as the struct column ``name``.

    The scalar subquery stands in the plan once, however often its fields are used; expressions
    that each name a subquery multiply the plan when they are nested."""
    return df.withColumn(name, row_df.select(F.struct("*").alias("s")).scalar())


def scalar_fields(row_df, cols: list[str]) -> dict[str, Column]:
    """Columns of a one-row frame as scalar values for use in other plans.

    One struct-valued scalar subquery carries all fields, so the row is
    computed by a single job and its value is inlined as a literal in every
    task (no join, no broadcast of a frame).
    """
    s = row_df.select(F.struct(*cols).alias("s")).scalar()
    return {c: s.getField(c) for c in cols}
