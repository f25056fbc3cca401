"""Order statistics, ranks and running sums without a global sort.

One algorithm at every size.  Values fall into at most ``BUCKETS`` buckets of
equal width on a logarithmic scale between the smallest and the largest value; the
bucket is a monotone expression of the value and two scalars, so it is the
same wherever it is evaluated.  Rows are first collapsed to (value, count),
which removes ties; the counts per bucket, a table of at most
``BUCKETS`` rows a group, are summed up in order, and only inside a bucket are values sorted.

* ``select_ranks``: the value at given ranks.  Only buckets that hold a wanted rank are sorted.
* ``ordered_rank``: every row's rank and running sum.  Rows that share a value
  are ordered by id; they are split by ranges of the id (which must be
  numeric for that), so a value held by a third of all rows is no single task.

Nothing runs before the frame is used, and the plan does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import with_scalar

BUCKETS = 1 << 16
ID_RANGES = 1 << 10


def _groups(group_cols) -> list[str]:
    if group_cols is None:
        return []
    return [group_cols] if isinstance(group_cols, str) else list(group_cols)


def _spread(x: Column) -> Column:
    x = x.cast("double")
    return F.signum(x) * F.log1p(F.abs(x))


def _bucket(x: Column, low: Column, high: Column, n: int) -> Column:
    """Monotone bucket of ``x`` among ``n`` between ``low`` and ``high``; 0 if they are equal."""
    width = F.nullif(_spread(high) - _spread(low), F.lit(0.0))
    return F.coalesce(F.floor((_spread(x) - _spread(low)) / width * (n - 1)), F.lit(0)).cast("long")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        one = left[k].eqNullSafe(right[k])
        on = one if i == 0 else on & one
    return on


def select_ranks(df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]],
                 group_cols: Sequence[str] | str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (group..., n, name, rank, value, before): the value at ascending 1-based ranks, nulls ignored.

    ``ranks`` maps a name to a function of the group's row count ``n``; it may
    also use the columns ``carry``, which are constant in a group.  ``before`` counts the rows with a
    smaller value.  A rank outside 1..n gives no row.
    """
    group = _groups(group_cols)
    rows = df.where(F.col(value).isNotNull())
    rows = with_scalar(rows, rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")), "__lim")
    rows = rows.withColumn("__b", _bucket(F.col(value), F.col("__lim.lo"), F.col("__lim.hi"), BUCKETS))
    each = rows.groupBy(*group, value, "__b").agg(F.count(F.lit(1)).alias("__c"), *(F.first(c).alias(c) for c in carry))
    hist = each.groupBy(*group, "__b").agg(F.sum("__c").alias("__c"), *(F.first(c).alias(c) for c in carry))
    whole = Window.partitionBy(*group)
    prior = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(*group, "__b", "__c", *carry, F.sum("__c").over(whole).alias("n"),
                       F.coalesce(F.sum("__c").over(prior), F.lit(0)).alias("__off"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), r(F.col("n")).cast("long").alias("rank"))
                       for name, r in ranks.items()))
    hist = hist.select(*group, "__b", "n", "__off", "__c", F.explode(wanted).alias("__w"))
    hist = hist.select(*group, "__b", "n", "__off", "__c", "__w.name", "__w.rank")
    hist = hist.where((F.col("rank") > F.col("__off")) & (F.col("rank") <= F.col("__off") + F.col("__c"))).drop("__c")
    near = each.drop(*carry).alias("e")
    if not group:
        hist = F.broadcast(hist)  # one row per wanted rank
    hist = hist.alias("h")
    near = near.join(hist, _same(near, hist, [*group, "__b"])).select(
        *(F.col(f"e.{g}").alias(g) for g in group), "e.__b", "n", "__off", "name", "rank", F.col(f"e.{value}").alias(value), "__c")
    upto = Window.partitionBy(*group, "__b", "name").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("__hi", F.col("__off") + F.sum("__c").over(upto))
    near = near.where((F.col("rank") <= F.col("__hi")) & (F.col("rank") > F.col("__hi") - F.col("__c")))
    return near.select(*group, "n", "name", "rank", F.col(value).alias("value"), (F.col("__hi") - F.col("__c")).alias("before"))


def values_at_ranks(df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]],
                    group_cols: Sequence[str] | str | None = None) -> DataFrame:
    """``select_ranks`` with one row per group: the group, ``__n`` and one column per name."""
    group = _groups(group_cols)
    found = select_ranks(df, value, ranks, group)
    return found.groupBy(*group).agg(
        F.max("n").alias("__n"), *(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks))


def pairs_at_ranks(df: DataFrame, value: str, id_col: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows (name, value, id): the row at each rank of the order by value, then id."""
    found = select_ranks(df, value, ranks).select(
        F.col("name").alias("__name"), F.col("value").alias("__value"), (F.col("rank") - F.col("before")).alias("__rest"))
    tied = df.join(F.broadcast(found), df[value] == found["__value"])  # one row per wanted rank
    ids = select_ranks(tied.select("__name", "__value", "__rest", id_col), id_col, {"id": lambda n: F.col("__rest")},
                       ["__name", "__value"], ["__rest"])
    return ids.select(F.col("__name").alias("name"), F.col("__value").alias("value"), F.col("value").alias("id"))


def ordered_rank(df: DataFrame, value: str, id_col: str, descending: bool = False,
                 group_cols: Sequence[str] | str | None = None, running_sum: str | None = None,
                 rank_col: str = "row_number", sum_col: str = "running_sum") -> DataFrame:
    """Add ``rank_col`` (1-based position in the order ``value`` [desc], then ``id_col`` ascending, nulls last, within
    ``group_cols``) and, if ``running_sum`` is given, ``sum_col`` = running sum of that column in the same order
    (null while no value has been seen).  ``id_col`` must be unique within a group."""
    group = _groups(group_cols)
    v = F.col(value)
    numeric = dict(df.dtypes)[id_col] != "string"
    bounds = [F.min(value).alias("vl"), F.max(value).alias("vh")]
    bounds += [F.min(id_col).alias("il"), F.max(id_col).alias("ih")] if numeric else []
    lim = {c: F.col(f"__lim.{c}") for c in ("vl", "vh", "il", "ih")}
    bucket = _bucket(v, lim["vl"], lim["vh"], BUCKETS)
    rows = with_scalar(df, df.agg(*bounds), "__lim").withColumn("__b", F.when(v.isNull(), F.lit(BUCKETS)).otherwise(-bucket if descending else bucket))
    span = F.nullif((lim["ih"] - lim["il"]).cast("double"), F.lit(0.0)) if numeric else None
    ids = F.coalesce(F.floor((F.col(id_col) - lim["il"]) / span * (ID_RANGES - 1)), F.lit(0)) if numeric else F.lit(0)
    rows = rows.withColumn("__t", ids.cast("long"))
    total = [F.sum(running_sum).alias("__s")] if running_sum else []
    each = rows.groupBy(*group, "__b", value, "__t").agg(F.count(F.lit(1)).alias("__c"), *total)
    hist = each.groupBy(*group, "__b").agg(F.sum("__c").alias("__c"), *([F.sum("__s").alias("__s")] if running_sum else []))
    prior = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(*(F.col(c).alias(f"__h_{c}") for c in [*group, "__b"]),
                       F.coalesce(F.sum("__c").over(prior), F.lit(0)).alias("__hn"),
                       *([F.sum("__s").over(prior).alias("__hs")] if running_sum else []))
    if not group:
        hist = F.broadcast(hist)  # at most BUCKETS + 1 rows
    on = F.lit(True)
    for i, c in enumerate([*group, "__b"]):
        one = F.col(c).eqNullSafe(F.col(f"__h_{c}"))
        on = one if i == 0 else on & one
    each = each.join(hist, on)
    order = v.desc_nulls_last() if descending else v.asc_nulls_last()
    inside = Window.partitionBy(*group, "__b").orderBy(order, "__t").rowsBetween(Window.unboundedPreceding, -1)

    def plus(a: Column, b: Column) -> Column:
        return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

    each = each.select(*(F.col(c).alias(f"__k_{c}") for c in [*group, value, "__t"]),
                       plus(F.col("__hn"), F.sum("__c").over(inside)).alias("__n"),
                       *([plus(F.col("__hs"), F.sum("__s").over(inside)).alias("__p")] if running_sum else []))
    on = F.col(value).eqNullSafe(F.col(f"__k_{value}")) & (F.col("__t") == F.col("__k___t"))
    for c in group:
        on &= F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    rows = rows.join(each, on)
    tied = Window.partitionBy(*group, value, "__t").orderBy(id_col)
    out = [*(F.col(f"`{c}`") for c in df.columns), (F.col("__n") + F.row_number().over(tied)).cast("long").alias(rank_col)]
    if running_sum:
        mine = F.sum(running_sum).over(tied.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out.append(plus(F.col("__p"), mine).alias(sum_col))
    return rows.select(*out)


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float],
                      group_cols: Sequence[str] | str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation between ranks (NumPy's default rule, DuckDB ``quantile_cont``),
    one row per group; nulls ignored."""
    group = _groups(group_cols)
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])

    def at(p: float, side) -> Callable[[Column], Column]:
        return lambda n: side((n - 1) * F.lit(float(p))) + 1

    ranks = {}
    for i, p in enumerate(probs):
        ranks[f"__lo_{i}"], ranks[f"__hi_{i}"] = at(p, F.floor), at(p, F.ceil)
    picked = values_at_ranks(df, value, ranks, group)
    outs = []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{i}"), F.col(f"__hi_{i}")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).cast("double").alias(name))
    return picked.select(*group, *outs)


def percentiles(df: DataFrame, value: str, probs: Sequence[float], group_cols: Sequence[str] | str | None = None,
                names: Sequence[str] | None = None, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Exact percentiles (default) or, with ``approx=True``, ``percentile_approx`` (one pass with mergeable
    sketches; rank error about n/accuracy)."""
    group = _groups(group_cols)
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    if not approx:
        return exact_percentiles(df, value, probs, group, names)
    agg = df.groupBy(*group).agg(F.percentile_approx(F.col(value).cast("double"), list(probs), accuracy).alias("__q"))
    return agg.select(*group, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def quantile_bin(x: Column, interior_edges: Sequence[Column]) -> Column:
    """Right-closed bin of ``x`` given the interior quantile edges (the quantiles at 1/b .. (b-1)/b): 1 + number of
    edges below ``x``.  Repeated edges merge bins and keep the lowest label; null -> null."""
    count = F.lit(0)
    for e in interior_edges:
        count = count + F.when(e < x, 1).otherwise(0)
    return F.when(x.isNull(), F.lit(None)).otherwise(count + 1)
