"""Values at ranks by descent: several columns, groups and ranks in one histogram pass a level.

The rows are a projection that can be read again at little cost (``plans.materialize.once``).  The first
pass takes count, minimum and maximum of every column and group.  Each further pass parts every interval that holds a
wanted rank, counts the parts, and goes on with the extremes of the part that holds the rank; it ends where
smallest and largest are equal.  The first pass over doubles parts a logarithmic scale, the next ones a linear one; a part never
holds both ends of its interval, so the descent ends on any data, however
crowded.  Nothing is sorted, a tie of any size is one count, and a task holds counts only.

An interval has ``MOST_PARTS`` parts, fewer if there are many intervals: a pass brings about ``COUNTS`` counts to the driver, which
adds them up.  Its bound is ``MAX_GROUPS`` groups (more is an error) x columns x ranks x ``LEAST_PARTS``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.materialize import local_rows

MOST_PARTS, LEAST_PARTS, COUNTS = 1 << 12, 1 << 5, 1 << 16
MAX_GROUPS = 4096

#: (group, column, non-null rows) -> wanted 1-based ascending ranks by name.
RanksOf = Callable[[tuple, str, int], dict[str, int]]


@dataclass
class Found:
    """Of one group and column: its non-null rows, and by name the value at each rank and how many are smaller."""

    n: int
    value: dict[str, float | int] = field(default_factory=dict)
    before: dict[str, int] = field(default_factory=dict)


@dataclass
class _Open:
    group: tuple
    column: str
    name: str
    rank: int
    low: float | int
    high: float | int
    before: int = 0


def _spread(x: str) -> str:
    """Monotone and logarithmic over all doubles: 0 at 0, 2 at the smallest positive one, infinity a step above the largest."""
    return (f"coalesce(signum({x}) * (log2(least(abs({x}), 1.7e308D)) + 1076D "
            f"+ if(abs({x}) = double('infinity'), 1D, 0D)), 0D)")


def _part(whole: bool, parts: int) -> Column:
    """Part of ``x`` between ``low`` and ``high``, 0 to ``parts`` - 1; monotone, the ends never share a part on the linear scale."""
    if whole:
        x, low, high = (f"cast({c} AS decimal(20,0))" for c in ("x", "low", "high"))
        share = f"double({x} - {low}) / double({high} - {low})"
    else:
        width = f"nullif({_spread('high')} - {_spread('low')}, 0D)"
        share = f"if(log, ({_spread('x')} - {_spread('low')}) / {width}, (x - low) / nullif(high - low, 0D))"
    return F.expr(f"int(coalesce(least(floor(({share}) * {parts}), {parts - 1}), 0))")


def select_values(rows: DataFrame, columns: Sequence[str], ranks_of: RanksOf,
                  group_cols: Sequence[str] | str | None = None) -> dict[tuple[tuple, str], Found]:
    """For each group (a tuple, () without ``group_cols``; null is a group) and column the values at the wanted ranks.

    Nulls and NaN are ignored; a rank outside 1..n has no value.  Columns of whole numbers stay whole."""
    spark = rows.sparkSession
    group = [group_cols] if isinstance(group_cols, str) else list(group_cols or [])
    whole = all(isinstance(rows.schema[c].dataType, T.IntegralType) for c in columns)
    kind = "long" if whole else "double"

    def number(c: str):
        x = F.col(c).cast(kind)
        return x if whole else F.nanvl(x, F.lit(None).cast("double"))

    rows = rows.select(*(F.col(g).alias(f"g{i}") for i, g in enumerate(group)), *(number(c).alias(f"c{i}") for i, c in enumerate(columns)))
    keys = [f"g{i}" for i in range(len(group))]
    stats = rows.groupBy(*keys).agg(*(f(f"c{i}").alias(f"{n}{i}") for i in range(len(columns))
                                      for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))))
    out, todo = {}, []
    for r in stats.limit(MAX_GROUPS + 1).collect():
        g = tuple(r[k] for k in keys)
        for i, c in enumerate(columns):
            out[g, c] = Found(r[f"n{i}"])
            todo += [_Open(g, c, name, int(k), r[f"lo{i}"], r[f"hi{i}"]) for name, k in ranks_of(g, c, r[f"n{i}"]).items()
                     if 1 <= k <= r[f"n{i}"]]
    if len(out) > MAX_GROUPS * len(columns):
        raise ValueError(f"more than {MAX_GROUPS} groups")
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("x")) for i in range(len(columns)))))
    stacked = rows.select(*keys, cells.alias("cell")).select(*keys, "cell.c", "cell.x")
    types = [*(T.StructField(k, rows.schema[k].dataType) for k in keys), T.StructField("c", T.IntegerType()),
             *(T.StructField(n, T.LongType() if whole else T.DoubleType()) for n in ("low", "high")),
             T.StructField("log", T.BooleanType()), T.StructField("i", T.IntegerType())]
    level = 0
    while True:
        for t in (t for t in todo if t.low == t.high):
            out[t.group, t.column].value[t.name], out[t.group, t.column].before[t.name] = t.low, t.before
        todo = [t for t in todo if t.low != t.high]
        if not todo:
            return out
        index: dict[tuple, int] = {}
        of = [index.setdefault((t.group, t.column, t.low, t.high), len(index)) for t in todo]
        lines = [(*g, columns.index(c), low, high, level == 0 or not math.isfinite(float(high) - float(low)), i)
                 for (g, c, low, high), i in index.items()]
        here = local_rows(spark, lines, T.StructType(types))
        on = (stacked["c"] == here["c"]) & stacked["x"].between(here["low"], here["high"])
        for k in keys:
            on &= stacked[k].eqNullSafe(here[k])
        near = stacked.join(F.broadcast(here), on)  # a row a wanted rank at most
        parts = max(LEAST_PARTS, min(MOST_PARTS, COUNTS // len(index)))
        counts = near.groupBy("i", _part(whole, parts).alias("part")).agg(F.expr("count(1) AS n"), F.expr("min(x) AS lo"), F.expr("max(x) AS hi"))
        found: dict[int, list] = {}
        for r in sorted(counts.collect()):
            found.setdefault(r[0], []).append(r)
        for t, i in zip(todo, of):
            rank = t.rank - t.before
            for _, _, n, lo, hi in found[i]:
                if rank <= n:
                    t.low, t.high = lo, hi
                    break
                rank -= n
                t.before += n
        level += 1


def quantiles(rows: DataFrame, columns: Sequence[str], probs: Sequence[float],
              group_cols: Sequence[str] | str | None = None) -> dict[tuple[tuple, str], list[float | None]]:
    """Exact quantiles with linear interpolation between ranks (NumPy's default rule); None where there is no value."""
    def ranks(_group, _column, n):
        at = [(n - 1) * float(p) for p in probs]
        return {f"{side}{i}": int(f(p)) + 1 for i, p in enumerate(at) for side, f in (("lo", math.floor), ("hi", math.ceil))}

    out = {}
    for key, found in select_values(rows, columns, ranks, group_cols).items():
        vals = []
        for i, p in enumerate(probs):
            if not found.n:
                vals.append(None)
                continue
            pos = (found.n - 1) * float(p)
            lo, hi = float(found.value[f"lo{i}"]), float(found.value[f"hi{i}"])
            vals.append(lo + (hi - lo) * (pos - math.floor(pos)))
        out[key] = vals
    return out


def rows_at_ranks(rows: DataFrame, value: str, id_col: str, ranks_of: Callable[[int], dict[str, int]]) -> dict[str, tuple]:
    """name -> (value, id): the row at each rank of the order by ``value``, then ``id_col`` (whole numbers)."""
    found = select_values(rows, [value], lambda g, c, n: ranks_of(n)).get(((), value))
    if found is None or not found.value:
        return {}
    asked = ranks_of(found.n)
    tied = rows.where(F.col(value).isin(sorted(set(found.value.values())))).select(F.col(value).cast("double").alias("v"), id_col)
    rest = {name: (float(v), asked[name] - found.before[name]) for name, v in found.value.items()}
    ids = select_values(tied, [id_col], lambda g, c, n: {name: k for name, (v, k) in rest.items() if v == g[0]}, "v")
    return {name: (v, ids[(v,), id_col].value[name]) for name, (v, _) in rest.items()}
