"""Chart datasets (C1-C10): the data behind each dashboard chart.

The reference draws these with matplotlib; drawing is a single-machine
concern, so each chart is re-aimed as the (small) frame a plotting tool
would read.  Histograms follow matplotlib/NumPy binning: equal-width bins
between the data's min and max, the last bin closed, all-equal data
spread over (x-0.5, x+0.5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import safe_div, scalar_fields
from ..functions.ranking import percentiles
from ..functions.selection import quantiles
from ..plans.checks import bounded
from ..plans.materialize import local_rows, once
from .segments import value_counts

_CID = "customer_id"
#: Segments of a box plot at most: their quartiles are broadcast.
MAX_SEGMENTS = 100_000


def customers_by_segment(P: DataFrame) -> DataFrame:
    """Bar chart of customers per segment."""
    return value_counts(P, "customer_segment")


def churn_distribution(P: DataFrame) -> DataFrame:
    """Pie chart of churn levels with percentage share."""
    counts = value_counts(P, "churn_risk")
    total = P.where(F.col("churn_risk").isNotNull()).select(F.count(F.lit(1))).scalar()
    return counts.withColumn("share_pct", F.lit(100.0) * safe_div(F.col("count"), total))


def value_segment_counts(P: DataFrame) -> DataFrame:
    """Bar chart of value segments."""
    return value_counts(P, "value_segment")


def spend_frequency_points(P: DataFrame) -> DataFrame:
    """C4: scatter points (frequency, spend) coloured by engagement — every customer."""
    return P.select(_CID, "purchase_frequency", "total_spent", "engagement_score")


def spend_frequency_grid(P: DataFrame, max_customers: int = 10_000, depth: int = 8) -> DataFrame:
    """C4 at any size: an adaptive grid (quadtree) over frequency and spend with the customers and mean engagement of each cell.

    The square between the smallest and largest values is parted into four while a cell holds more than
    ``max_customers``, ``depth`` times at most; cells in (level, cell_x, cell_y) of that level's grid, with their borders, are the
    leaves that hold a customer.  The customers of all cells add up to those that have both values.  The rows are read twice: for
    the extremes and for the counts of the finest grid (4^depth cells at most); the tree is built of these counts.
    """
    if not 0 <= depth <= 10:
        raise ValueError("depth is 0 to 10")
    x, y = F.col("purchase_frequency").cast("double"), F.col("total_spent").cast("double")
    points = once(P.where(x.isNotNull() & y.isNotNull()).select(x.alias("x"), y.alias("y"), F.col("engagement_score").alias("e")), "points")
    lim = points.agg(*(f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    side = 1 << depth

    def cell(c: str):
        lo, width = F.lit(lim[f"{c}_lo"]), F.nullif(F.lit(lim[f"{c}_hi"]) - F.lit(lim[f"{c}_lo"]), F.lit(0.0))
        share = F.coalesce((F.col(c) - lo) / width, F.lit(0.0))
        return F.least(F.floor(share * side), F.lit(side - 1)).cast("int")

    finest = points.groupBy(cell("x").alias("ix"), cell("y").alias("iy")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("e").alias("s"), F.count("e").alias("m"))
    finest = once(finest, "grid").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    up = F.lit(depth) - F.col("level")
    at = [F.call_function("shiftright", F.col(c), up).alias(k) for c, k in (("ix", "cell_x"), ("iy", "cell_y"))]
    cells = finest.groupBy("level", *at).agg(F.sum("n").alias("customers"), (F.sum("s") / F.nullif(F.sum("m"), F.lit(0))).alias("engagement_mean"))
    whole = cells.where(F.col("customers") > max_customers).select(
        (F.col("level") + 1).alias("pl"), F.col("cell_x").alias("px"), F.col("cell_y").alias("py"))
    parted = ((F.col("level") == F.col("pl")) & (F.call_function("shiftright", "cell_x", F.lit(1)) == F.col("px"))
              & (F.call_function("shiftright", "cell_y", F.lit(1)) == F.col("py")))
    leaves = cells.where((F.col("customers") <= max_customers) | (F.col("level") == depth))
    leaves = leaves.where("level = 0").unionAll(leaves.join(whole, parted, "left_semi"))

    def border(c: str, k: int):
        lo, hi = F.lit(lim[f"{c}_lo"]), F.lit(lim[f"{c}_hi"])
        return lo + (hi - lo) * ((F.col(f"cell_{c}") + k) / F.pow(F.lit(2.0), F.col("level")))

    return leaves.select("level", "cell_x", "cell_y", border("x", 0).alias("frequency_from"), border("x", 1).alias("frequency_to"),
                         border("y", 0).alias("spend_from"), border("y", 1).alias("spend_to"), "customers", "engagement_mean") \
        .orderBy("level", "cell_x", "cell_y")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram with empty bins filled: (bin, bin_start, bin_end, count).

    Bin edges ``lo + i * (hi - lo) / bins`` come from a one-row min/max
    aggregate (scalar subqueries); a value belongs to the bin between whose edges it lies.
    The bin grid is generated from that one row.  The column is collapsed to (value, count) and written
    once, so the rows are computed a single time and bounds and bins read that table.
    """
    data = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    data = once(data, "values")
    bounds = data.agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    lim = scalar_fields(bounds.select(
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi")), ["lo", "hi"])
    lo_s, hi_s = lim["lo"], lim["hi"]
    width = (hi_s - lo_s) / bins
    idx = F.least(F.floor((F.col("x") - lo_s) / width), F.lit(bins - 1)).cast("int")
    # the edges decide, not the division's last bit
    idx = (F.when(F.col("x") < lo_s + idx * width, idx - 1)
           .when((idx < bins - 1) & (F.col("x") >= lo_s + (idx + 1) * width), idx + 1).otherwise(idx))
    counts = data.groupBy(idx.alias("bin")).agg(F.sum("n").alias("count"))
    grid = (bounds.where(F.col("mn").isNotNull())
            .select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")))
    return (grid.join(counts, "bin", "left")
            .select("bin", (lo_s + F.col("bin") * width).alias("bin_start"),
                    (lo_s + (F.col("bin") + 1) * width).alias("bin_end"),
                    F.coalesce("count", F.lit(0)).alias("count"))
            .orderBy("bin"))


def recency_histogram(P: DataFrame, bins: int = 30, max_days: int = 365) -> DataFrame:
    """Days since last purchase, only customers under ``max_days``."""
    return histogram(P.where(F.col("days_since_last_purchase") < max_days), "days_since_last_purchase", bins)


def engagement_by_segment(P: DataFrame) -> DataFrame:
    """Mean engagement score by segment, descending."""
    return (P.where(F.col("customer_segment").isNotNull()).groupBy("customer_segment")
            .agg(F.avg("engagement_score").alias("engagement_score_mean"))
            .orderBy(F.desc("engagement_score_mean"), "customer_segment"))


def _fenced(P: DataFrame, approx: bool) -> DataFrame:
    """Customers with a segment and a CLV estimate, and the quartiles of their segment.

    The quartiles are one row per segment; the table is checked to be
    small and broadcast, so customers are never shuffled by their segment."""
    base = P.where(F.col("clv_estimate").isNotNull() & F.col("customer_segment").isNotNull())
    base = once(base.select(_CID, "customer_segment", "clv_estimate"), "clv")
    probs, names = [0.25, 0.5, 0.75], ["q1", "median", "q3"]
    if approx:
        q = bounded(percentiles(base, "clv_estimate", probs, "customer_segment", names, approx), MAX_SEGMENTS)
    else:  # at most selection.MAX_GROUPS rows
        found = quantiles(base, ["clv_estimate"], probs, "customer_segment")
        schema = T.StructType([base.schema["customer_segment"], *(T.StructField(n, T.DoubleType()) for n in names)])
        q = local_rows(P.sparkSession, [(*g, *v) for (g, _), v in found.items()], schema)
    return base.join(F.broadcast(q), "customer_segment")


def _box(fenced: DataFrame) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    lo_fence, hi_fence = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col("clv_estimate")
    stats = fenced.groupBy("customer_segment", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(v >= lo_fence, v)).alias("whisker_low"),
        F.max(F.when(v <= hi_fence, v)).alias("whisker_high"),
        F.count_if((v < lo_fence) | (v > hi_fence)).alias("outliers"))
    return stats.select("customer_segment", "n", "q1", "median", "q3",
                        F.coalesce("whisker_low", "q1").alias("whisker_low"),
                        F.coalesce("whisker_high", "q3").alias("whisker_high"), "outliers")


def clv_box_stats(P: DataFrame, approx: bool = False) -> DataFrame:
    """Box-plot statistics of CLV per segment.

    Quartiles are exact (linear); whiskers reach the most extreme data
    points within 1.5 IQR of the box (matplotlib's rule); ``outliers``
    counts the points beyond them (``clv_outliers`` lists them).
    """
    return _box(_fenced(P, approx)).orderBy("customer_segment")


def clv_outliers(P: DataFrame, approx: bool = False) -> DataFrame:
    """C7 (points): customers whose CLV lies beyond the whiskers of their segment.

    A point is beyond a whisker exactly when it is beyond the fence, so the
    quartiles decide and no whisker is computed."""
    v, iqr = F.col("clv_estimate"), F.col("q3") - F.col("q1")
    return (_fenced(P, approx).where((v < F.col("q1") - 1.5 * iqr) | (v > F.col("q3") + 1.5 * iqr))
            .select("customer_segment", _CID, "clv_estimate").orderBy("customer_segment", _CID))


def conversion_by_channel(P: DataFrame) -> DataFrame:
    """Mean conversion rate by acquisition channel, descending."""
    return (P.where(F.col("acquisition_channel").isNotNull()).groupBy("acquisition_channel")
            .agg(F.avg("conversion_rate").alias("conversion_rate_mean"))
            .orderBy(F.desc("conversion_rate_mean"), "acquisition_channel"))


def transaction_histogram(P: DataFrame, bins: int = 20) -> DataFrame:
    """Customers by number of transactions."""
    return histogram(P, "total_transactions", bins)


def revenue_by_segment(P: DataFrame) -> DataFrame:
    """Revenue (sum of spend) by segment."""
    return (P.where(F.col("customer_segment").isNotNull()).groupBy("customer_segment")
            .agg(F.sum("total_spent").alias("total_spent_sum")).orderBy("customer_segment"))
