"""Tutorial analytics over the profile.

Pure functions ``profile -> DataFrame``; the reference mutates one pandas
frame in place, here each question returns its own frame.  Exact order
statistics (quartiles, medians, quintile edges, values at ranks) descend by histograms
(``functions.selection``) over the needed columns, which are written once; running sums go over one sorted table.
No task ever holds a whole column or group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import first_match, money_round, pd_round, safe_div, scalar_fields
from ..functions.ranking import percentiles, quantile_bin
from ..functions.selection import quantiles, rows_at_ranks, select_values
from ..plans.materialize import local_rows, once, sorted_once

_CID = "customer_id"

# The three columns the reference describes.
DESCRIBE_COLUMNS = ["total_spent", "purchase_frequency", "engagement_score"]
# Spending category thresholds and labels (first match wins).
SPENDING_RULES = [(200000, "Premium"), (100000, "Gold"), (50000, "Silver")]
SPENDING_DEFAULT = "Bronze"
# Tenure bands in months, right-closed: (0,3] (3,6] (6,12] (12,24] (24,100].
TENURE_EDGES = [0, 3, 6, 12, 24, 100]


def shape_and_columns(P: DataFrame) -> DataFrame:
    """Number of rows and columns."""
    return P.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(P.columns)).cast("long").alias("columns"))


def _row(spark, values: dict) -> DataFrame:
    """One row of doubles that the driver knows."""
    return spark.range(1).select(*(F.lit(v).cast("double").alias(c) for c, v in values.items()))


def describe(P: DataFrame, cols: Sequence[str] = DESCRIBE_COLUMNS, approx: bool = False) -> DataFrame:
    """Count, mean, std (n-1), min, 25%, 50%, 75%, max per column
    (pandas ``describe``); quartiles are exact (linear interpolation).

    The columns are written once; one aggregation and one descent serve all of them."""
    probs = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    rows = once(P.select(*(F.col(c).cast("double").alias(c) for c in cols)), "describe")
    aggs = {"count": lambda x: F.count(x).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = rows.agg(*(f(F.col(c)).alias(f"{s} {c}") for s, f in aggs.items() for c in cols)).first()
    stats = {s: [row[f"{s} {c}"] for c in cols] for s in aggs}
    if approx:
        q = rows.agg(*(F.percentile_approx(F.col(c), list(probs.values()), 10000).alias(c) for c in cols)).first()
        found = {((), c): list(q[c] or [None] * len(probs)) for c in cols}
    else:
        found = quantiles(rows, cols, list(probs.values()))
    stats |= {s: [found[(), c][i] for c in cols] for i, s in enumerate(probs)}
    order = ["count", "mean", "std", "min", *probs, "max"]
    schema = T.StructType([T.StructField("statistic", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in cols)])
    return local_rows(P.sparkSession, [(s, *stats[s]) for s in order], schema)


def value_counts(P: DataFrame, col: str) -> DataFrame:
    """Counts per value, descending, nulls dropped (ties by value)."""
    return (P.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), col))


def high_value(P: DataFrame, min_spent: float = 100000, n: int | None = None) -> DataFrame:
    """Customers spending more than ``min_spent`` (profile order);
    ``n`` keeps the first n rows as the reference prints ``head()``."""
    out = (P.where(F.col("total_spent") > min_spent).orderBy(_CID)
           .select("customer_name", "total_spent", "churn_risk"))
    return out.limit(n) if n else out


def segment_summary(P: DataFrame, approx: bool = False) -> DataFrame:
    """Count, sum, mean and exact median of spend per segment."""
    rows = once(P.select("customer_segment", _CID, "total_spent"), "segment-spend")
    agg = rows.groupBy("customer_segment").agg(
        F.count(_CID).alias("customer_id_count"),
        pd_round(F.sum("total_spent"), 2).alias("total_spent_sum"),
        pd_round(F.avg("total_spent"), 2).alias("total_spent_mean"))
    if approx:
        med = percentiles(rows, "total_spent", [0.5], "customer_segment", ["m"], approx)
    else:
        found = quantiles(rows, ["total_spent"], [0.5], "customer_segment")
        med = local_rows(P.sparkSession, [(*g, m) for (g, _), (m,) in found.items()],
                                             T.StructType([rows.schema["customer_segment"], T.StructField("m", T.DoubleType())]))
    med = med.select(F.col("customer_segment").alias("__s"), money_round("m", half_even=True).alias("total_spent_median"))
    return (agg.join(med, agg["customer_segment"].eqNullSafe(med["__s"]), "left").drop("__s")
            .orderBy("customer_segment"))


def segment_by_churn_pivot(P: DataFrame, levels: Sequence[str] = ("Critical", "High", "Low", "Medium")
                           ) -> DataFrame:
    """Spend summed by segment (rows) x churn level (columns); absent -> null.
    A fixed level list avoids the extra job that discovers pivot values."""
    return (P.groupBy("customer_segment").pivot("churn_risk", list(levels)).agg(F.sum("total_spent"))
            .orderBy("customer_segment"))


def top_by_clv(P: DataFrame, k: int = 10) -> DataFrame:
    """K largest CLV estimates (nulls skipped, ties by customer id)."""
    return (P.where(F.col("clv_estimate").isNotNull()).orderBy(F.desc("clv_estimate"), _CID).limit(k)
            .select("customer_name", "total_spent", "clv_estimate"))


def spend_percentiles(P: DataFrame, approx: bool = False) -> DataFrame:
    """25th, 50th and 75th percentile of spend (NumPy linear rule)."""
    names, probs = ["p25", "p50", "p75"], [0.25, 0.5, 0.75]
    if approx:
        return percentiles(P, "total_spent", probs, names=names, approx=True)
    found = quantiles(once(P.select("total_spent"), "spend"), ["total_spent"], probs)
    return _row(P.sparkSession, dict(zip(names, found[(), "total_spent"])))


def spending_category_col():
    spent = F.col("total_spent")
    return first_match([(spent > t, label) for t, label in SPENDING_RULES], SPENDING_DEFAULT)


def spending_categories(P: DataFrame) -> DataFrame:
    """Premium / Gold / Silver / Bronze counts."""
    return value_counts(P.select(spending_category_col().alias("spending_category")), "spending_category")


def segment_gap(P: DataFrame, a: str = "Loyal", b: str = "At-Risk") -> DataFrame:
    """A10: mean spend of segment ``a``, of segment ``b``, and the difference."""
    seg = F.col("customer_segment")
    return P.agg(F.avg(F.when(seg == a, F.col("total_spent"))).alias("mean_a"),
                 F.avg(F.when(seg == b, F.col("total_spent"))).alias("mean_b")) \
        .select(F.lit(a).alias("segment_a"), F.lit(b).alias("segment_b"), "mean_a", "mean_b",
                (F.col("mean_a") - F.col("mean_b")).alias("difference"))


def rfm_quintiles(P: DataFrame, approx: bool = False) -> DataFrame:
    """R, F, M quintile scores and the concatenated RFM score.

    R and M: bins between the exact quantiles at 0, .2, ..., 1 (right-closed,
    lowest edge included); R labels run 5..1.  F: quintiles of the
    frequency *rank* (ties by customer id).  Its edges are the ranks 1 + (n-1)k/5,
    so a customer is past an edge when it follows the row at that rank, rounded down, in the
    order by frequency and id: four rows are selected and no customer is
    ranked.  Repeated edges merge bins and keep the lowest label; null input
    gives a null score.  ``approx=True`` takes the R and M edges from ``percentile_approx``.
    """
    probs = [0.2, 0.4, 0.6, 0.8]
    days, spent, freq = "days_since_last_purchase", "total_spent", "purchase_frequency"
    rows = once(P.select(_CID, "customer_name", days, spent, freq), "rfm")
    if approx:
        q = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), probs, 10000).alias(c) for c in (days, spent))).first()
        edges = {((), c): list(q[c] or [None] * 4) for c in (days, spent)}
    else:
        edges = quantiles(rows, [days, spent], probs)
    r_bin, m_bin = (quantile_bin(F.col(c), [F.lit(e).cast("double") for e in edges[(), c]]) for c in (days, spent))
    at = rows_at_ranks(rows, freq, _CID, lambda n: {f"f{i}": (n - 1) * i // 5 + 1 for i in range(1, 5)})
    past = [(F.col(freq) > F.lit(v)) | ((F.col(freq) == F.lit(v)) & (F.col(_CID) > F.lit(i))) for v, i in at.values()]
    f_bin = F.when(F.col(freq).isNull(), None).otherwise(sum((p.cast("int") for p in past), F.lit(1)))
    scored = rows.select(
        "customer_name", (6 - r_bin).cast("int").alias("R_score"), f_bin.cast("int").alias("F_score"),
                      m_bin.cast("int").alias("M_score"))
    return scored.withColumn("RFM_Score", F.concat(F.col("R_score").cast("string"), F.col("F_score").cast("string"),
                                                   F.col("M_score").cast("string")))


def _health(P: DataFrame) -> DataFrame:
    """(customer_id, customer_name, health_score)."""
    maxima = scalar_fields(P.agg(F.max("days_since_last_purchase").alias("d"),
                                 F.max("purchase_frequency").alias("f")), ["d", "f"])
    max_d, max_f = maxima["d"], maxima["f"]
    score = (F.col("engagement_score") / 100 * 0.3
             + (1 - safe_div(F.col("days_since_last_purchase"), max_d) * 0.4)
             + safe_div(F.col("purchase_frequency"), max_f) * 0.3) * 100
    return P.select(_CID, "customer_name", pd_round(score, 2).alias("health_score"))


def health_scores(P: DataFrame) -> DataFrame:
    """Health score, with the reference's precedence:
    (eng/100*0.3 + (1 - d/max_d*0.4) + f/max_f*0.3) * 100, rounded half-even."""
    return _health(P).orderBy(_CID).select("customer_name", "health_score")


def top_health(P: DataFrame, k: int = 10) -> DataFrame:
    """A12 report: the k healthiest customers (ties by customer id)."""
    return (_health(P).where(F.col("health_score").isNotNull())
            .orderBy(F.desc("health_score"), _CID).limit(k).select("customer_name", "health_score"))


def churn_signals(P: DataFrame, n: int | None = None) -> DataFrame:
    """Inactive > 60 days, engagement < 50 and frequency < 1."""
    out = (P.where((F.col("days_since_last_purchase") > 60) & (F.col("engagement_score") < 50)
                   & (F.col("purchase_frequency") < 1))
           .orderBy(_CID)
           .select("customer_name", "total_spent", "days_since_last_purchase", "engagement_score"))
    return out.limit(n) if n else out


def pareto(P: DataFrame) -> DataFrame:
    """Customers by spend (desc, then id) with running revenue and its
    percentage of the total.

    A distributed prefix sum: the rows go through one range exchange (sampled borders include the id, so a heavy
    tie is split) and are written sorted; the sum of each part, one row a part, gives the parts' offsets;
    the running sum within a part is a window over the written table, which is bucketed by part and not shuffled."""
    rows = sorted_once(P.withColumn("__spend", F.col("total_spent").cast("double")), "pareto", F.desc_nulls_last("__spend"), F.col(_CID))
    ends = {r["__part"]: r["s"] for r in rows.groupBy("__part").agg(F.sum("__spend").alias("s")).collect()}  # a row a part
    offsets, total = {}, None
    for part in sorted(ends):
        offsets[part] = total
        total = ends[part] if total is None else total + (ends[part] or 0.0)
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lit(None).cast("double")
    if known := {k: v for k, v in offsets.items() if v is not None}:
        before = F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.col("__part"))
    mine = F.sum("__spend").over(inside)
    running = F.when(before.isNull(), mine).otherwise(before + F.coalesce(mine, F.lit(0.0)))
    return (rows.withColumn("cumulative_revenue", running).orderBy("__at")
            .select(*P.columns, "cumulative_revenue",
                    (F.lit(100.0) * safe_div(F.col("cumulative_revenue"), F.lit(total).cast("double"))).alias("cumulative_pct")))


def top_share(P: DataFrame, share: float = 0.2) -> DataFrame:
    """Percentage of revenue from the top int(share * n) customers.

    The k-th largest spend v* comes from a descent (no sort); the
    top-k revenue is then exactly ``sum(x > v*) + (k - count(x > v*)) * v*``,
    whichever of the customers tied at v* the reference's sort kept.
    """
    rows = once(P.select(F.col("total_spent").cast("double").alias("x")), "spend")
    n = rows.count()
    k = int(n * share)
    # k-th largest = ascending rank m - k + 1 among the m non-null spends
    found = select_values(rows, ["x"], lambda g, c, m: {"v": m - k + 1})[(), "x"]
    v = found.value.get("v")
    x = F.col("x")
    above = rows.agg(F.sum("x").alias("total"), *([F.sum(F.when(x > v, x)).alias("s"), F.count_if(x > v).alias("c")] if v is not None else []))
    if k <= 0:
        top = F.lit(0.0)
    elif v is None:  # k exceeds the non-null spends
        top = F.coalesce(F.col("total"), F.lit(0.0))
    else:
        top = F.coalesce(F.col("s"), F.lit(0.0)) + (F.lit(k) - F.col("c")).cast("double") * v
    return above.select(F.lit(k).cast("long").alias("top_customers"), top.alias("top_revenue"),
                        (F.lit(100.0) * safe_div(top, F.col("total"))).alias("top_revenue_pct"))


def channel_roi(P: DataFrame) -> DataFrame:
    """Per channel count, spend sum/mean, engagement mean, Critical count."""
    return (P.groupBy("acquisition_channel").agg(
        F.count(_CID).alias("customer_id_count"),
        pd_round(F.sum("total_spent"), 2).alias("total_spent_sum"),
        pd_round(F.avg("total_spent"), 2).alias("total_spent_mean"),
        pd_round(F.avg("engagement_score"), 2).alias("engagement_score_mean"),
        F.count_if(F.col("churn_risk") == "Critical").alias("churn_risk_critical"))
        .orderBy("acquisition_channel"))


def tenure_band_col(col: str = "tenure_months"):
    """Right-closed bands like ``pd.cut``; values outside (0, 100] -> null."""
    t = F.col(col)
    expr = None
    for lo, hi in zip(TENURE_EDGES[:-1], TENURE_EDGES[1:]):
        cond = (t > lo) & (t <= hi)
        label = f"({lo}, {hi}]"
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def tenure_band_index(col: str = "tenure_months"):
    t = F.col(col)
    expr = None
    for idx, (lo, hi) in enumerate(zip(TENURE_EDGES[:-1], TENURE_EDGES[1:])):
        cond = (t > lo) & (t <= hi)
        expr = F.when(cond, idx) if expr is None else expr.when(cond, idx)
    return expr


def retention_by_tenure(P: DataFrame) -> DataFrame:
    """Per tenure band: customers, mean spend, % Critical (bands seen only)."""
    banded = P.select(tenure_band_col().alias("tenure_band"), tenure_band_index().alias("band_index"),
                      _CID, "total_spent", "churn_risk").where(F.col("tenure_band").isNotNull())
    rows = F.count(F.lit(1))
    return (banded.groupBy("band_index", "tenure_band").agg(
        F.count(_CID).alias("customers"),
        pd_round(F.avg("total_spent"), 2).alias("avg_spent"),
        pd_round(F.count_if(F.col("churn_risk") == "Critical") / rows * 100, 2).alias("critical_risk_pct"))
        .orderBy("band_index").drop("band_index"))
