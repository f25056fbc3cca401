"""Registered queries of the profile families (P, R, A, C).

The R and C families read the full profile; the A family (the tutorial)
reads the 15 exported columns, which is what the reference's tutorial
loads back from its CSV export.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import charts as Ch
from .operators import profile as Pr
from .operators import reports as Rp
from .operators import segments as Sg
from .plans.materialize import once
from .registry import AS_OF, _reg, _scratch
from .registry import _reg_uncut
from .sources.schemas import CSV_OPTIONS, EXPORT_COLUMNS, EXPORT_SHORT_COLUMNS, PROFILE_CSV
from .sources.sinks import ReportPack, custom_sheets, report_sheets


def _profile(C, T, E):
    return Pr.build_profile(C, T, E, AS_OF)


def _export(C, T, E):
    return _profile(C, T, E).select(*EXPORT_COLUMNS)


def _on_profile(name, fn):
    _reg(name, lambda C, T, E: fn(_profile(C, T, E)))


def _on_export(name, fn):
    _reg(name, lambda C, T, E: fn(_export(C, T, E)))


_reg("p01_extract_profile", lambda C, T, E: Pr.extract_profile(C, T, E))
_reg("p01_extract_profile_dedup", lambda C, T, E: Pr.extract_profile(C, T, E, fanout=False))
_reg_uncut("p01_extract_profile_uncut", lambda C, T, E: Pr.extract_profile(C, T, E))


def _through_csv(P, columns):
    """The exported rows as the sink's CSV text and back as the source reads it."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PROFILE_CSV.fields if f.name in columns)
    line = F.to_csv(F.struct(*columns), CSV_OPTIONS)
    return P.select(F.from_csv(line, schema, CSV_OPTIONS).alias("r")).select("r.*")


#: Sheets of the packs: the column that names a line, and its numeric columns that are compared (none: the text ``Value``).
PACKS = {
    "l07_report_pack": {
        "Customer Data": ("customer_id", ["total_spent", "total_transactions", "purchase_frequency", "engagement_score", "clv_estimate"]),
        "Segment_Analysis": ("customer_segment", ["customer_id_count", "total_spent_sum", "total_spent_mean", "purchase_frequency_mean", "engagement_score_mean"]),
        "Churn_Risk": ("churn_risk", ["customer_id_count", "total_spent_mean", "engagement_score_mean"]),
        "Value_Segment": ("value_segment", ["customer_id_count", "total_spent_sum", "total_spent_mean", "purchase_frequency_mean"]),
        "Channel": ("acquisition_channel", ["customer_id_count", "total_spent_sum", "total_spent_mean", "engagement_score_mean"]),
        "Executive Summary": ("Metric", [])},
    "l08_custom_pack": {
        "Summary": ("Metric", []), "Top Customers": ("customer_name", ["total_spent", "clv_estimate"]),
        "At Risk Customers": ("customer_name", ["total_spent", "days_since_last_purchase", "engagement_score"]),
        "Segment Analysis": ("customer_segment", ["customer_id_count", "total_spent_sum", "total_spent_mean", "engagement_score_mean"])},
}


def _pack(name, sheets):
    """(sheet, item, metric, text, value): the cells of a pack that was committed and is read again from its files."""
    df = next(iter(sheets.values()))
    pack = ReportPack(df.sparkSession, _scratch(df, "pack"))
    pack.commit(sheets)
    out = None
    for sheet in pack.sheets():
        item, metrics = PACKS[name][sheet]
        text, none = F.lit(None).cast("string"), F.lit(None).cast("double")
        cells = [F.struct(F.lit(m).alias("metric"), text.alias("text"), F.col(m).cast("double").alias("value")) for m in metrics]
        cells = cells or [F.struct(F.lit("Value").alias("metric"), F.col("Value").alias("text"), none.alias("value"))]
        rows = pack.read(sheet).select(F.lit(sheet).alias("sheet"), F.col(item).cast("string").alias("item"), F.explode(F.array(*cells)).alias("c"))
        rows = rows.select("sheet", "item", "c.*")
        out = rows if out is None else out.unionAll(rows)
    return out


def _stored(P):
    """Several sheets read the profile: it is written once."""
    return once(P, "profile")


_on_profile("l07_report_pack", lambda P: _pack("l07_report_pack", (lambda S: report_sheets(S, Rp.generate_reports(S)))(_stored(P))))
_on_export("l08_custom_pack", lambda P: _pack("l08_custom_pack", custom_sheets(_stored(P))))
_reg("l05_export", lambda C, T, E: _through_csv(_profile(C, T, E), EXPORT_COLUMNS))
_reg("l06_export_short", lambda C, T, E: _through_csv(_profile(C, T, E), EXPORT_SHORT_COLUMNS))
_reg("p12_process_metrics", _profile)
_on_profile("p13_churn_risk", lambda P: P.select("customer_id", "days_since_last_purchase",
                                                 "purchase_frequency", "churn_risk"))
_on_profile("p14_value_segment", lambda P: P.select("customer_id", "total_spent", "purchase_frequency",
                                                    "value_segment"))

_on_profile("r01_segment_analysis", Rp.segment_analysis)
_on_profile("r02_churn_risk_report", Rp.churn_risk_report)
_on_profile("r03_value_segment_report", Rp.value_segment_report)
_on_profile("r04_channel_report", Rp.channel_report)
_on_profile("r05_executive_summary", Rp.executive_summary)
_on_export("r06_custom_summary", Rp.custom_summary)
_on_export("r07_top_by_spend", lambda P: Rp.top_by_spend(P, 20))
_on_export("r08_at_risk", Rp.at_risk)
_on_export("r09_segment_engagement", Rp.segment_engagement)
_on_profile("r10_key_statistics", Rp.key_statistics)

_on_export("a01_shape_and_columns", Sg.shape_and_columns)
_on_export("a02_describe", Sg.describe)
_on_export("a03_value_counts", lambda P: Sg.value_counts(P, "customer_segment"))
_on_export("a04_high_value", lambda P: Sg.high_value(P, 100000))
_on_export("a05_segment_summary", Sg.segment_summary)
_on_export("a06_segment_by_churn_pivot", Sg.segment_by_churn_pivot)
_on_export("a07_top_by_clv", lambda P: Sg.top_by_clv(P, 10))
_on_export("a08_spend_percentiles", Sg.spend_percentiles)
_on_export("a09_spending_categories", Sg.spending_categories)
# The test tables' segments are TPC-H market segments; compare two of them.
_on_export("a10_segment_gap", lambda P: Sg.segment_gap(P, "BUILDING", "AUTOMOBILE"))
_on_export("a11_rfm_quintiles", Sg.rfm_quintiles)
_on_export("a12_health_scores", Sg.health_scores)
_on_export("a12_top_health", lambda P: Sg.top_health(P, 10))
_on_export("a13_churn_signals", Sg.churn_signals)
# A running sum of 15 digits adds up rounding; its comparison is in cents and in millionths of a per cent.
_on_export("a14_pareto", lambda P: Sg.pareto(P).withColumns({
    "cumulative_revenue": F.round("cumulative_revenue", 2), "cumulative_pct": F.round("cumulative_pct", 6)}))
_on_export("a15_top_share", lambda P: Sg.top_share(P, 0.2))
_on_export("a16_channel_roi", Sg.channel_roi)
_on_export("a17_retention_by_tenure", Sg.retention_by_tenure)

_on_profile("c01_customers_by_segment", Ch.customers_by_segment)
_on_profile("c02_churn_distribution", Ch.churn_distribution)
_on_profile("c03_value_segment_counts", Ch.value_segment_counts)
_on_profile("c04_spend_frequency_points", Ch.spend_frequency_points)
_on_profile("c04_spend_frequency_grid", lambda P: Ch.spend_frequency_grid(P, 20, 6))
_on_profile("c05_recency_histogram", lambda P: Ch.recency_histogram(P, 30, 365))
_on_profile("c06_engagement_by_segment", Ch.engagement_by_segment)
_on_profile("c07_clv_box_stats", Ch.clv_box_stats)
_on_profile("c07_clv_outliers", Ch.clv_outliers)
_on_profile("c08_conversion_by_channel", Ch.conversion_by_channel)
_on_profile("c09_transaction_histogram", lambda P: Ch.transaction_histogram(P, 20))
_on_profile("c10_revenue_by_segment", Ch.revenue_by_segment)
