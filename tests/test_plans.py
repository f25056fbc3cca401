"""Plan checks: the properties the operators are designed around."""

from custlens.operators import profile as Pr
from custlens.operators import queries as Q
from custlens.plans.checks import explain_text, has_python_udf
from custlens.registry import AS_OF, registry
from custlens.sources import testmap

from .conftest import SF_SMALL


def test_no_python_udfs_anywhere(spark):
    for name, fn in registry().items():
        assert not has_python_udf(fn(spark, SF_SMALL)), name


def test_profile_never_joins_raw_facts(spark):
    C, T, E = testmap.load(spark, SF_SMALL)
    for df in (Pr.extract_profile(C, T, E), Q.segment_performance(C, T, E)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # every join input on the transaction / engagement side is an Aggregate
        for line in plan.splitlines():
            if "Join" in line:
                assert "o_orderkey" not in line and "event_id" not in line


def test_recent_window_filter_reaches_scan(spark):
    C, T, E = testmap.load(spark, SF_SMALL)
    text = explain_text(Q.recently_active(C, T, AS_OF, 30))
    assert "PushedFilters" in text and "o_orderdate" in text


def test_scans_are_pruned(spark):
    C, T, E = testmap.load(spark, SF_SMALL)
    text = explain_text(Q.revenue_by_payment_method(T))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in text


def test_scalar_subquery_not_cross_join(spark):
    C, T, E = testmap.load(spark, SF_SMALL)
    for df in (Q.customers_by_channel(C), Q.business_kpis(C, T, AS_OF), Pr.build_profile(C, T, E, AS_OF)):
        text = explain_text(df, "simple")
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def _agg_lines(df):
    return [ln for ln in explain_text(df, "simple").splitlines() if "Aggregate" in ln]


def test_fact_aggregation_combines_map_side(spark):
    """A hot customer sends one partial row per map task: every aggregate over the
    fact tables has a partial stage below its exchange."""
    from custlens.operators.summaries import eng_by_customer, tx_by_customer
    C, T, E = testmap.load(spark, SF_SMALL)
    for df in (tx_by_customer(T), eng_by_customer(E)):
        lines = _agg_lines(df)
        assert any("partial_" in ln for ln in lines)
        assert lines[-1].count("partial_") > 0  # the bottom (map-side) aggregate is partial


def test_insert_or_ignore_is_combinable(spark):
    from custlens.sources.tables import insert_or_ignore
    C, T, E = testmap.load(spark, SF_SMALL)
    text = explain_text(insert_or_ignore(None, T, table="transactions"), "simple")
    assert "partial_min_by" in text and "Window" not in text


def test_exact_distinct_and_dedup_options(spark):
    from custlens.operators.summaries import tx_by_customer
    C, T, E = testmap.load(spark, SF_SMALL)
    a = {r.customer_id: r.distinct_ids for r in tx_by_customer(T).collect()}
    b = {r.customer_id: r.distinct_ids for r in tx_by_customer(T, exact_distinct=True).collect()}
    assert a == b
    fan = {r.customer_id: r for r in Pr.extract_profile(C, T, E).collect()}
    flat = {r.customer_id: r for r in Pr.extract_profile(C, T, E, fanout=False).collect()}
    assert fan.keys() == flat.keys()
    assert any(fan[k].total_spent != flat[k].total_spent for k in fan)  # some customers fan out
    for k in fan:
        assert fan[k].avg_transaction_value == flat[k].avg_transaction_value
        assert fan[k].engagement_days == flat[k].engagement_days


def test_facade_answers_from_shared_summaries(spark):
    """With the facade, customer-level questions read the checkpointed
    summaries and never scan the raw orders table again."""
    from custlens.analytics import CustomerAnalytics
    from custlens.registry import registry
    C, T, E = testmap.load(spark, SF_SMALL)
    ca = CustomerAnalytics(C, T, E, AS_OF)
    for name in ("customer_transactions", "rfm_rules", "churn_by_inactivity", "clv_three_year",
                 "cohort_retention", "channel_effectiveness", "top_customers", "value_comparison",
                 "avg_spend_by_segment", "inactive_customers"):
        df = getattr(ca, name)()
        text = explain_text(df, "simple")
        assert "orders.parquet" not in text, name
        assert "Join" not in text, name  # a projection of the pre-joined, checkpointed frame
    # same answers as the standalone operators
    reg = registry()
    for name, fn in (("s11_rfm_rules", ca.rfm_rules), ("s15_segment_performance", ca.segment_performance),
                     ("s19_value_comparison", ca.value_comparison), ("s21_business_kpis", ca.business_kpis),
                     ("s24_avg_spend_by_segment", ca.avg_spend_by_segment), ("s08_customer_engagement",
                                                                             ca.customer_engagement),
                     ("s10_customer_conversion", ca.customer_conversion), ("s14_cohort_retention",
                                                                           ca.cohort_retention)):
        from custlens.functions.normalize import normalize
        assert normalize(fn()).exceptAll(reg[name](spark, SF_SMALL)).count() == 0, name
    assert normalize(ca.profile).exceptAll(reg["p12_process_metrics"](spark, SF_SMALL)).count() == 0


def test_facade_matches_registry_for_whole_catalogue(spark):
    from custlens.analytics import CustomerAnalytics
    from custlens.functions.normalize import normalize
    from custlens.registry import registry
    C, T, E = testmap.load(spark, SF_SMALL)
    ca = CustomerAnalytics(C, T, E, AS_OF)
    reg = registry()
    pairs = {name: "_".join(name.split("_")[1:]) for name in reg
             if name.startswith("s") and not name.endswith(("_uncut", "_repeated_ids"))}
    for name, method in pairs.items():
        ours = normalize(getattr(ca, method)())
        ref = reg[name](spark, SF_SMALL)
        assert ours.columns == ref.columns, name
        assert ours.exceptAll(ref).count() == 0 and ref.exceptAll(ours).count() == 0, name


def test_facade_reads_only_needed_columns(spark):
    """The shared intermediates are Parquet tables: a question reads its columns only."""
    from custlens.analytics import CustomerAnalytics
    C, T, E = testmap.load(spark, SF_SMALL)
    ca = CustomerAnalytics(C, T, E, AS_OF)
    text = explain_text(ca.rfm_rules(), "formatted")
    schema = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")]
    assert schema and all("page_views_avg" not in ln and "email" not in ln for ln in schema)
