
from pyspark.sql import functions as F

from custlens.functions.normalize import normalize
from custlens.functions.ranking import ordered_rank
from custlens.operators import profile as Pr
from custlens.operators import queries as Q
from custlens.operators import segments as Sg
from custlens.plans.checks import explain_text
from custlens.registry import AS_OF, registry
from custlens.sources import testmap

from .conftest import SF_SMALL


def test_partition_count_does_not_change_results(spark):
    reg = registry()
    names = ["s11_rfm_rules", "s15_segment_performance", "p12_process_metrics", "a11_rfm_quintiles",
             "a14_pareto", "c07_clv_box_stats"]
    before = {n: reg[n](spark, SF_SMALL).collect() for n in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        for n in names:
            assert sorted(map(tuple, reg[n](spark, SF_SMALL).collect()), key=str) == \
                sorted(map(tuple, before[n]), key=str), n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_fanout_identity_against_literal_join(spark):
    """P01 from pre-aggregates equals the reference's literal three-way join."""
    C, T, E = testmap.load(spark, SF_SMALL)
    j = (C.alias("c").join(T.alias("t"), F.col("c.customer_id") == F.col("t.customer_id"), "left")
         .join(E.alias("e"), F.col("c.customer_id") == F.col("e.customer_id"), "left"))
    literal = j.groupBy(F.col("c.customer_id").alias("customer_id")).agg(
        F.count_distinct("t.transaction_id").alias("total_transactions"),
        F.sum("t.amount").alias("total_spent"),
        F.sum("t.quantity").alias("total_items"),
        F.sum("e.items_added_to_cart").alias("total_cart_adds"),
        F.sum(F.when(F.col("e.items_purchased") > 0, 1).otherwise(0)).alias("days_with_purchase"),
        F.count_distinct("e.engagement_date").alias("engagement_days"))
    ours = Pr.extract_profile(C, T, E).select(*literal.columns)
    diff = normalize(ours).exceptAll(normalize(literal))
    assert diff.count() == 0


def test_pareto_ends_at_100_percent(spark):
    C, T, E = testmap.load(spark, SF_SMALL)
    P = Pr.build_profile(C, T, E, AS_OF)
    out = Sg.pareto(P)
    assert out.columns == P.columns + ["cumulative_revenue", "cumulative_pct"]
    last = out.agg(F.max("cumulative_pct").alias("m")).first().m
    assert abs(last - 100.0) < 1e-9


def test_growth_total_equals_kpi_customers(spark):
    C, T, E = testmap.load(spark, SF_SMALL)
    last = Q.customer_growth(C).orderBy(F.desc("month")).first()
    assert last.cumulative_customers == Q.business_kpis(C, T, AS_OF).first().total_customers


def test_ranking_windows_are_partitioned_by_bucket(spark):
    C, T, E = testmap.load(spark, SF_SMALL)
    P = Pr.build_profile(C, T, E, AS_OF)
    df = ordered_rank(P.select("customer_id", "total_spent"), "total_spent", "customer_id",
                      descending=True, running_sum="total_spent")
    text = explain_text(df, "simple")
    assert "hashpartitioning(__b" in text and "__t" in text
    ranks = [r.row_number for r in df.orderBy("row_number").collect()]
    assert ranks == list(range(1, len(ranks) + 1))
