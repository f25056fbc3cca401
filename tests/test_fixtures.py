"""Tiny-frame unit tests: one per fixture of FIXTURES.md §3."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from custlens.functions.exprs import pd_round, sql_round
from custlens.operators import charts as Ch
from custlens.operators import profile as Pr
from custlens.operators import queries as Q
from custlens.operators import segments as Sg
from custlens.sources.schemas import CUSTOMERS, ENGAGEMENT, TRANSACTIONS
from custlens.sources.tables import insert_or_ignore, parse_dates

AS_OF = datetime(2001, 8, 2, 12, 0, 0)
D0 = AS_OF.date()


def ago(n):
    return D0 - timedelta(days=n)


def cust(i, seg="Loyal", signup=None, channel="Email"):
    return (i, f"Customer_{i}", f"customer{i}@email.com", signup or ago(400), "India", seg, channel)


def tx(tid, cid, amount, days_ago=10, cat="Home", qty=1):
    return (tid, cid, ago(days_ago), cat, amount, qty, "PayPal")


def eng(eid, cid, days_ago=5, views=10, cart=1, bought=0):
    return (eid, cid, ago(days_ago), views, 30, cart, bought, "Mobile")


@pytest.fixture()
def frames(spark):
    def make(customers, transactions=(), engagement=()):
        return (spark.createDataFrame(list(customers), CUSTOMERS),
                spark.createDataFrame(list(transactions), TRANSACTIONS),
                spark.createDataFrame(list(engagement), ENGAGEMENT))
    return make


def by_id(df, key="customer_id"):
    return {r[key]: r for r in df.collect()}


def test_f1_fanout(frames):
    C, T, E = frames([cust(1)], [tx(1, 1, 10.0), tx(2, 1, 20.0)], [eng(1, 1), eng(2, 1), eng(3, 1, bought=1)])
    fan = by_id(Pr.extract_profile(C, T, E))[1]
    flat = by_id(Pr.extract_profile(C, T, E, fanout=False))[1]
    assert fan.total_spent == 90.0 and flat.total_spent == 30.0
    assert fan.avg_transaction_value == 15.0 == flat.avg_transaction_value
    assert fan.total_cart_adds == 6 and flat.total_cart_adds == 3
    assert fan.days_with_purchase == 2 and fan.total_items == 6
    seg = Q.segment_performance(C, T, E).first()
    assert seg.segment_revenue == 90.0 and seg.avg_transaction == 15.0 and seg.total_transactions == 2


def test_f2_no_engagement(frames):
    C, T, E = frames([cust(2)], [tx(1, 2, 50.0)], [])
    raw = by_id(Pr.extract_profile(C, T, E))[2]
    assert raw.total_spent == 50.0 and raw.days_with_purchase == 0 and raw.avg_page_views is None
    prof = by_id(Pr.build_profile(C, T, E, AS_OF))[2]
    assert prof.avg_page_views == 0.0 and prof.engagement_score == 0.0


def test_f3_engagement_only(frames):
    C, T, E = frames([cust(3)], [tx(9, 99, 5.0)], [eng(1, 3)])
    assert by_id(Q.churn_by_inactivity(C, T, AS_OF))[3].churn_risk == "Low"
    prof = by_id(Pr.build_profile(C, T, E, AS_OF))[3]
    assert prof.churn_risk == "Critical" and prof.days_since_last_purchase == 999
    assert by_id(Q.clv_three_year(C, T, AS_OF))[3].clv_estimate_3year is None
    assert Q.value_comparison(C, T).first().value_category == "Above Average"


def test_f4_boundary_days(frames):
    C, T, E = frames([cust(1), cust(2), cust(3)], [tx(1, 1, 1.0, 30), tx(2, 2, 1.0, 90), tx(3, 3, 1.0, 180)])
    churn = by_id(Q.churn_by_inactivity(C, T, AS_OF))
    assert [churn[i].churn_risk for i in (1, 2, 3)] == ["Medium", "High", "Critical"]
    assert [churn[i].days_since_purchase for i in (1, 2, 3)] == [30, 90, 180]
    assert Q.recently_active(C, T, AS_OF, 30).count() == 0
    C2, T2, _ = frames([cust(1)], [tx(1, 1, 1.0, 29)])
    assert Q.recently_active(C2, T2, AS_OF, 30).count() == 1
    assert set(by_id(Q.inactive_customers(C, T, AS_OF, 180, None))) == set()
    C3, T3, _ = frames([cust(4)], [tx(1, 4, 1.0, 181)])
    assert set(by_id(Q.inactive_customers(C3, T3, AS_OF, 180, None))) == {4}


def test_f5_conversion_counts_records(frames):
    C, T, E = frames([cust(1)], [], [eng(1, 1, 3, bought=1), eng(2, 1, 3, bought=2)])
    r = Q.customer_conversion(C, E).first()
    assert (r.engagement_days, r.conversion_days, r.conversion_rate) == (1, 2, 200.0)


def test_f6_cohort_counts_rows(frames):
    C, T, E = frames([cust(1, signup=date(2001, 1, 5))], [tx(1, 1, 1.0), tx(2, 1, 2.0), tx(3, 1, 3.0)])
    r = Q.cohort_retention(C, T).first()
    assert (r.signup_month, r.customers_acquired, r.customers_with_purchase, r.retention_rate) == \
        ("2001-01", 1, 3, 300.0)
    assert r.cohort_revenue == 6.0


def test_f7_rounding_families(spark):
    df = spark.createDataFrame([(0.125,), (2.675,)], "x double")
    sql = [r[0] for r in df.select(sql_round("x", 2)).collect()]
    pdr = [r[0] for r in df.select(pd_round("x", 2)).collect()]
    assert sql == [0.13, 2.68] and pdr == [0.12, 2.68]


def test_f8_signup_today(frames):
    C, T, E = frames([cust(1, signup=D0)], [tx(1, 1, 10.0, 0)])
    assert by_id(Q.clv_three_year(C, T, AS_OF))[1].clv_estimate_3year == 360.0
    prof = by_id(Pr.build_profile(C, T, E, AS_OF))[1]
    assert prof.tenure_months == 0.0 and prof.purchase_frequency == 1.0


def test_f9_bad_dates(spark):
    df = spark.createDataFrame([("2024-02-31",), ("garbage",), ("2001-03-04",), (None,)], "d string")
    got = [r[0] for r in parse_dates(df, ["d"]).collect()]
    assert got == [None, None, date(2001, 3, 4), None]
    T = spark.createDataFrame([(1, 1, None, "Home", 5.0, 1, "PayPal"), (2, 1, ago(1), "Home", 7.0, 1, "PayPal")],
                              TRANSACTIONS)
    months = {r.month: r.transaction_count for r in Q.monthly_revenue(T).collect()}
    assert months == {None: 1, "2001-08": 1}


def test_f10_insert_or_ignore(spark):
    existing = spark.createDataFrame([(1, "a")], "id long, v string")
    batch = spark.createDataFrame([(1, "x"), (2, "b"), (2, "c"), (3, "d")], "id long, v string")
    rows = insert_or_ignore(existing, batch, key="id", order_by=["v"])
    assert sorted(map(tuple, rows.collect())) == [(2, "b"), (3, "d")]
    merged = existing.unionByName(rows)
    assert insert_or_ignore(merged, batch, key="id", order_by=["v"]).count() == 0


def _profile_like(spark, spend, freq=None, days=None):
    n = len(spend)
    rows = [(i + 1, f"c{i + 1}", float(spend[i]), float(freq[i] if freq else i), int(days[i] if days else i))
            for i in range(n)]
    return spark.createDataFrame(rows, "customer_id long, customer_name string, total_spent double, "
                                       "purchase_frequency double, days_since_last_purchase int")


@pytest.mark.parametrize("n,sizes", [(7, [2, 1, 1, 1, 2]), (12, [3, 2, 2, 2, 3]), (200, [40] * 5)])
def test_f11_quintile_sizes(spark, n, sizes):
    P = _profile_like(spark, list(range(n)))
    out = Sg.rfm_quintiles(P).collect()
    for col in ("F_score", "M_score"):
        counts = [sum(1 for r in out if r[col] == k) for k in range(1, 6)]
        assert counts == sizes, (col, counts)
    r_counts = [sum(1 for r in out if r.R_score == k) for k in range(5, 0, -1)]
    assert r_counts == sizes


def test_f12_repeated_edges(spark):
    P = _profile_like(spark, [1, 1, 1, 1, 1, 1, 2, 3])
    m = sorted(r.M_score for r in Sg.rfm_quintiles(P).collect())
    # edges at .2 .4 .6 .8 are 1, 1, 1, 1.6: bins 2-3 are empty, 2 and 3 lie above 1.6
    assert m == [1, 1, 1, 1, 1, 1, 5, 5]


def test_f13_tenure_bands(spark):
    rows = [(i, t, 1.0, "Low") for i, t in enumerate([0.0, 3.0, 3.1, 24.0, 100.0, 101.0])]
    P = spark.createDataFrame(rows, "customer_id long, tenure_months double, total_spent double, churn_risk string")
    got = [(r.tenure_band, r.customers) for r in Sg.retention_by_tenure(P).collect()]
    assert got == [("(0, 3]", 1), ("(3, 6]", 1), ("(12, 24]", 1), ("(24, 100]", 1)]


def test_f14_rfm_rules(frames):
    cases = [(6, 50001.0), (4, 25001.0), (2, 1.0), (1, 1e6), (0, None), (6, 50000.0)]
    customers, txs, tid = [], [], 0
    for cid, (n, total) in enumerate(cases, start=1):
        customers.append(cust(cid))
        for j in range(n):  # exact split: one big amount, the rest 1.0 each
            tid += 1
            txs.append(tx(tid, cid, (total - (n - 1)) if j == 0 and total is not None else
                          (None if total is None else 1.0)))
    C, T, E = frames(customers, txs)
    got = by_id(Q.rfm_rules(C, T, AS_OF))
    assert [got[i].rfm_segment for i in range(1, 7)] == ["VIP", "Gold", "Silver", "Bronze", "Bronze", "Gold"]


def test_f15_profile_churn(spark):
    rows = [(29, 2.1), (29, 2.0), (89, 1.1), (89, 1.0), (179, 0.0), (180, 9.0)]
    df = spark.createDataFrame(rows, "d int, f double")
    got = [r[0] for r in df.select(Pr.churn_risk("d", "f")).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "High", "Critical"]


def test_f16_topk_ties(frames):
    C, T, E = frames([cust(i) for i in range(1, 6)], [tx(i, i, 100.0) for i in range(1, 6)])
    assert [r.customer_id for r in Q.top_customers(C, T, 3).collect()] == [1, 2, 3]


def test_f17_histograms(spark):
    df = spark.createDataFrame([(0,), (5,), (10,)], "x int")
    h = {r.bin: r["count"] for r in Ch.histogram(df, "x", 5).collect()}
    assert h == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1}
    same = spark.createDataFrame([(7,), (7,)], "x int")
    h2 = Ch.histogram(same, "x", 30).collect()
    assert len(h2) == 30 and sum(r["count"] for r in h2) == 2 and h2[15]["count"] == 2


def test_f18_null_amount_and_orphan(frames):
    C, T, E = frames([cust(1)], [tx(1, 1, 10.0), tx(2, 1, None), tx(3, 77, 5.0)], [eng(1, 1), eng(2, 1)])
    seg = Q.segment_performance(C, T, E).first()
    assert seg.segment_revenue == 20.0 and seg.avg_transaction == 10.0
    s04 = by_id(Q.customer_transactions(C, T))
    assert set(s04) == {1} and s04[1].transaction_count == 2 and s04[1].avg_transaction == 10.0
    cats = Q.revenue_by_category(T).first()
    assert cats.transaction_count == 3 and cats.total_revenue == 15.0


def test_f19_health_all_zero_days(spark):
    rows = [(1, "a", 10.0, 0, 1.0), (2, "b", 20.0, 0, 2.0)]
    P = spark.createDataFrame(rows, "customer_id long, customer_name string, engagement_score double, "
                                    "days_since_last_purchase int, purchase_frequency double")
    assert [r.health_score for r in Sg.health_scores(P).collect()] == [None, None]


def test_f20_engagement_absent(frames):
    C, T, E = frames([cust(1), cust(2)], [], [eng(1, 2)])
    r = by_id(Q.customer_engagement(C, E))[1]
    assert (r.engagement_days, r.total_page_views, r.days_with_purchase) == (0, None, 0)


def test_value_segment_and_summary(frames):
    C, T, E = frames([cust(1), cust(2)], [tx(1, 1, 1000.0), tx(2, 1, 3000.0), tx(3, 2, 10.0)])
    P = Pr.build_profile(C, T, E, AS_OF)
    segs = by_id(P)
    assert segs[1].value_segment == "Star Customer" and segs[2].value_segment == "Development"
    from custlens.operators import reports as R
    summary = {r.Metric: r.Value for r in R.executive_summary(P).collect()}
    assert summary["Total Customers"] == "2" and summary["Total Revenue"] == "₹4,010"
    assert summary["Avg Customer Value"] == "₹2,005"
