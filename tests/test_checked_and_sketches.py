"""Loads that keep what did not parse, and counts and quantiles from mergeable sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.operators import sketches as S
from custlens.plans.checks import explain_text
from custlens.sources import testmap
from custlens.sources.checked import checked_load
from custlens.sources.loads import open_table
from custlens.sources.tables import read_table

from .conftest import SF_SMALL

LINES = """quantity,transaction_id,customer_id,transaction_date,product_category,amount,payment_method,note
1,1,10,2024-01-05,Home,5.50,PayPal,x
2,2,10,2024-02-30,Home,n/a,PayPal,x
2.5,3,11,soon,Books,1e400,Card,x
99999999999,4,eleven,2024-01-07,Books,-.5,Card,x
3,,12,2024-01-08,Books,7,Card,x
3,T5,12,2024-01-08,Books,7,Card,x
,6,,,,,,
"""


def test_problems_are_kept_with_their_reasons(spark, tmpdir_path):
    with open(f"{tmpdir_path}/t.csv", "w") as fh:
        fh.write(LINES)
    load = checked_load(spark, f"{tmpdir_path}/t.csv", "transactions", f"{tmpdir_path}/out")
    got = {(r.transaction_id, r.column, r.value, r.reason) for r in load.quarantine.collect()}
    assert got == {
        (2, "transaction_date", "2024-02-30", "no such date"), (2, "amount", "n/a", "not a number"),
        (3, "quantity", "2.5", "not a whole number"), (3, "transaction_date", "soon", "not a date"), (3, "amount", "1e400", "out of range"),
        (4, "quantity", "99999999999", "out of range"), (4, "customer_id", "eleven", "not a number"),
        (None, "transaction_id", None, "no key"), (None, "transaction_id", "T5", "not a number")}
    assert (load.read, load.rejected, load.with_problems) == (7, 2, 5)
    assert load.by_column == {"transaction_id": 2, "customer_id": 1, "transaction_date": 2, "amount": 2, "quantity": 2}
    assert load.rows.count() == load.read - load.rejected and load.quarantine.count() == sum(load.by_column.values())
    assert all(f.endswith("t.csv") for f in (r.file for r in load.quarantine.collect()))
    row = load.rows.where("transaction_id = 4").first()
    assert row.amount == -0.5 and row.quantity is None and row.customer_id is None


def test_counts_add_up_over_many_files(spark, tmpdir_path):
    T = testmap.load(spark, SF_SMALL)[1]
    i = F.col("transaction_id")
    text = T.withColumns({"transaction_date": F.when(i % 7 == 0, "2023-02-29").otherwise(F.col("transaction_date").cast("string")),
                          "amount": F.when(i % 11 == 0, "none").otherwise(F.col("amount").cast("string"))})
    for fmt in ("csv", "json"):
        w = text.repartition(4).write.format(fmt)
        (w.option("header", True) if fmt == "csv" else w).save(f"{tmpdir_path}/{fmt}")
        load = checked_load(spark, f"{tmpdir_path}/{fmt}", "transactions", f"{tmpdir_path}/out-{fmt}", fmt)
        assert load.read == T.count() and load.rejected == 0
        assert load.by_column == {"transaction_date": T.where(i % 7 == 0).count(), "amount": T.where(i % 11 == 0).count()}
        assert load.with_problems == T.where((i % 7 == 0) | (i % 11 == 0)).count()
        assert load.quarantine.count() == sum(load.by_column.values())
    plain = read_table(spark, f"{tmpdir_path}/csv", "transactions", "csv")
    assert load.rows.exceptAll(plain).count() == 0 and plain.exceptAll(load.rows).count() == 0  # the values of the plain load
    assert "__bad=true" in explain_text(load.quarantine, "formatted") or "PartitionFilters: [" in explain_text(load.quarantine, "formatted")
    with open_table(spark, f"{tmpdir_path}/target", "transactions", 4) as target:
        assert target.insert_or_ignore(load.rows, "a") == T.count()
    with pytest.raises(ValueError):
        checked_load(spark, f"{tmpdir_path}/csv", "customers", f"{tmpdir_path}/none")
    with pytest.raises(ValueError):
        checked_load(spark, f"{tmpdir_path}/csv", "transactions", f"{tmpdir_path}/none", "parquet")


# ---------------------------------------------------------------------- sketches

@pytest.mark.parametrize("n", [1_000, 40_000, 300_000])
def test_error_of_distinct_counts(spark, n):
    """Two loads that overlap by half, united: within four times the sketches' error; theta is exact while it holds all values."""
    rows = spark.range(2 * n).select((F.col("id") % n).alias("customer_id"), (F.col("id") % 3).cast("string").alias("g"))
    first = S.distinct_state(rows.where("customer_id < 0.75 * %d" % n), "customer_id", {"g": F.col("g")})
    second = S.distinct_state(rows.where("customer_id > 0.25 * %d" % n), "customer_id", {"g": F.col("g")})
    got = S.distinct_counts(first.unionAll(second)).first()
    assert abs(got.distinct_hll - n) <= 4 * 1.04 / 2 ** (S.LOG2_HLL / 2) * n + 1
    if n <= 2**S.LOG2_THETA:
        assert got.distinct_theta == n
    else:
        assert abs(got.distinct_theta - n) <= 4 / 2 ** (S.LOG2_THETA / 2) * n


def test_buyers_kept_from_sketches_and_facts(spark):
    T = testmap.load(spark, SF_SMALL)[1]
    odd = T.unionAll(T.limit(50).withColumn("customer_id", F.lit(None).cast("long"))).unionAll(
        T.limit(50).withColumn("transaction_date", F.lit(None).cast("date"))).unionAll(T.limit(50).withColumn("product_category", F.lit(None).cast("string")))
    half = F.col("transaction_id") % 2 == 0
    state = S.category_buyers(odd.where(half)).unionAll(S.category_buyers(odd.where(~half)))  # two loads
    exact = S.buyers_kept_exact(odd).collect()
    assert S.buyers_kept(state).collect() == exact and sum(r.kept_buyers for r in exact) > 0
    assert S.buyers_kept(S.category_buyers(T.limit(0))).collect() == [] == S.buyers_kept_exact(T.limit(0)).collect()


def test_users_per_device_from_monthly_sketches(spark):
    E = testmap.load(spark, SF_SMALL)[2]
    want = {r.device_type: (r.n, r.d) for r in E.groupBy("device_type").agg(F.count("*").alias("n"), F.count_distinct("customer_id").alias("d")).collect()}
    got = {r.device_type: (r.rows, r.distinct_theta) for r in S.distinct_counts(S.device_users(E), ["device_type"]).collect()}
    assert got == want


@pytest.mark.parametrize("k,error", [(200, 0.0133 * 2), (2048, 0.0017 * 2)])
def test_rank_error_of_merged_quantiles(spark, k, error):
    """Sketches per segment and day, merged over the days: ranks within twice the sketch's error."""
    rng = np.random.default_rng(9)
    x = np.where(rng.random(60_000) < 0.2, 10.0, rng.lognormal(3, 2, 60_000))
    rows = spark.createDataFrame(list(zip(rng.choice(["a", "b"], len(x)).tolist(), rng.integers(0, 40, len(x)).tolist(), x.tolist())),
                                 "customer_segment string, day int, v double")
    state = S.quantile_state(rows, "v", {"customer_segment": F.col("customer_segment"), "day": F.col("day")}, k)
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    names = [f"q{i}" for i in range(len(probs))]
    pdf = rows.toPandas()
    for by in ([], ["customer_segment"]):
        for r in S.sketched_quantiles(state, probs, names, by, k).collect():
            own = np.sort((pdf if not by else pdf[pdf.customer_segment == r.customer_segment]).v.to_numpy())
            assert r.n == len(own)
            for p, name in zip(probs, names):
                below, upto = np.searchsorted(own, r[name], "left") / len(own), np.searchsorted(own, r[name], "right") / len(own)
                assert below - error <= p <= upto + error


def test_spend_quantiles_by_segment(spark):
    C, T, E = testmap.load(spark, SF_SMALL)
    state = S.spend_by_segment_and_day(T, C)
    exact = {r.customer_segment: r.m for r in T.join(C, "customer_id").groupBy("customer_segment").agg(F.percentile_approx("amount", 0.5, 100_000).alias("m")).collect()}
    got = {r.customer_segment: r.m for r in S.sketched_quantiles(state, [0.5], ["m"], ["customer_segment"]).collect()}
    assert set(got) == set(exact)
    assert all(abs(got[s] - exact[s]) <= 0.05 * exact[s] for s in exact)
