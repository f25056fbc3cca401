"""Distributed rank / running sum / percentiles against single-task references."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from custlens.functions import ranking
from custlens.functions.ranking import exact_percentiles, ordered_rank, pairs_at_ranks, percentiles


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(7)
    rows = []
    for i in range(4000):
        g = "hot" if random.random() < 0.5 else random.choice(["a", "b"])
        r = random.random()
        v = 0.0 if r < 0.35 else (None if r < 0.45 else float(random.randint(1, 500)))
        rows.append((i, g, v))
    return spark.createDataFrame(rows, "id long, g string, v double").cache()


@pytest.mark.parametrize("group", [[], ["g"]])
@pytest.mark.parametrize("desc", [True, False])
def test_bucketed_rank_equals_global_window(skewed, group, desc):
    order = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_last()
    w = Window.partitionBy(*group).orderBy(order, "id")
    ref = skewed.select("id", F.row_number().over(w).alias("rk"),
                        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"))
    got = ordered_rank(skewed, "v", "id", descending=desc, group_cols=group, running_sum="v")
    j = ref.join(got, "id")
    assert j.count() == skewed.count()
    bad = j.where((F.col("rk") != F.col("row_number"))
                  | (F.abs(F.coalesce("rs", F.lit(0.0)) - F.coalesce("running_sum", F.lit(0.0))) > 1e-6))
    assert bad.count() == 0


def test_no_task_holds_all_rows(skewed):
    """Rows are never windowed without a partition key; only the counts per bucket are, and nothing runs early."""
    before = skewed.sparkSession.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = ordered_rank(skewed, "v", "id", descending=True, running_sum="v")
    exact_percentiles(skewed, "v", [0.25, 0.5])
    assert skewed.sparkSession.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    unkeyed = [w for w in plan.split("\n") if "Window [" in w and "windowspecdefinition(__b" in w]
    assert all("id#" not in w for w in unkeyed)


@pytest.mark.parametrize("buckets", [1, 3, 1 << 16])
def test_any_number_of_buckets(skewed, monkeypatch, buckets):
    monkeypatch.setattr(ranking, "BUCKETS", buckets)
    monkeypatch.setattr(ranking, "ID_RANGES", buckets)
    pdf = skewed.toPandas().dropna()
    got = percentiles(skewed, "v", [0, 0.3, 0.99, 1]).first()
    assert np.allclose(np.percentile(pdf.v, [0, 30, 99, 100]), [float(x) for x in got])
    order = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    ranks = {f"r{k}": (lambda n, k=k: F.lit(k)) for k in (1, 700, 1500, len(order))}
    rows = {r.name: (r.value, r.id) for r in pairs_at_ranks(skewed.select("id", "v"), "v", "id", ranks).collect()}
    assert rows == {f"r{k}": (order.v[k - 1], order.id[k - 1]) for k in (1, 700, 1500, len(order))}
    ranked = ordered_rank(skewed.where("v is not null"), "v", "id").select("id", "row_number").toPandas()
    assert ranked.sort_values("row_number").id.tolist() == order.id.tolist()


@pytest.mark.parametrize("group", [[], ["g"]])
def test_exact_percentiles_match_numpy(skewed, group):
    probs = [0, 0.2, 0.25, 0.5, 0.75, 0.8, 1]
    pdf = skewed.toPandas()
    got = exact_percentiles(skewed, "v", probs, group_cols=group).toPandas()
    if group:
        for _, row in got.iterrows():
            x = pdf[pdf.g == row["g"]].v.dropna().values
            assert np.allclose(np.percentile(x, [p * 100 for p in probs]), row.values[1:].astype(float))
    else:
        x = pdf.v.dropna().values
        assert np.allclose(np.percentile(x, [p * 100 for p in probs]), got.values[0].astype(float))


def test_small_input(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 2.0)], "id long, v double")
    got = ordered_rank(df, "v", "id", descending=True, running_sum="v")
    assert [(r.id, r.row_number, r.running_sum) for r in got.orderBy("row_number").collect()] == \
        [(1, 1, 3.0), (3, 2, 5.0), (2, 3, 6.0)]


def test_approx_percentiles_close(skewed):
    exact = percentiles(skewed, "v", [0.25, 0.5, 0.75], group_cols="g").orderBy("g").collect()
    approx = percentiles(skewed, "v", [0.25, 0.5, 0.75], group_cols="g", approx=True).orderBy("g").collect()
    for e, a in zip(exact, approx):
        assert e.g == a.g
        for name in ("p25", "p50", "p75"):
            assert abs(e[name] - a[name]) <= 5.0  # values 0..500; rank error ~ n/10000


def test_percentiles_of_ties_and_continuous_values(spark):
    random.seed(3)
    rows = [(i, random.choice("ab"), float(random.randint(0, 5)) if i % 2 else random.random() * 100) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    probs = [0, 0.01, 0.25, 0.5, 0.8, 0.99, 1]
    pdf = df.toPandas()
    for _, row in exact_percentiles(df, "v", probs, group_cols="g").toPandas().iterrows():
        x = pdf[pdf.g == row["g"]].v.values
        assert np.allclose(np.percentile(x, [p * 100 for p in probs]), row.values[1:].astype(float))
    assert exact_percentiles(df.limit(0), "v", [0.5]).first()[0] is None
    assert exact_percentiles(df.limit(0), "v", [0.5], group_cols="g").collect() == []
