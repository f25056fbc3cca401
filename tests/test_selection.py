"""Values at ranks by descent, prefix sums over a sorted table, and what they read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.functions import selection
from custlens.functions.selection import quantiles, rows_at_ranks, select_values
from custlens.operators import charts as Ch
from custlens.operators import profile as Pr
from custlens.operators import segments as Sg
from custlens.plans import materialize
from custlens.plans.checks import explain_text
from custlens.registry import AS_OF
from custlens.sources import testmap
from custlens.sources.schemas import EXPORT_COLUMNS

from .conftest import SF_SMALL

PROBS = [0, 0.01, 0.2, 0.25, 0.5, 0.8, 0.99, 1]


def frame(spark, groups, *columns):
    rows = [(g, *(None if x is None else float(x) for x in row)) for g, *row in zip(groups, *columns)]
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"c{i} double" for i in range(len(columns)))).repartition(3)


@pytest.fixture(scope="module")
def mixed(spark):
    """Ties, crowds within 1e-9 of the range, both signs, huge values, nulls, NaN, and a null group."""
    rng = np.random.default_rng(8)
    n = 1500
    ties = np.where(rng.random(n) < 0.4, 0.0, rng.integers(-20, 20, n)).tolist()
    crowd = np.where(rng.random(n) < 0.5, 1 + rng.random(n) * 1e-9, rng.standard_cauchy(n) * 1e6).tolist()
    wide = (np.sign(rng.standard_normal(n)) * 10.0 ** rng.uniform(-300, 300, n)).tolist()
    for i in range(0, n, 17):
        ties[i] = None
        crowd[i] = float("nan")
    g = rng.choice(["a", "b", "hot"], n, p=[0.1, 0.2, 0.7]).tolist()
    g[5] = g[6] = None
    return frame(spark, g, ties, crowd, wide).cache()


def usable(x):
    x = np.array([float("nan") if v is None else v for v in x], float)
    return x[~np.isnan(x)]


@pytest.mark.parametrize("parts", [1 << 9, 1 << 12])
@pytest.mark.parametrize("group", [None, "g"])
def test_quantiles_match_numpy(mixed, group, parts, monkeypatch):
    monkeypatch.setattr(selection, "MOST_PARTS", parts)
    cols = ["c0", "c1", "c2"]
    got = quantiles(mixed, cols, PROBS, group)
    rows = mixed.collect()
    keys = {(r.g,) for r in rows} if group else {()}
    assert set(got) == {(k, c) for k in keys for c in cols}
    for (k, c), vals in got.items():
        x = np.sort(usable([r[c] for r in rows if not group or r.g == k[0]]))
        pos = [(len(x) - 1) * p for p in PROBS]
        lo, hi = x[[int(np.floor(p)) for p in pos]], x[[int(np.ceil(p)) for p in pos]]
        assert vals == [float(a + (b - a) * (p - np.floor(p))) for a, b, p in zip(lo, hi, pos)]


def test_ranks_and_what_is_before_them(mixed):
    found = select_values(mixed, ["c0"], lambda g, c, n: {"none": 0, "first": 1, "mid": n // 2, "last": n, "beyond": n + 1})[(), "c0"]
    x = np.sort(usable([r.c0 for r in mixed.collect()]))
    assert found.n == len(x) and set(found.value) == {"first", "mid", "last"}
    for name, k in (("first", 1), ("mid", len(x) // 2), ("last", len(x))):
        assert found.value[name] == x[k - 1] and found.before[name] == int((x < x[k - 1]).sum())


def test_whole_numbers_stay_whole(spark):
    ids = [2**62 + i for i in range(200)] + [-(2**62), 3]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = select_values(df, ["id"], lambda g, c, n: {str(k): k for k in range(1, n + 1)})[(), "id"].value
    assert [got[str(k)] for k in range(1, len(ids) + 1)] == sorted(ids)


def test_infinite_and_single_values(spark):
    inf = float("inf")
    df = frame(spark, ["a"] * 6 + ["b"], [inf, -inf, 1.7e308, -1.7e308, 0.0, 5e-324, 4.0])
    got = select_values(df, ["c0"], lambda g, c, n: {str(k): k for k in range(1, n + 1)}, "g")
    assert [got[("a",), "c0"].value[str(k)] for k in range(1, 7)] == [-inf, -1.7e308, 0.0, 5e-324, 1.7e308, inf]
    assert got[("b",), "c0"].value == {"1": 4.0}
    assert quantiles(df.limit(0), ["c0"], [0.5]) == {((), "c0"): [None]}
    assert quantiles(df.limit(0), ["c0"], [0.5], "g") == {}


def test_levels_are_few_on_any_data(mixed, monkeypatch):
    """64 bits at 11 or 12 a level (24 ranks share the counts), and one for what rounding leaves."""
    levels = []
    plain = selection._part
    monkeypatch.setattr(selection, "_part", lambda *a: (levels.append(1), plain(*a))[1])
    quantiles(mixed, ["c0", "c1", "c2"], PROBS)
    assert len(levels) <= 7


def test_too_many_groups_is_an_error(mixed, monkeypatch):
    monkeypatch.setattr(selection, "MAX_GROUPS", 2)
    with pytest.raises(ValueError):
        quantiles(mixed, ["c0"], [0.5], "g")


def test_rows_at_ranks_break_ties_by_id(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), float(v)) for i, v in zip(rng.permutation(900), rng.integers(0, 4, 900))]
    df = spark.createDataFrame(rows, "id long, v double").repartition(4)
    order = sorted((v, i) for i, v in rows)
    got = rows_at_ranks(df, "v", "id", lambda n: {k: k for k in (1, 2, 300, 301, n)})
    assert got == {k: order[k - 1] for k in (1, 2, 300, 301, 900)}
    assert rows_at_ranks(df.limit(0), "v", "id", lambda n: {1: 1}) == {}


# ------------------------------------------------------------------ what is read

@pytest.fixture()
def export(spark):
    C, T, E = testmap.load(spark, SF_SMALL)
    return Pr.build_profile(C, T, E, AS_OF).select(*EXPORT_COLUMNS)


ORDERED = {"describe": Sg.describe, "segment_summary": Sg.segment_summary, "spend_percentiles": Sg.spend_percentiles,
           "rfm_quintiles": Sg.rfm_quintiles, "top_share": Sg.top_share, "pareto": Sg.pareto,
           "recency": lambda P: Ch.recency_histogram(P, 30, 365), "box": Ch.clv_box_stats,
           "outliers": Ch.clv_outliers, "transactions": lambda P: Ch.transaction_histogram(P, 20)}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_facts_are_read_once(export, name, monkeypatch):
    """The profile is evaluated for one written table; the answer and all passes before it read that table."""
    writes = []
    for fn in ("keep", "sorted_once"):
        plain = getattr(materialize, fn)
        spy = lambda df, *a, plain=plain, **k: (writes.append(explain_text(df, "simple").count("FileScan")), plain(df, *a, **k))[1]
        monkeypatch.setattr(materialize, fn, spy)
        if hasattr(Sg, fn):
            monkeypatch.setattr(Sg, fn, spy)
    jobs = ORDERED[name](export)
    assert len(writes) == 1 and writes[0] > 0
    text = explain_text(jobs, "simple")
    assert "orders.parquet" not in text and "events.parquet" not in text and "customer.parquet" not in text


def test_stored_profiles_are_not_written_again(spark, export, monkeypatch):
    kept, path = materialize.keep(export, "test")
    monkeypatch.setattr(materialize, "keep", lambda *a: pytest.fail("written again"))
    assert Sg.spend_percentiles(kept).count() == 1 and Sg.rfm_quintiles(kept).count() == export.count()
    materialize.forget(spark, path)


def test_pareto_shuffles_rows_once_and_sorts_the_answer(export):
    text = explain_text(Sg.pareto(export), "simple")
    assert text.count("Exchange") == 1 and "Exchange rangepartitioning(__at" in text
    assert "Bucketed: true" in text


def test_pareto_of_ties_nulls_and_no_rows(spark):
    rows = [(i, "x", None if i % 7 == 0 else float(i % 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "customer_id long, customer_name string, total_spent double").repartition(5)
    got = [(r.customer_id, r.cumulative_revenue) for r in Sg.pareto(df).collect()]
    order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    run, want = 0.0, []
    for i, _, v in order:
        run += v or 0.0
        want.append((i, run))
    assert got == want
    assert [r.cumulative_revenue for r in Sg.pareto(df.withColumn("total_spent", F.lit(None).cast("double"))).collect()] == [None] * 500
    assert Sg.pareto(df.limit(0)).collect() == []


def test_release_deletes_the_tables(spark, export):
    import glob
    from custlens.plans.session import checkpoint_dir
    materialize.release()
    base = checkpoint_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{base}/custlens-*"))
    Sg.pareto(export)
    Sg.spend_percentiles(export)
    assert len(set(glob.glob(f"{base}/custlens-*")) - before) == 2
    materialize.release()
    assert set(glob.glob(f"{base}/custlens-*")) == before
