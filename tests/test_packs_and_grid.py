"""Report packs committed as a whole, and the adaptive grid of the scatter chart."""

import os
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.operators import charts as Ch
from custlens.operators import profile as Pr
from custlens.operators import reports as R
from custlens.plans.checks import explain_text
from custlens.registry import AS_OF
from custlens.sources import testmap
from custlens.sources.sinks import ReportPack

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def profile(spark):
    return Pr.build_profile(*testmap.load(spark, SF_SMALL), AS_OF).cache()


def _sheets(P, note):
    return {"Customer Data": P.select("customer_id", "total_spent"), "Segment_Analysis": R.segment_analysis(P),
            "Note": P.sparkSession.createDataFrame([(note,)], "text string")}


def test_pack_appears_whole_or_not_at_all(spark, profile, tmpdir_path):
    """A run that fails at its third sheet leaves the old pack, which is read whole."""
    pack = ReportPack(spark, f"{tmpdir_path}/pack")
    assert pack.sheets() == {} and pack.versions() == []
    assert pack.commit(_sheets(profile, "old")) == 1
    bad = _sheets(profile, "new")
    bad["Note"] = bad["Note"].select(F.raise_error(F.lit("the third sheet fails")).cast("string").alias("text"))
    with pytest.raises(Exception, match="third sheet"):
        pack.commit(bad)
    again = ReportPack(spark, f"{tmpdir_path}/pack")  # another reader
    assert again.versions() == [1] and again.read("Note").first().text == "old"
    assert {k: v.rows for k, v in again.sheets().items()} == {"Customer Data": profile.count(), "Segment_Analysis": R.segment_analysis(profile).count(), "Note": 1}
    assert again.read("Segment_Analysis").exceptAll(R.segment_analysis(profile)).count() == 0
    assert pack.commit(_sheets(profile, "new"), "csv") == 2
    assert pack.read("Note").first().text == "new" and pack.read("Note", 1).first().text == "old"
    assert pack.read("Customer Data").count() == profile.count()


def test_old_packs_and_failed_runs_are_removed(spark, profile, tmpdir_path):
    pack = ReportPack(spark, f"{tmpdir_path}/pack")
    for note in ("a", "b", "c"):
        pack.commit({"Note": _sheets(profile, note)["Note"]})
    with pytest.raises(Exception):
        pack.commit({"Note": _sheets(profile, "d")["Note"], "Bad": profile.select(F.raise_error(F.lit("no")).cast("string").alias("text"))})
    assert len([d for d in os.listdir(pack.path) if d.startswith("pack-")]) == 4
    assert pack.keep(2) == [1] and pack.versions() == [2, 3]
    assert len([d for d in os.listdir(pack.path) if d.startswith("pack-")]) == 2
    assert pack.read("Note").first().text == "c" and pack.read("Note", 2).first().text == "b"
    with pytest.raises(ValueError):
        pack.keep(0)


# ------------------------------------------------------------------------ grid

def brute_grid(points, most, depth):
    """(level, cell_x, cell_y) -> (customers, mean) by parting cells one after the other."""
    points = [p for p in points if p[0] is not None and p[1] is not None]
    lo = [min(p[i] for p in points) for i in (0, 1)]
    hi = [max(p[i] for p in points) for i in (0, 1)]
    at = [tuple(0 if hi[i] == lo[i] else min(int((p[i] - lo[i]) / (hi[i] - lo[i]) * 2**depth), 2**depth - 1) for i in (0, 1)) for p in points]
    out, todo = {}, [(0, 0, 0, list(range(len(points))))]
    while todo:
        level, x, y, own = todo.pop()
        if len(own) <= most or level == depth:
            e = [points[k][2] for k in own if points[k][2] is not None]
            out[level, x, y] = (len(own), sum(e) / len(e) if e else None)
            continue
        below = {}
        for k in own:
            below.setdefault(tuple(v >> (depth - level - 1) for v in at[k]), []).append(k)
        todo += [(level + 1, *cell, ks) for cell, ks in below.items()]
    return out


@pytest.mark.parametrize("most,depth", [(10, 5), (1, 3), (10_000, 8), (0, 2), (5, 0)])
def test_grid_equals_parting_cell_by_cell(spark, most, depth):
    rng = np.random.default_rng(4)
    n = 600
    x = np.where(rng.random(n) < 0.3, 0.0, rng.lognormal(0, 2, n)).tolist()
    y = np.where(rng.random(n) < 0.3, 5.0, rng.lognormal(5, 2, n)).tolist()
    e = rng.random(n).tolist()
    x[3] = y[4] = e[5] = None
    points = list(zip(x, y, e))
    df = spark.createDataFrame(points, "purchase_frequency double, total_spent double, engagement_score double")
    got = {(r.level, r.cell_x, r.cell_y): r for r in Ch.spend_frequency_grid(df, most, depth).collect()}
    want = brute_grid(points, most, depth)
    assert set(got) == set(want) and sum(r.customers for r in got.values()) == n - 2
    for k, (count, mean) in want.items():
        r = got[k]
        assert r.customers == count and r.engagement_mean == (None if mean is None else pytest.approx(mean))
        assert r.frequency_from < r.frequency_to and r.spend_from < r.spend_to
    inside = [r for r in got.values() for p in points if p[0] is not None and p[1] is not None
              and r.frequency_from <= p[0] < r.frequency_to and r.spend_from <= p[1] < r.spend_to]
    assert len(inside) >= (n - 2) * 0.95  # but for the upper borders of the whole square, each point is in its cell


def test_grid_of_one_point_and_none(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)] * 50, "purchase_frequency double, total_spent double, engagement_score double")
    assert [(r.level, r.customers, r.engagement_mean) for r in Ch.spend_frequency_grid(df, 10, 3).collect()] == [(3, 50, 3.0)]
    assert Ch.spend_frequency_grid(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        Ch.spend_frequency_grid(df, depth=11)


def test_grid_reads_the_facts_once(spark):
    P = Pr.build_profile(*testmap.load(spark, SF_SMALL), AS_OF + timedelta(days=1))  # not the cached frame of this module
    text = explain_text(Ch.spend_frequency_grid(P, 20, 6), "simple")
    assert "orders.parquet" not in text and "events.parquet" not in text
