"""Loaded tables (L4 without rescans) and the summaries kept up to date on them."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from custlens.analytics import CustomerAnalytics
from custlens.operators.state import ENG_STATE, SummaryState, eng_partial, eng_summary, merged, tx_partial, tx_summary
from custlens.operators.summaries import eng_by_customer, tx_by_customer
from custlens.plans.checks import explain_text
from custlens.sources import testmap
from custlens.sources.loads import CommitConflict, LoadedTable, open_table
from custlens.sources.schemas import ENGAGEMENT, TRANSACTIONS
from custlens.sources.tables import insert_or_ignore

from .conftest import SF_SMALL


def rows_of(df):
    return sorted(map(str, df.collect()))


def scans_below_exchanges(df, table="custlens_"):
    """Scans of catalog tables of this library that lie below an exchange of the plan."""
    lines = explain_text(df, "simple").splitlines()
    depth = [len(re.match(r"[ :+\-]*", ln).group()) for ln in lines]
    found = 0
    for i, ln in enumerate(lines):
        if "Exchange" in ln:
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                found += "FileScan" in lines[j] and table in lines[j]
    return found


@pytest.fixture()
def target(spark, tmpdir_path):
    with open_table(spark, f"{tmpdir_path}/tx", "transactions", 8) as t:
        yield t


@pytest.fixture(scope="module")
def T(spark):
    return testmap.load(spark, SF_SMALL)[1].cache()


@pytest.fixture(scope="module")
def E(spark):
    return testmap.load(spark, SF_SMALL)[2].cache()


def test_loads_equal_insert_or_ignore(spark, target, T):
    a, b = T.where("transaction_id % 3 < 2"), T.where("transaction_id % 3 > 0").withColumn("amount", F.col("amount") + 1)
    batch = b.unionAll(b.withColumn("amount", F.col("amount") + 7)).unionAll(b.limit(5).withColumn("transaction_id", F.lit(None).cast("long")))
    assert target.insert_or_ignore(a, "a") == a.count()
    want = insert_or_ignore(a, batch, table="transactions")
    assert target.insert_or_ignore(batch, "b") == want.count()
    assert rows_of(target.read()) == rows_of(a.unionAll(want))
    assert target.insert_or_ignore(batch, "b") is None  # the same load again
    assert target.insert_or_ignore(batch, "c") == 0  # the same rows under another name
    assert rows_of(target.read()) == rows_of(a.unionAll(want))
    assert [x.rows for x in target.loads()] == [a.count(), want.count(), 0]
    with open_table(spark, target.path, "transactions", 99) as again:  # any session finds key and buckets
        assert again.buckets == 8 and again.read().count() == target.read().count()
    with pytest.raises(ValueError):
        LoadedTable(spark, target.path, TRANSACTIONS, "customer_id")


def test_empty_loads(target, T):
    assert target.read().count() == 0
    assert target.insert_or_ignore(T.limit(0), "none") == 0
    assert target.insert_or_ignore(T.limit(3), "three") == 3
    assert target.read().count() == 3


def test_target_is_not_shuffled(spark, target, T):
    target.insert_or_ignore(T, "a")
    limit = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = target.new_rows(T, target.loads())
        text = explain_text(plan, "simple")
        assert "LeftAnti" in text and "Bucketed: true" in text
        assert scans_below_exchanges(plan) == 0
        assert re.search(r"ReadSchema: struct<transaction_id:bigint>", text)  # of the target, the key alone
        assert plan.count() == 0
    finally:
        for k, v in limit.items():
            spark.conf.set(k, v)


def test_loads_of_other_key_ranges_are_not_read(target, T):
    target.insert_or_ignore(T, "old")
    later = T.withColumn("transaction_id", F.col("transaction_id") + 10**9)
    target.insert_or_ignore(later, "later")
    plan = explain_text(target.new_rows(later.withColumn("transaction_id", F.col("transaction_id") + 10**9), target.loads()), "simple")
    assert "custlens_" not in plan and "LeftAnti" not in plan
    text = explain_text(target.new_rows(later, target.loads()), "formatted")
    assert "custlens_" in text and re.search(r"PushedFilters: .*GreaterThanOrEqual\(transaction_id", text)
    assert len(target.loads()) == 2
    near = target.new_rows(later, target.loads())
    folder = {x.id: x.folder for x in target.loads()}
    assert near.count() == 0
    files = target._table([x for x in target.loads() if x.id == "later"]).inputFiles()
    assert files and all(folder["later"] in f for f in files)


def test_load_that_died_is_repeated(target, T, monkeypatch):
    target.insert_or_ignore(T.where("transaction_id % 2 = 0"), "a")
    before = rows_of(target.read())
    plain = LoadedTable.commit
    monkeypatch.setattr(LoadedTable, "commit", lambda *a: (_ for _ in ()).throw(OSError("the driver died")))
    with pytest.raises(OSError):
        target.insert_or_ignore(T, "b")
    monkeypatch.setattr(LoadedTable, "commit", plain)
    assert rows_of(target.read()) == before  # its files are there, no version names them
    assert target.insert_or_ignore(T, "b") == T.where("transaction_id % 2 <> 0").count()
    assert rows_of(target.read()) == rows_of(T)
    assert len(target.vacuum()) == 1 and target.vacuum() == []
    assert rows_of(target.read()) == rows_of(T)


def test_two_writers(spark, target, T, monkeypatch):
    """Both load the same new rows; the second to commit starts again and adds only what is still new."""
    plain = LoadedTable.write
    first = []

    def write(self, rows, load_id):
        out = plain(self, rows, load_id)
        if not first:
            first.append(1)
            with open_table(spark, target.path, "transactions") as other:
                other.insert_or_ignore(T.where("transaction_id % 2 = 0"), "other")
        return out

    monkeypatch.setattr(LoadedTable, "write", write)
    assert target.insert_or_ignore(T, "mine") == T.where("transaction_id % 2 <> 0").count()
    assert rows_of(target.read()) == rows_of(T)
    with pytest.raises(CommitConflict):
        target.commit(0, [])


def test_compaction_keeps_rows_and_load_ids(target, T):
    for i in range(3):
        target.insert_or_ignore(T.where(F.col("transaction_id") % 3 == i), f"load{i}")
    old = target.version
    target.compact()
    assert len([x for x in target.loads() if x.rows]) == 1 and rows_of(target.read()) == rows_of(T)
    assert rows_of(target.read(old)) == rows_of(T)
    assert target.insert_or_ignore(T, "load1") is None
    assert target.insert_or_ignore(T, "again") == 0
    assert len(target.vacuum()) == 4  # the three that were folded, and the one without rows
    assert rows_of(target.read()) == rows_of(T)


# -------------------------------------------------------------------- summaries

def close_to(got, want):
    got, want = ({r.customer_id: r.asDict() for r in x.collect()} for x in (got, want))
    assert set(got) == set(want)
    for k, row in want.items():
        assert set(row) == set(got[k])
        for c, v in row.items():
            assert got[k][c] == (pytest.approx(v, rel=1e-12) if isinstance(v, float) else v), (k, c)


def odd_facts(spark, T, E):
    """With rows of no customer, no date, no amount, and dates on both sides of 1970 and of a bit set's border."""
    t = T.unionAll(spark.createDataFrame([(-1, None, None, None, None, None, None), (-2, 5, None, "x", 2.0, 3, "y"),
                                          (-3, 7_000_000, date(1969, 12, 31), "x", None, None, "y")], TRANSACTIONS))
    days = [date(1969, 12, 31), date(1970, 1, 1), date(1970, 3, 5), date(1970, 3, 6), date(1970, 3, 5), None]
    e = E.unionAll(spark.createDataFrame([(-i, 9_000_000, d, 1, 2, 3, i, "Mobile") for i, d in enumerate(days)]
                                         + [(-50, None, None, None, None, None, None, None)], ENGAGEMENT))
    return t, e


def test_state_after_many_loads(spark, tmpdir_path, T, E):
    t, e = odd_facts(spark, T, E)
    with SummaryState(spark, f"{tmpdir_path}/state", 8) as state:
        for i in range(4):
            state.add(f"load{i}", t.where(F.pmod("transaction_id", F.lit(4)) == i), e.where(F.pmod("engagement_id", F.lit(4)) == i))
            state.add(f"load{i}", t, e)  # a repeated load adds nothing
        close_to(state.tx(), tx_by_customer(t))
        close_to(state.eng(), eng_by_customer(e))
        state.compact()
        close_to(state.tx(), tx_by_customer(t))
        close_to(state.eng(), eng_by_customer(e))
        state.add("more", t.withColumn("transaction_id", F.col("transaction_id") + 10**9))
        assert state.tx().agg(F.sum("tx_rows")).first()[0] == 2 * t.count()


def test_state_is_read_without_a_shuffle(spark, tmpdir_path, T, E):
    with SummaryState(spark, f"{tmpdir_path}/state", 8) as state:
        state.add("a", T, E)
        state.add("b", T, E)
        for df in (state.tx(), state.eng()):
            text = explain_text(df, "simple")
            assert "Bucketed: true" in text and "Exchange" not in text


def test_state_that_died_between_its_tables(spark, tmpdir_path, T, E, monkeypatch):
    with SummaryState(spark, f"{tmpdir_path}/state", 4) as state:
        monkeypatch.setattr(state._eng, "append", lambda *a: (_ for _ in ()).throw(OSError("the driver died")))
        with pytest.raises(OSError):
            state.add("a", T, E)
        monkeypatch.undo()
        state.add("a", T, E)
        close_to(state.tx(), tx_by_customer(T))
        close_to(state.eng(), eng_by_customer(E))


def test_partial_rows_merge_in_any_grouping(spark, T, E):
    t, e = odd_facts(spark, T, E)
    parts = [eng_partial(e.where(F.pmod("engagement_id", F.lit(5)) == i)) for i in range(5)]
    left = merged(merged(parts[0].unionAll(parts[1]), ENG_STATE).unionAll(parts[2]), ENG_STATE)
    right = merged(parts[4].unionAll(parts[3]), ENG_STATE)
    close_to(eng_summary(left.unionAll(right)), eng_by_customer(e))
    close_to(tx_summary(tx_partial(t.where("amount > 1000")).unionAll(tx_partial(t.where("NOT amount > 1000 OR amount IS NULL")))), tx_by_customer(t))


def test_facade_answers_from_the_state(spark, tmpdir_path):
    C, T, E = testmap.load(spark, SF_SMALL)
    with SummaryState(spark, f"{tmpdir_path}/state", 4) as state:
        state.add("a", T, E)
        as_of = testmap.AS_OF
        with CustomerAnalytics(C, T.limit(0), E.limit(0), as_of, tx=state.tx(), eng=state.eng()) as kept, CustomerAnalytics(C, T, E, as_of) as plain:
            for question in ("rfm_rules", "customer_transactions", "customer_engagement"):
                assert getattr(kept, question)().count() == getattr(plain, question)().count()
            assert rows_of(kept.rfm_rules().select("customer_id")) == rows_of(plain.rfm_rules().select("customer_id"))
