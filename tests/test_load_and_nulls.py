"""CSV by name and standard quoting, keys at load, null groups, unrounded money, pruned profiles."""

import csv
from datetime import date

import pytest
from pyspark.sql import functions as F

from custlens.analytics import CustomerAnalytics
from custlens.operators import profile as Pr
from custlens.operators import queries as Q
from custlens.plans.checks import bounded, explain_text
from custlens.registry import AS_OF, registry
from custlens.sources.schemas import ENGAGEMENT, TRANSACTIONS
from custlens.sources.sinks import export_profile
from custlens.sources.tables import load_tables, read_profile_csv, read_table

from .conftest import SF_SMALL


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "customers"
    path.mkdir()
    with open(path / "a.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["customer_name", "customer_id", "extra", "email", "signup_date", "country", "customer_segment",
                    "acquisition_channel"])
        w.writerow(['say "hi", x', 1, "?", "a@b.c", "2001-02-29", "X", "S", "C"])
        w.writerow(["b", "no number", "?", "a@b.c", "2001-02-28", "X", "S", "C"])
    rows = read_table(spark, str(path), "customers", "csv").orderBy("customer_name").collect()
    assert [(r.customer_id, r.customer_name, r.signup_date) for r in rows] == [
        (None, "b", date(2001, 2, 28)), (1, 'say "hi", x', None)]
    with open(path / "a.csv", "w") as f:
        f.write("customer_id,customer_name\n1,x\n")
    with pytest.raises(ValueError):
        read_table(spark, str(path), "customers", "csv")
    with pytest.raises(ValueError):
        read_table(spark, str(path), "customers", "jdbc")


def test_export_is_standard_csv(spark, tmp_path):
    P = registry()["p12_process_metrics"](spark, SF_SMALL).limit(5).withColumn("customer_name", F.lit('say "hi", x'))
    export_profile(P, str(tmp_path / "out"))
    lines = [row for f in (tmp_path / "out").glob("*.csv") for row in csv.reader(open(f, newline=""))]
    assert sum(r[1] == 'say "hi", x' for r in lines) == 5
    back = read_profile_csv(spark, str(tmp_path / "out"))
    assert {r.customer_name for r in back.collect()} == {'say "hi", x'} and back.count() == 5


def _facts(spark):
    C = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "S")], "customer_id long, customer_name string, customer_segment string")
    for c, v in (("signup_date", date(2001, 1, 1)), ("country", "X"), ("acquisition_channel", "Y"), ("email", "e")):
        C = C.withColumn(c, F.lit(v))
    T = spark.createDataFrame([(10, 1, date(2001, 7, 1), "p", 1 / 3, 1, "m"), (11, 1, date(2001, 7, 2), "p", 1 / 3, 1, "m")], TRANSACTIONS)
    E = spark.createDataFrame([(1, 2, date(2001, 7, 1), 1, 1, 0, 0, "d"), (2, 2, date(2001, 7, 2), 1, 1, 0, 0, "d")], ENGAGEMENT)
    return C, T, E


def test_null_segment_keeps_its_engagement(spark):
    C, T, E = _facts(spark)
    for frame in (Q.segment_performance(C, T, E), CustomerAnalytics(C, T, E, AS_OF, materialize=False).segment_performance()):
        assert {r.customer_segment: r.total_engagement_days for r in frame.collect()} == {None: 2, "S": 0}
    assert explain_text(Q.segment_performance(C, T, E), "simple").count("engagement_date") > 0


def test_engagement_is_scanned_once(spark):
    text = explain_text(registry()["s15_segment_performance"](spark, SF_SMALL), "formatted")
    assert len([x for x in text.split("\n") if "Location" in x and "events" in x]) <= 2  # one scan, perhaps shown twice


def test_money_is_not_cut(spark):
    C, T, E = _facts(spark)
    assert {r.customer_id: r.total_spent for r in Pr.extract_profile(C, T, E).collect()}[1] == 1 / 3 + 1 / 3
    tiny = T.withColumn("amount", F.lit(1e-12))
    assert {r.customer_id: r.total_spent for r in Pr.extract_profile(C, tiny, E).collect()}[1] == 2e-12


def test_keys_are_enforced_at_load(spark, tmp_path):
    C, T, E = _facts(spark)
    for name, df in (("customers", C), ("transactions", T.unionAll(T)), ("engagement", E)):
        df.write.parquet(str(tmp_path / name))
    tables = load_tables(spark, str(tmp_path), register_views=False)
    assert tables["transactions"].count() == 2
    assert load_tables(spark, str(tmp_path), register_views=False, unique=False)["transactions"].count() == 4


@pytest.mark.parametrize("name", ["a01_shape_and_columns", "a03_value_counts", "c01_customers_by_segment"])
def test_questions_about_customers_read_no_facts(spark, name):
    text = explain_text(registry()[name](spark, SF_SMALL), "formatted")
    assert "customer.parquet" in text and "orders.parquet" not in text and "events.parquet" not in text


@pytest.mark.parametrize("name", ["c07_clv_box_stats", "c07_clv_outliers", "a05_segment_summary"])
def test_customers_are_not_joined_by_shuffling_segments(spark, name):
    import re
    text = explain_text(registry()[name](spark, SF_SMALL), "simple")
    assert not re.search(r"SortMergeJoin \[customer_segment#\d+\], \[customer_segment", text)


def test_a_table_too_large_to_broadcast_is_an_error(spark):
    assert bounded(spark.range(5), 5).count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        bounded(spark.range(5), 4).collect()


def test_kept_tables_can_be_deleted(spark):
    C, T, E = _facts(spark)
    with CustomerAnalytics(C, T, E, AS_OF) as ca:
        assert ca.profile.count() == 3
        paths = list(ca._paths)
        assert paths
    assert not ca._paths
    path = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
