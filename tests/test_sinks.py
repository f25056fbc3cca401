"""Sources and sinks: write to a new temp directory, read back, compare."""

import os

from custlens.operators import profile as Pr
from custlens.operators import reports as R
from custlens.registry import AS_OF
from custlens.sources import testmap
from custlens.sources.schemas import EXPORT_COLUMNS, EXPORT_SHORT_COLUMNS
from custlens.sources.sinks import export_profile, export_profile_short, write_custom_pack, write_reports
from custlens.sources.tables import load_tables, read_profile_csv

from .conftest import SF_SMALL


def test_export_and_read_back(spark, tmpdir_path):
    C, T, E = testmap.load(spark, SF_SMALL)
    P = Pr.build_profile(C, T, E, AS_OF).cache()
    path = export_profile(P, f"{tmpdir_path}/bi_export")
    back = read_profile_csv(spark, path)
    assert back.columns == EXPORT_COLUMNS and back.count() == P.count()
    assert back.exceptAll(P.select(*EXPORT_COLUMNS)).count() == 0
    short = export_profile_short(P, f"{tmpdir_path}/short")
    assert spark.read.option("header", True).csv(short).columns == EXPORT_SHORT_COLUMNS


def test_report_packs(spark, tmpdir_path):
    C, T, E = testmap.load(spark, SF_SMALL)
    P = Pr.build_profile(C, T, E, AS_OF).cache()
    written = write_reports(P, R.generate_reports(P), f"{tmpdir_path}/reports")
    assert set(written) == {"Customer Data", "Segment_Analysis", "Churn_Risk", "Value_Segment", "Channel",
                            "Executive Summary"}
    assert spark.read.parquet(written["Executive Summary"]).count() == 5
    pack = write_custom_pack(P, f"{tmpdir_path}/custom")
    assert spark.read.parquet(pack["Top Customers"]).count() == 20


def test_load_tables_csv_with_bad_dates(spark, tmpdir_path):
    base = f"{tmpdir_path}/tables"
    os.makedirs(base)
    C, T, E = testmap.load(spark, SF_SMALL)
    for name, df in (("customers", C), ("transactions", T), ("engagement", E)):
        df.write.option("header", True).csv(f"{base}/{name}")
    with open(f"{base}/transactions/bad.csv", "w") as fh:
        fh.write("transaction_id,customer_id,transaction_date,product_category,amount,quantity,payment_method\n")
        fh.write("999999,1,2024-02-31,Home,5.0,1,PayPal\n")
    tables = load_tables(spark, base, "csv")
    t = tables["transactions"]
    assert t.count() == T.count() + 1
    assert t.where("transaction_id = 999999").first().transaction_date is None
    assert spark.sql("SELECT COUNT(*) FROM customers").first()[0] == C.count()


def test_streaming_keyed_ingest_is_idempotent(spark, tmpdir_path):
    from custlens.streaming.ingest import keyed_ingest
    C, T, E = testmap.load(spark, SF_SMALL)
    src, target, ckpt = f"{tmpdir_path}/src", f"{tmpdir_path}/target", f"{tmpdir_path}/ckpt"
    T.write.parquet(f"{src}/batch1")
    T.limit(50).write.mode("append").parquet(f"{src}/batch1_dup")  # the same keys again
    q = keyed_ingest(spark, f"{src}/*", "transactions", target, ckpt)
    q.awaitTermination(120)
    out = spark.read.parquet(target)
    assert out.count() == T.count()
    assert out.select("transaction_id").distinct().count() == T.count()


def test_load_tables_json_and_orc(spark, tmpdir_path):
    C, T, E = testmap.load(spark, SF_SMALL)
    for fmt in ("json", "orc"):
        base = f"{tmpdir_path}/{fmt}"
        for name, df in (("customers", C), ("transactions", T), ("engagement", E)):
            df.write.format(fmt).save(f"{base}/{name}")
        tables = load_tables(spark, base, fmt, register_views=False)
        for name, df in (("customers", C), ("transactions", T), ("engagement", E)):
            got = tables[name]
            assert got.columns == df.columns
            assert got.exceptAll(df).count() == 0 and df.exceptAll(got).count() == 0, (fmt, name)
