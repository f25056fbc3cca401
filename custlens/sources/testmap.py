"""Mapping of the driver's TPC-H-style test tables onto customers /
transactions / engagement (see FIXTURES.md §2).

Columns with no source column (email, signup date, channel, quantity,
page views, ...) are derived deterministically from keys so that the
Spark mapping and the SQL oracle mapping produce identical tables.
Every row of customer, orders and events is used: transactions are all
orders (FIXTURES.md §2 restricted them to 2001; the whole table is used
here so every query's work grows with the data).  Every customer of the
test tables has an order, so all suppliers are added as customers who never
buy (ids shifted by ``NO_PURCHASE_IDS``); some customers of either kind have no segment
or no channel.  That keeps the no-purchase and null-group paths busy.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Evaluation time of every as-of operator on the test tables
# (noon on purpose, so fractional-day rules differ from whole-day ones).
AS_OF = datetime(2001, 8, 2, 12, 0, 0)
SIGNUP_ANCHOR = date(2001, 8, 2)
NO_PURCHASE_IDS = 1_000_000_000

# Channel label by c_custkey % 5, device label by event_id % 3.
CHANNELS = ["Organic Search", "Social Media", "Email", "Referral", "Paid Ads"]
DEVICES = ["Mobile", "Desktop", "Tablet"]


def _label(col, labels):
    """CASE col WHEN 0 THEN labels[0] ... ELSE labels[-1] END."""
    expr = None
    for i, lab in enumerate(labels[:-1]):
        expr = (F.when(col == i, lab) if expr is None else expr.when(col == i, lab))
    return expr.otherwise(labels[-1])


def customers(customer: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    """All customers, and all suppliers as customers without purchases."""
    buyers = customer.select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.when(F.col("c_custkey") % 50 != 0, F.col("c_mktsegment")).alias("segment"),
        _label(F.col("c_custkey") % 5, CHANNELS).alias("channel"))
    others = supplier.select(
        (F.col("s_suppkey") + NO_PURCHASE_IDS).alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
        F.when(F.col("s_suppkey") % 3 == 1, "BUILDING").when(F.col("s_suppkey") % 3 == 2, "MACHINERY").alias("segment"),
        F.when(F.col("s_suppkey") % 4 != 0, _label(F.col("s_suppkey") % 5, CHANNELS)).alias("channel"))
    key = F.col("key")
    # nation is the fixed 25-row TPC-H dimension: a proven size bound, so it
    # is broadcast and the customer scan never shuffles for this join.
    return (buyers.union(others).join(F.broadcast(nation), F.col("nation") == F.col("n_nationkey"))
            .select(
                key.alias("customer_id"),
                F.col("name").alias("customer_name"),
                F.concat(F.lit("customer"), key.cast("string"), F.lit("@email.com")).alias("email"),
                F.date_sub(F.lit(SIGNUP_ANCHOR), (F.lit(30) + (key * 37) % 700).cast("int")).alias("signup_date"),
                F.col("n_name").alias("country"),
                F.col("segment").alias("customer_segment"),
                F.col("channel").alias("acquisition_channel")))


def transactions(orders: DataFrame) -> DataFrame:
    """Every order is a transaction (the whole table; no date window)."""
    return (orders
            .select(
                F.col("o_orderkey").alias("transaction_id"),
                F.col("o_custkey").alias("customer_id"),
                F.col("o_orderdate").cast("date").alias("transaction_date"),
                F.col("o_orderpriority").alias("product_category"),
                F.col("o_totalprice").alias("amount"),
                (F.col("o_orderkey") % 4 + 1).cast("int").alias("quantity"),
                F.col("o_orderstatus").alias("payment_method")))


def engagement(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    etype = F.col("event_type")
    return events.select(
        eid.alias("engagement_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").cast("date").alias("engagement_date"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 49 + 1).alias("page_views"),
        (F.floor("value").cast("int") % 118 + 2).alias("session_duration_minutes"),
        F.when(etype == "click", (eid % 8).cast("int")).otherwise(0).alias("items_added_to_cart"),
        F.when(etype == "purchase", (eid % 4).cast("int")).otherwise(0).alias("items_purchased"),
        _label(eid % 3, DEVICES).alias("device_type"))


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(customers, transactions, engagement) over the parquet test tables."""
    rd = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return (customers(rd("customer"), rd("nation"), rd("supplier")),
            transactions(rd("orders")),
            engagement(rd("events")))


def uncut(spark: SparkSession, sf_dir: str, T: DataFrame) -> DataFrame:
    """Transactions with the discounted sum of an order's lines as amount, which is not a whole number of cents."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("transaction_id")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    return T.drop("amount").join(lines, "transaction_id", "left").select(*T.columns)


# The same mapping as SQL (DuckDB dialect), used as the head of every oracle.
ORACLE_CTE = """
people AS (
  SELECT c_custkey AS id, c_custkey AS k, c_name AS name, c_nationkey AS nk,
         CASE WHEN c_custkey % 50 <> 0 THEN c_mktsegment END AS segment, TRUE AS has_channel FROM customer
  UNION ALL
  SELECT s_suppkey + 1000000000, s_suppkey, s_name, s_nationkey,
         CASE s_suppkey % 3 WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'MACHINERY' END, s_suppkey % 4 <> 0 FROM supplier),
customers AS (
  SELECT id AS customer_id, name AS customer_name, concat('customer', CAST(id AS VARCHAR(20)), '@email.com') AS email,
         DATE '2001-08-02' - CAST(30 + (id * 37) % 700 AS INT) AS signup_date,
         n_name AS country, segment AS customer_segment,
         CASE WHEN has_channel THEN CASE k % 5 WHEN 0 THEN 'Organic Search' WHEN 1 THEN 'Social Media' WHEN 2 THEN 'Email'
                                               WHEN 3 THEN 'Referral' ELSE 'Paid Ads' END END AS acquisition_channel
  FROM people JOIN nation ON nk = n_nationkey),
transactions AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS transaction_date,
         o_orderpriority AS product_category, o_totalprice AS amount,
         CAST(o_orderkey % 4 + 1 AS INT) AS quantity, o_orderstatus AS payment_method
  FROM orders),
engagement AS (
  SELECT event_id AS engagement_id, user_id AS customer_id, CAST(ts AS DATE) AS engagement_date,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 49 + 1 AS page_views,
         CAST(floor(value) AS INT) % 118 + 2 AS session_duration_minutes,
         CASE WHEN event_type = 'click' THEN CAST(event_id % 8 AS INT) ELSE 0 END AS items_added_to_cart,
         CASE WHEN event_type = 'purchase' THEN CAST(event_id % 4 AS INT) ELSE 0 END AS items_purchased,
         CASE event_id % 3 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Desktop' ELSE 'Tablet' END AS device_type
  FROM events)"""
