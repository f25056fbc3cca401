"""Fixed schemas of the three input tables and of the exported profile (L1).

Dates are ``DateType``; the reference stores them as ``YYYY-MM-DD`` text,
which is parsed once at load with ``try_to_date`` (bad text -> null).
"""

from pyspark.sql import types as T

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("customer_name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("signup_date", T.DateType()),
    T.StructField("country", T.StringType()),
    T.StructField("customer_segment", T.StringType()),
    T.StructField("acquisition_channel", T.StringType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.LongType(), False),
    T.StructField("customer_id", T.LongType()),
    T.StructField("transaction_date", T.DateType()),
    T.StructField("product_category", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("payment_method", T.StringType()),
])

ENGAGEMENT = T.StructType([
    T.StructField("engagement_id", T.LongType(), False),
    T.StructField("customer_id", T.LongType()),
    T.StructField("engagement_date", T.DateType()),
    T.StructField("page_views", T.IntegerType()),
    T.StructField("session_duration_minutes", T.IntegerType()),
    T.StructField("items_added_to_cart", T.IntegerType()),
    T.StructField("items_purchased", T.IntegerType()),
    T.StructField("device_type", T.StringType()),
])

# CSV dialect of sources and sinks: header, doubled quotes inside quoted fields.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}

# Primary keys (insert-or-ignore identity, see sources.tables.insert_or_ignore).
PRIMARY_KEYS = {
    "customers": "customer_id",
    "transactions": "transaction_id",
    "engagement": "engagement_id",
}

TABLE_SCHEMAS = {
    "customers": CUSTOMERS,
    "transactions": TRANSACTIONS,
    "engagement": ENGAGEMENT,
}

DATE_COLUMNS = {
    "customers": ["signup_date"],
    "transactions": ["transaction_date"],
    "engagement": ["engagement_date"],
}

# The 15 columns of the BI export, in the reference's order.
EXPORT_COLUMNS = [
    "customer_id", "customer_name", "country", "customer_segment",
    "acquisition_channel", "total_transactions", "total_spent", "purchase_frequency",
    "days_since_last_purchase", "engagement_score", "clv_estimate",
    "churn_risk", "value_segment", "conversion_rate", "tenure_months",
]

# The 12 columns of the short BI export, in the reference's order.
EXPORT_SHORT_COLUMNS = [
    "customer_id", "customer_name", "country", "customer_segment",
    "acquisition_channel", "total_transactions", "total_spent",
    "purchase_frequency", "engagement_score", "clv_estimate",
    "churn_risk", "value_segment",
]

PROFILE_CSV = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("customer_segment", T.StringType()),
    T.StructField("acquisition_channel", T.StringType()),
    T.StructField("total_transactions", T.LongType()),
    T.StructField("total_spent", T.DoubleType()),
    T.StructField("purchase_frequency", T.DoubleType()),
    T.StructField("days_since_last_purchase", T.IntegerType()),
    T.StructField("engagement_score", T.DoubleType()),
    T.StructField("clv_estimate", T.DoubleType()),
    T.StructField("churn_risk", T.StringType()),
    T.StructField("value_segment", T.StringType()),
    T.StructField("conversion_rate", T.DoubleType()),
    T.StructField("tenure_months", T.DoubleType()),
])
