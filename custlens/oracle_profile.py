"""Oracles for the profile families (P, R, A, C), DuckDB dialect.

``PROFILE_CTES`` rebuilds the profile the reference's way: the literal
customers ⟕ transactions ⟕ engagement join grouped by customer (fan-out
included), then ``fillna(0)``, day counts against the fixed ``as_of``,
and the metric formulas.  Every question of the R/A/C families is then
plain SQL over ``profile`` (or ``export``, its 15 exported columns, which
is what the tutorial reads back from CSV).
"""

from __future__ import annotations

from .oracle import B, DAYS, M

PROFILE_CTES = f"""
raw AS (
  SELECT c.customer_id, c.customer_name, c.signup_date, c.country, c.customer_segment, c.acquisition_channel,
         COUNT(DISTINCT t.transaction_id) AS total_transactions,
         fsum(t.amount) AS total_spent,
         favg(t.amount) AS avg_transaction_value,
         CAST(SUM(t.quantity) AS BIGINT) AS total_items,
         MAX(t.transaction_date) AS last_purchase_date,
         COUNT(DISTINCT e.engagement_date) AS engagement_days,
         AVG(e.page_views) AS avg_page_views,
         CAST(SUM(e.items_added_to_cart) AS BIGINT) AS total_cart_adds,
         CAST(SUM(CASE WHEN e.items_purchased > 0 THEN 1 ELSE 0 END) AS BIGINT) AS days_with_purchase
  FROM customers c
  LEFT JOIN transactions t ON c.customer_id = t.customer_id
  LEFT JOIN engagement e ON c.customer_id = e.customer_id
  GROUP BY c.customer_id, c.customer_name, c.signup_date, c.country, c.customer_segment, c.acquisition_channel),
m0 AS (
  SELECT customer_id, coalesce(customer_name, 'Unknown') AS customer_name, signup_date,
         coalesce(country, 'Unknown') AS country, coalesce(customer_segment, 'Unknown') AS customer_segment,
         coalesce(acquisition_channel, 'Unknown') AS acquisition_channel,
         total_transactions, coalesce(total_spent, 0) AS total_spent,
         coalesce(avg_transaction_value, 0) AS avg_transaction_value, coalesce(total_items, 0) AS total_items,
         last_purchase_date, engagement_days, coalesce(avg_page_views, 0) AS avg_page_views,
         coalesce(total_cart_adds, 0) AS total_cart_adds, days_with_purchase,
         {DAYS("signup_date")} AS days_since_signup,
         coalesce({DAYS("last_purchase_date")}, 999) AS days_since_last_purchase
  FROM raw),
m1 AS (
  SELECT *, days_since_signup / 30.0::DOUBLE AS tenure_months,
         total_transactions / (CASE WHEN days_since_signup IS NULL THEN NULL
                                    ELSE GREATEST(days_since_signup / 30.0::DOUBLE, 1) END) AS purchase_frequency,
         total_spent / GREATEST(total_transactions, 1) AS avg_order_value,
         coalesce(days_with_purchase / GREATEST(engagement_days, 1) * 100, 0) AS conversion_rate
  FROM m0),
m2 AS (
  SELECT *,
         LEAST(GREATEST(avg_page_views / 50 * (conversion_rate / 100) * 100, 0), 100) AS engagement_score,
         avg_order_value * purchase_frequency * 12 * 3 AS clv_estimate,
         CASE WHEN days_since_last_purchase < 30 AND purchase_frequency > 2 THEN 'Low'
              WHEN days_since_last_purchase < 90 AND purchase_frequency > 1 THEN 'Medium'
              WHEN days_since_last_purchase < 180 THEN 'High'
              WHEN days_since_last_purchase >= 180 THEN 'Critical'
              ELSE 'Unknown' END AS churn_risk
  FROM m1),
profile AS (
  SELECT *,
         CASE WHEN total_spent > (SELECT favg(total_spent) FROM m2)
                   AND purchase_frequency > (SELECT favg(purchase_frequency) FROM m2) THEN 'Star Customer'
              WHEN total_spent > (SELECT favg(total_spent) FROM m2) THEN 'Big Spender'
              WHEN purchase_frequency > (SELECT favg(purchase_frequency) FROM m2) THEN 'Frequent Buyer'
              ELSE 'Development' END AS value_segment
  FROM m2),
export AS (
  SELECT customer_id, customer_name, country, customer_segment, acquisition_channel, total_transactions,
         total_spent, purchase_frequency, days_since_last_purchase, engagement_score, clv_estimate,
         churn_risk, value_segment, conversion_rate, tenure_months
  FROM profile)"""

PROFILE_DOUBLES = ["total_spent", "avg_transaction_value", "avg_page_views", "tenure_months",
                   "purchase_frequency", "avg_order_value", "conversion_rate", "engagement_score",
                   "clv_estimate"]

F: dict[str, tuple[str, list[str]]] = {}

# ------------------------------------------------------------------ profile
F["p01_extract_profile"] = ("""
SELECT customer_id, customer_name, signup_date, country, customer_segment, acquisition_channel,
       total_transactions, total_spent, avg_transaction_value, total_items, last_purchase_date,
       engagement_days, avg_page_views, total_cart_adds, days_with_purchase
FROM raw""", ["total_spent", "avg_transaction_value", "avg_page_views"])

F["p01_extract_profile_dedup"] = ("""
SELECT c.customer_id, c.customer_name, c.signup_date, c.country, c.customer_segment, c.acquisition_channel,
       coalesce(t.n, 0) AS total_transactions, t.s AS total_spent, t.a AS avg_transaction_value,
       t.q AS total_items, t.last AS last_purchase_date, coalesce(e.days, 0) AS engagement_days,
       e.apv AS avg_page_views, e.cart AS total_cart_adds, coalesce(e.pr, 0) AS days_with_purchase
FROM customers c
LEFT JOIN (SELECT customer_id, COUNT(DISTINCT transaction_id) AS n, fsum(amount) AS s, favg(amount) AS a,
                  CAST(SUM(quantity) AS BIGINT) AS q, MAX(transaction_date) AS last
           FROM transactions GROUP BY customer_id) t ON t.customer_id = c.customer_id
LEFT JOIN (SELECT customer_id, COUNT(DISTINCT engagement_date) AS days, AVG(page_views) AS apv,
                  CAST(SUM(items_added_to_cart) AS BIGINT) AS cart,
                  CAST(SUM(CASE WHEN items_purchased > 0 THEN 1 ELSE 0 END) AS BIGINT) AS pr
           FROM engagement GROUP BY customer_id) e ON e.customer_id = c.customer_id""",
    ["total_spent", "avg_transaction_value", "avg_page_views"])

F["p01_extract_profile_uncut"] = F["p01_extract_profile"]

F["l05_export"] = ("SELECT * FROM export", [
    "total_spent", "purchase_frequency", "engagement_score", "clv_estimate", "conversion_rate", "tenure_months"])

F["l06_export_short"] = ("SELECT * EXCLUDE (days_since_last_purchase, conversion_rate, tenure_months) FROM export", [
    "total_spent", "purchase_frequency", "engagement_score", "clv_estimate"])

F["p12_process_metrics"] = ("SELECT * FROM profile", PROFILE_DOUBLES)

F["p13_churn_risk"] = ("""
SELECT customer_id, days_since_last_purchase, purchase_frequency, churn_risk FROM profile""",
    ["purchase_frequency"])

F["p14_value_segment"] = ("""
SELECT customer_id, total_spent, purchase_frequency, value_segment FROM profile""",
    ["total_spent", "purchase_frequency"])

# ------------------------------------------------------------------ reports
F["r01_segment_analysis"] = (f"""
SELECT customer_segment, COUNT(customer_id) AS customer_id_count,
       {B("fsum(total_spent)")} AS total_spent_sum, {B("favg(total_spent)")} AS total_spent_mean,
       {B("favg(purchase_frequency)")} AS purchase_frequency_mean,
       {B("favg(engagement_score)")} AS engagement_score_mean
FROM profile GROUP BY customer_segment""",
    ["total_spent_sum", "total_spent_mean", "purchase_frequency_mean", "engagement_score_mean"])

F["r02_churn_risk_report"] = (f"""
SELECT churn_risk, COUNT(customer_id) AS customer_id_count,
       {B("favg(total_spent)")} AS total_spent_mean, {B("favg(engagement_score)")} AS engagement_score_mean
FROM profile GROUP BY churn_risk""", ["total_spent_mean", "engagement_score_mean"])

F["r03_value_segment_report"] = (f"""
SELECT value_segment, COUNT(customer_id) AS customer_id_count,
       {B("fsum(total_spent)")} AS total_spent_sum, {B("favg(total_spent)")} AS total_spent_mean,
       {B("favg(purchase_frequency)")} AS purchase_frequency_mean
FROM profile GROUP BY value_segment""", ["total_spent_sum", "total_spent_mean", "purchase_frequency_mean"])

F["r04_channel_report"] = (f"""
SELECT acquisition_channel, COUNT(customer_id) AS customer_id_count,
       {B("fsum(total_spent)")} AS total_spent_sum, {B("favg(total_spent)")} AS total_spent_mean,
       {B("favg(engagement_score)")} AS engagement_score_mean
FROM profile GROUP BY acquisition_channel""", ["total_spent_sum", "total_spent_mean", "engagement_score_mean"])

_MONEY = "'₹' || format('{{:,.0f}}', {x})"

F["r05_executive_summary"] = (f"""
SELECT Metric, Value FROM (
  SELECT 1 AS k, 'Total Customers' AS Metric, CAST(COUNT(*) AS VARCHAR) AS Value FROM profile
  UNION ALL SELECT 2, 'Total Revenue', {_MONEY.format(x="fsum(total_spent)")} FROM profile
  UNION ALL SELECT 3, 'Avg Customer Value', {_MONEY.format(x="favg(total_spent)")} FROM profile
  UNION ALL SELECT 4, 'Avg Engagement Score', format('{{:,.1f}}', favg(engagement_score)) FROM profile
  UNION ALL SELECT 5, 'Critical Risk Count', CAST(COUNT(*) FILTER (WHERE churn_risk = 'Critical') AS VARCHAR)
            FROM profile) ORDER BY k""", [])

F["r06_custom_summary"] = (f"""
SELECT Metric, Value FROM (
  SELECT 1 AS k, 'Total Customers' AS Metric, CAST(COUNT(*) AS VARCHAR) AS Value FROM profile
  UNION ALL SELECT 2, 'Total Revenue', {_MONEY.format(x="fsum(total_spent)")} FROM profile
  UNION ALL SELECT 3, 'Avg Customer Value', {_MONEY.format(x="favg(total_spent)")} FROM profile
  UNION ALL SELECT 4, 'Critical Risk', CAST(COUNT(*) FILTER (WHERE churn_risk = 'Critical') AS VARCHAR)
            FROM profile) ORDER BY k""", [])

F["r07_top_by_spend"] = ("""
SELECT customer_name, customer_segment, total_spent, clv_estimate, churn_risk
FROM profile ORDER BY total_spent DESC, customer_id LIMIT 20""", ["total_spent", "clv_estimate"])

F["r08_at_risk"] = ("""
SELECT customer_name, total_spent, days_since_last_purchase, engagement_score
FROM profile WHERE churn_risk IN ('High', 'Critical') ORDER BY customer_id""",
    ["total_spent", "engagement_score"])

F["r09_segment_engagement"] = (f"""
SELECT customer_segment, COUNT(customer_id) AS customer_id_count,
       {B("fsum(total_spent)")} AS total_spent_sum, {B("favg(total_spent)")} AS total_spent_mean,
       {B("favg(engagement_score)")} AS engagement_score_mean
FROM export GROUP BY customer_segment""", ["total_spent_sum", "total_spent_mean", "engagement_score_mean"])

F["r10_key_statistics"] = (f"""
SELECT COUNT(*) AS total_customers, fsum(total_spent) AS total_revenue, favg(total_spent) AS avg_customer_value,
       {B("favg(purchase_frequency)")} AS avg_purchase_frequency,
       {B("favg(engagement_score)", 1)} AS avg_engagement_score,
       COUNT(*) FILTER (WHERE churn_risk = 'Critical') AS critical_risk_customers,
       COUNT(*) FILTER (WHERE value_segment = 'Star Customer') AS star_customers
FROM profile""", ["total_revenue", "avg_customer_value", "avg_purchase_frequency", "avg_engagement_score"])

# --------------------------------------------------------- tutorial analytics
F["a01_shape_and_columns"] = ("SELECT COUNT(*) AS rows, CAST(15 AS BIGINT) AS columns FROM export", [])

_DESC_COLS = ["total_spent", "purchase_frequency", "engagement_score"]


def _describe_sql() -> str:
    stats = [("count", "CAST(COUNT({c}) AS DOUBLE)"), ("mean", "AVG({c})"), ("std", "STDDEV_SAMP({c})"),
             ("min", "CAST(MIN({c}) AS DOUBLE)"), ("25%", "quantile_cont({c}, 0.25)"),
             ("50%", "quantile_cont({c}, 0.5)"), ("75%", "quantile_cont({c}, 0.75)"),
             ("max", "CAST(MAX({c}) AS DOUBLE)")]
    parts = []
    for name, tmpl in stats:
        cols = ", ".join(f"{tmpl.format(c=c)} AS {c}" for c in _DESC_COLS)
        parts.append(f"SELECT '{name}' AS statistic, {cols} FROM export")
    return "\nUNION ALL ".join(parts)


F["a02_describe"] = (_describe_sql(), _DESC_COLS)

F["a03_value_counts"] = ("""
SELECT customer_segment, COUNT(*) AS count FROM export WHERE customer_segment IS NOT NULL
GROUP BY customer_segment ORDER BY count DESC""", [])

F["a04_high_value"] = ("""
SELECT customer_name, total_spent, churn_risk FROM export
WHERE total_spent > 100000 ORDER BY customer_id""", ["total_spent"])

F["a05_segment_summary"] = (f"""
SELECT customer_segment, COUNT(customer_id) AS customer_id_count,
       {B("fsum(total_spent)")} AS total_spent_sum, {B("favg(total_spent)")} AS total_spent_mean,
       {M("quantile_cont(total_spent, 0.5)", half_even=True)} AS total_spent_median
FROM profile GROUP BY customer_segment""", ["total_spent_sum", "total_spent_mean", "total_spent_median"])

F["a06_segment_by_churn_pivot"] = ("""
SELECT customer_segment,
       fsum(CASE WHEN churn_risk = 'Critical' THEN total_spent END) AS "Critical",
       fsum(CASE WHEN churn_risk = 'High' THEN total_spent END) AS "High",
       fsum(CASE WHEN churn_risk = 'Low' THEN total_spent END) AS "Low",
       fsum(CASE WHEN churn_risk = 'Medium' THEN total_spent END) AS "Medium"
FROM export GROUP BY customer_segment""", ["Critical", "High", "Low", "Medium"])

F["a07_top_by_clv"] = ("""
SELECT customer_name, total_spent, clv_estimate FROM export WHERE clv_estimate IS NOT NULL
ORDER BY clv_estimate DESC, customer_id LIMIT 10""", ["total_spent", "clv_estimate"])

F["a08_spend_percentiles"] = ("""
SELECT quantile_cont(total_spent, 0.25) AS p25, quantile_cont(total_spent, 0.5) AS p50,
       quantile_cont(total_spent, 0.75) AS p75 FROM export""", ["p25", "p50", "p75"])

F["a09_spending_categories"] = ("""
SELECT spending_category, COUNT(*) AS count FROM (
  SELECT CASE WHEN total_spent > 200000 THEN 'Premium' WHEN total_spent > 100000 THEN 'Gold'
              WHEN total_spent > 50000 THEN 'Silver' ELSE 'Bronze' END AS spending_category FROM export)
GROUP BY spending_category ORDER BY count DESC""", [])

F["a10_segment_gap"] = ("""
SELECT 'BUILDING' AS segment_a, 'AUTOMOBILE' AS segment_b,
       favg(CASE WHEN customer_segment = 'BUILDING' THEN total_spent END) AS mean_a,
       favg(CASE WHEN customer_segment = 'AUTOMOBILE' THEN total_spent END) AS mean_b,
       favg(CASE WHEN customer_segment = 'BUILDING' THEN total_spent END)
         - favg(CASE WHEN customer_segment = 'AUTOMOBILE' THEN total_spent END) AS difference
FROM export""", ["mean_a", "mean_b", "difference"])

F["a11_rfm_quintiles"] = ("""
SELECT customer_name, R_score, F_score, M_score,
       CAST(R_score AS VARCHAR) || CAST(F_score AS VARCHAR) || CAST(M_score AS VARCHAR) AS RFM_Score
FROM (SELECT customer_name,
             CAST(5 - len(list_filter(r, lambda x: x < days_since_last_purchase)) AS INT) AS R_score,
             CAST(1 + len(list_filter(f, lambda x: x < place)) AS INT) AS F_score,
             CAST(1 + len(list_filter(m, lambda x: x < total_spent)) AS INT) AS M_score
      FROM (SELECT *, row_number() OVER (ORDER BY purchase_frequency, customer_id) AS place FROM export)
      CROSS JOIN (SELECT quantile_cont(days_since_last_purchase, [0.2, 0.4, 0.6, 0.8]) AS r,
                         quantile_cont(total_spent, [0.2, 0.4, 0.6, 0.8]) AS m,
                         quantile_cont(place, [0.2, 0.4, 0.6, 0.8]) AS f
                  FROM (SELECT *, row_number() OVER (ORDER BY purchase_frequency, customer_id) AS place FROM export)))""", [])

_HEALTH = ("((engagement_score / 100 * 0.3) + (1 - (days_since_last_purchase / "
           "NULLIF((SELECT MAX(days_since_last_purchase) FROM export), 0)) * 0.4) + "
           "((purchase_frequency / NULLIF((SELECT MAX(purchase_frequency) FROM export), 0)) * 0.3)) * 100")

F["a12_health_scores"] = (f"""
SELECT customer_name, {B(_HEALTH)} AS health_score FROM export ORDER BY customer_id""", ["health_score"])

F["a12_top_health"] = (f"""
SELECT customer_name, health_score FROM (
  SELECT customer_id, customer_name, {B(_HEALTH)} AS health_score FROM export)
WHERE health_score IS NOT NULL ORDER BY health_score DESC, customer_id LIMIT 10""", ["health_score"])

F["a13_churn_signals"] = ("""
SELECT customer_name, total_spent, days_since_last_purchase, engagement_score FROM export
WHERE days_since_last_purchase > 60 AND engagement_score < 50 AND purchase_frequency < 1
ORDER BY customer_id""", ["total_spent", "engagement_score"])

F["a14_pareto"] = ("""
SELECT * EXCLUDE (spend_rank, running),
       round(running, 2) AS cumulative_revenue,
       round(100.0::DOUBLE * (running / NULLIF((SELECT fsum(total_spent) FROM export), 0)), 6) AS cumulative_pct
FROM (SELECT *, row_number() OVER w AS spend_rank,
             fsum(total_spent) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
      FROM export WINDOW w AS (ORDER BY total_spent DESC NULLS LAST, customer_id))
ORDER BY spend_rank""", ["total_spent", "purchase_frequency", "engagement_score", "clv_estimate",
                         "conversion_rate", "tenure_months", "cumulative_revenue", "cumulative_pct"])

F["a15_top_share"] = ("""
SELECT CAST(floor((SELECT COUNT(*) FROM export) * 0.2) AS BIGINT) AS top_customers,
       fsum(CASE WHEN rk <= floor((SELECT COUNT(*) FROM export) * 0.2) THEN total_spent ELSE 0.0 END) AS top_revenue,
       100.0::DOUBLE * (fsum(CASE WHEN rk <= floor((SELECT COUNT(*) FROM export) * 0.2) THEN total_spent ELSE 0.0 END)
                        / NULLIF((SELECT fsum(total_spent) FROM export), 0)) AS top_revenue_pct
FROM (SELECT total_spent, row_number() OVER (ORDER BY total_spent DESC NULLS LAST, customer_id) AS rk
      FROM export)""", ["top_revenue", "top_revenue_pct"])

F["a16_channel_roi"] = (f"""
SELECT acquisition_channel, COUNT(customer_id) AS customer_id_count,
       {B("fsum(total_spent)")} AS total_spent_sum, {B("favg(total_spent)")} AS total_spent_mean,
       {B("favg(engagement_score)")} AS engagement_score_mean,
       COUNT(*) FILTER (WHERE churn_risk = 'Critical') AS churn_risk_critical
FROM export GROUP BY acquisition_channel""", ["total_spent_sum", "total_spent_mean", "engagement_score_mean"])

F["a17_retention_by_tenure"] = (f"""
SELECT tenure_band, customers, avg_spent, critical_risk_pct FROM (
  SELECT band_index, tenure_band, COUNT(customer_id) AS customers, {B("favg(total_spent)")} AS avg_spent,
         {B("COUNT(*) FILTER (WHERE churn_risk = 'Critical') / COUNT(*) * 100")} AS critical_risk_pct
  FROM (SELECT *, CASE WHEN tenure_months > 0 AND tenure_months <= 3 THEN 0
                       WHEN tenure_months > 3 AND tenure_months <= 6 THEN 1
                       WHEN tenure_months > 6 AND tenure_months <= 12 THEN 2
                       WHEN tenure_months > 12 AND tenure_months <= 24 THEN 3
                       WHEN tenure_months > 24 AND tenure_months <= 100 THEN 4 END AS band_index,
                  CASE WHEN tenure_months > 0 AND tenure_months <= 3 THEN '(0, 3]'
                       WHEN tenure_months > 3 AND tenure_months <= 6 THEN '(3, 6]'
                       WHEN tenure_months > 6 AND tenure_months <= 12 THEN '(6, 12]'
                       WHEN tenure_months > 12 AND tenure_months <= 24 THEN '(12, 24]'
                       WHEN tenure_months > 24 AND tenure_months <= 100 THEN '(24, 100]' END AS tenure_band
        FROM export) WHERE tenure_band IS NOT NULL
  GROUP BY band_index, tenure_band) ORDER BY band_index""", ["avg_spent", "critical_risk_pct"])

# ------------------------------------------------------------- chart datasets


def _counts(col: str, src: str = "profile") -> str:
    return (f"SELECT {col}, COUNT(*) AS count FROM {src} WHERE {col} IS NOT NULL "
            f"GROUP BY {col} ORDER BY count DESC")


def _hist(col: str, bins: int, where: str = "TRUE") -> str:
    """Counts between stated edges; the last bin holds its upper edge."""
    return f"""
SELECT e.bin, e.bin_start, e.bin_end, COUNT(x) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin, lo + range * ((hi - lo) / {bins}) AS bin_start,
             lo + (range + 1) * ((hi - lo) / {bins}) AS bin_end
      FROM range(0, {bins}) CROSS JOIN (
        SELECT MIN(v) - CASE WHEN MIN(v) = MAX(v) THEN 0.5 ELSE 0 END AS lo,
               MAX(v) + CASE WHEN MIN(v) = MAX(v) THEN 0.5 ELSE 0 END AS hi
        FROM (SELECT CAST({col} AS DOUBLE) AS v FROM profile WHERE {where}))
      WHERE lo IS NOT NULL) e
LEFT JOIN (SELECT CAST({col} AS DOUBLE) AS x FROM profile WHERE {where}) d
  ON x >= e.bin_start AND (x < e.bin_end OR e.bin = {bins - 1})
GROUP BY ALL ORDER BY e.bin"""


F["c01_customers_by_segment"] = (_counts("customer_segment"), [])
F["c02_churn_distribution"] = ("""
SELECT churn_risk, COUNT(*) AS count,
       100.0::DOUBLE * (COUNT(*) / (SELECT COUNT(*) FROM profile WHERE churn_risk IS NOT NULL)) AS share_pct
FROM profile WHERE churn_risk IS NOT NULL GROUP BY churn_risk ORDER BY count DESC""", ["share_pct"])
F["c03_value_segment_counts"] = (_counts("value_segment"), [])
F["c04_spend_frequency_points"] = ("""
SELECT customer_id, purchase_frequency, total_spent, engagement_score FROM profile""",
    ["purchase_frequency", "total_spent", "engagement_score"])
F["c04_spend_frequency_grid"] = ("""
SELECT * FROM (
WITH RECURSIVE lim AS (
  SELECT min(purchase_frequency) AS xl, max(purchase_frequency) AS xh, min(total_spent) AS yl, max(total_spent) AS yh
  FROM profile WHERE purchase_frequency IS NOT NULL AND total_spent IS NOT NULL),
points AS (
  SELECT engagement_score AS e,
         CAST(least(floor(coalesce((purchase_frequency - xl) / nullif(xh - xl, 0), 0) * 64), 63) AS INTEGER) AS ix,
         CAST(least(floor(coalesce((total_spent - yl) / nullif(yh - yl, 0), 0) * 64), 63) AS INTEGER) AS iy
  FROM profile, lim WHERE purchase_frequency IS NOT NULL AND total_spent IS NOT NULL),
opened AS (
  SELECT 0 AS level, 0 AS cx, 0 AS cy, count(*) AS n FROM points HAVING count(*) > 0
  UNION ALL
  SELECT level, cx, cy, n FROM (
    SELECT o.level + 1 AS level, ix >> (5 - o.level) AS cx, iy >> (5 - o.level) AS cy, count(*) AS n
    FROM opened o JOIN points p ON ix >> (6 - o.level) = o.cx AND iy >> (6 - o.level) = o.cy
    WHERE o.n > 20 AND o.level < 6 GROUP BY o.level, ix >> (5 - o.level), iy >> (5 - o.level)))
SELECT CAST(level AS INTEGER) AS level, CAST(cx AS INTEGER) AS cell_x, CAST(cy AS INTEGER) AS cell_y,
       any_value(xl + (xh - xl) * (cx / pow(2.0, level))) AS frequency_from, any_value(xl + (xh - xl) * ((cx + 1) / pow(2.0, level))) AS frequency_to,
       any_value(yl + (yh - yl) * (cy / pow(2.0, level))) AS spend_from, any_value(yl + (yh - yl) * ((cy + 1) / pow(2.0, level))) AS spend_to,
       count(*) AS customers, favg(e) AS engagement_mean
FROM opened JOIN points ON ix >> (6 - level) = cx AND iy >> (6 - level) = cy, lim
WHERE n <= 20 OR level = 6 GROUP BY level, cx, cy)""",
    ["frequency_from", "frequency_to", "spend_from", "spend_to", "engagement_mean"])
F["c05_recency_histogram"] = (_hist("days_since_last_purchase", 30, "days_since_last_purchase < 365"),
                              ["bin_start", "bin_end"])
F["c06_engagement_by_segment"] = ("""
SELECT customer_segment, favg(engagement_score) AS engagement_score_mean FROM profile
WHERE customer_segment IS NOT NULL GROUP BY customer_segment ORDER BY engagement_score_mean DESC""",
    ["engagement_score_mean"])

_BOX = """
SELECT s.customer_segment, COUNT(*) AS n, q1, median, q3,
       coalesce(MIN(CASE WHEN clv_estimate >= q1 - 1.5 * (q3 - q1) THEN clv_estimate END), q1) AS whisker_low,
       coalesce(MAX(CASE WHEN clv_estimate <= q3 + 1.5 * (q3 - q1) THEN clv_estimate END), q3) AS whisker_high,
       COUNT(*) FILTER (WHERE clv_estimate < q1 - 1.5 * (q3 - q1) OR clv_estimate > q3 + 1.5 * (q3 - q1))
         AS outliers
FROM profile s JOIN (
  SELECT customer_segment, quantile_cont(clv_estimate, 0.25) AS q1, quantile_cont(clv_estimate, 0.5) AS median,
         quantile_cont(clv_estimate, 0.75) AS q3
  FROM profile WHERE clv_estimate IS NOT NULL AND customer_segment IS NOT NULL GROUP BY customer_segment) q
  ON q.customer_segment = s.customer_segment
WHERE s.clv_estimate IS NOT NULL
GROUP BY s.customer_segment, q1, median, q3"""

F["c07_clv_box_stats"] = (_BOX, ["q1", "median", "q3", "whisker_low", "whisker_high"])
F["c07_clv_outliers"] = (f"""
SELECT p.customer_segment, p.customer_id, p.clv_estimate
FROM profile p JOIN ({_BOX}) b ON b.customer_segment = p.customer_segment
WHERE p.clv_estimate IS NOT NULL AND (p.clv_estimate < b.whisker_low OR p.clv_estimate > b.whisker_high)""",
    ["clv_estimate"])
F["c08_conversion_by_channel"] = ("""
SELECT acquisition_channel, favg(conversion_rate) AS conversion_rate_mean FROM profile
WHERE acquisition_channel IS NOT NULL GROUP BY acquisition_channel ORDER BY conversion_rate_mean DESC""",
    ["conversion_rate_mean"])
F["c09_transaction_histogram"] = (_hist("total_transactions", 20), ["bin_start", "bin_end"])
F["c10_revenue_by_segment"] = ("""
SELECT customer_segment, fsum(total_spent) AS total_spent_sum FROM profile
WHERE customer_segment IS NOT NULL GROUP BY customer_segment""", ["total_spent_sum"])


def _pack(name: str, bodies: dict[str, str]) -> str:
    """Cells of each sheet's own statement."""
    from .registry_profile import PACKS
    parts = []
    for sheet, (item, metrics) in PACKS[name].items():
        cells = [f"{{'metric': '{m}', 'text': CAST(NULL AS VARCHAR), 'value': CAST({m} AS DOUBLE)}}" for m in metrics]
        cells = cells or ["{'metric': 'Value', 'text': \"Value\", 'value': CAST(NULL AS DOUBLE)}"]
        parts.append(f"SELECT '{sheet}' AS sheet, CAST({item} AS VARCHAR) AS item, unnest([{', '.join(cells)}], recursive := true) "
                     f"FROM ({bodies[sheet]})")
    return "\nUNION ALL\n".join(parts)


F["l07_report_pack"] = (_pack("l07_report_pack", {
    "Customer Data": "SELECT * FROM profile", "Segment_Analysis": F["r01_segment_analysis"][0], "Churn_Risk": F["r02_churn_risk_report"][0],
    "Value_Segment": F["r03_value_segment_report"][0], "Channel": F["r04_channel_report"][0],
    "Executive Summary": F["r05_executive_summary"][0]}), ["value"])
F["l08_custom_pack"] = (_pack("l08_custom_pack", {
    "Summary": F["r06_custom_summary"][0], "Top Customers": F["r07_top_by_spend"][0], "At Risk Customers": F["r08_at_risk"][0],
    "Segment Analysis": F["r09_segment_engagement"][0]}), ["value"])


# name -> (SQL whose WITH clause carries the profile CTEs, DOUBLE columns)
PROFILE_FAMILY_SQL: dict[str, tuple[str, list[str]]] = {
    name: (body, dcols) for name, (body, dcols) in F.items()
}
PROFILE_CTE_NAMES = set(F)
