"""``CustomerAnalytics``: the whole catalogue over one set of shared summaries.

At scale the cost of every customer-level question is scanning and
shuffling the fact tables.  This facade aggregates each fact table once
per customer (``tx_by_customer``, ``eng_by_customer``), joins them to
the customers once (``wide``), checkpoints these into
``spark.checkpoint.dir``, builds and checkpoints the profile from them,
and answers every question from those — the raw fact tables are read again only by questions that
group them by something other than the customer (category, month,
device, the 30-day window).

    ca = CustomerAnalytics(C, T, E, as_of)
    ca.rfm_rules().show()
    ca.report("segment_analysis").show()
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame

from .operators import charts as Ch
from .operators import profile as Pr
from .operators import queries as Q
from .operators import reports as Rp
from .operators import segments as Sg
from .operators.summaries import eng_by_customer, tx_by_customer
from .plans.materialize import forget, keep
from .sources.schemas import EXPORT_COLUMNS


class CustomerAnalytics:
    def __init__(self, customers: DataFrame, transactions: DataFrame, engagement: DataFrame,
                 as_of: datetime, materialize: bool = True, exact_distinct: bool = False,
                 tx: DataFrame | None = None, eng: DataFrame | None = None):
        """``exact_distinct`` counts distinct transaction ids instead of relying on the primary key.
        ``tx``/``eng``: summaries that are kept up to date elsewhere (``operators.state``), instead of aggregating the facts."""
        self.C, self.T, self.E, self.as_of = customers, transactions, engagement, as_of
        self._given = {"tx": tx, "eng": eng}
        self._materialize, self._exact = materialize, exact_distinct
        self._paths: list[str] = []

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        if not self._materialize:
            return df
        kept, path = keep(df, name)
        self._paths.append(path)
        return kept

    def close(self) -> None:
        """Delete the tables kept so far; frames made from them can no longer be read."""
        while self._paths:
            forget(self.C.sparkSession, self._paths.pop())

    def __enter__(self) -> "CustomerAnalytics":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # ------------------------------------------------------------ shared state
    @cached_property
    def tx(self) -> DataFrame:
        """Per-customer transaction summary (checkpointed once)."""
        given = self._given["tx"]
        return given if given is not None else self._keep(tx_by_customer(self.T, self._exact), "tx-summary")

    @cached_property
    def eng(self) -> DataFrame:
        """Per-customer engagement summary (checkpointed once)."""
        given = self._given["eng"]
        return given if given is not None else self._keep(eng_by_customer(self.E), "eng-summary")

    @cached_property
    def wide(self) -> DataFrame:
        """customers ⟕ transaction summary ⟕ engagement summary, checkpointed
        once: customer-level questions are projections of it, so the customer
        table is shuffled for one join instead of one join per question."""
        return self._keep(self.C.join(self.tx, "customer_id", "left").join(self.eng, "customer_id", "left"),
                          "customers-wide")

    @cached_property
    def profile(self) -> DataFrame:
        """The full profile, built from the pre-joined summaries and checkpointed."""
        return self._keep(Pr.build_profile(self.wide, self.T, self.E, self.as_of), "profile")

    @cached_property
    def export(self) -> DataFrame:
        """The 15 exported profile columns (what the tutorial analyses)."""
        return self.profile.select(*EXPORT_COLUMNS)

    # ------------------------------------------------------ S: SQL catalogue
    def customer_list(self): return Q.customer_list(self.C)
    def customers_by_country(self): return Q.customers_by_country(self.C)
    def customers_by_channel(self): return Q.customers_by_channel(self.C)
    def customer_transactions(self): return Q.customer_transactions(self.wide, self.T, tx=self.tx)
    def revenue_by_category(self): return Q.revenue_by_category(self.T)
    def revenue_by_payment_method(self): return Q.revenue_by_payment_method(self.T)
    def monthly_revenue(self): return Q.monthly_revenue(self.T)
    def customer_engagement(self): return Q.customer_engagement(self.wide, self.E, eng=self.eng)
    def device_usage(self): return Q.device_usage(self.E)
    def customer_conversion(self): return Q.customer_conversion(self.wide, self.E, eng=self.eng)
    def rfm_rules(self): return Q.rfm_rules(self.wide, self.T, self.as_of, tx=self.tx)
    def churn_by_inactivity(self): return Q.churn_by_inactivity(self.wide, self.T, self.as_of, tx=self.tx)
    def clv_three_year(self): return Q.clv_three_year(self.wide, self.T, self.as_of, tx=self.tx)
    def cohort_retention(self): return Q.cohort_retention(self.wide, self.T, tx=self.tx)
    def segment_performance(self): return Q.segment_performance(self.wide, self.T, self.E, tx=self.tx, eng=self.eng)
    def channel_effectiveness(self): return Q.channel_effectiveness(self.wide, self.T, tx=self.tx)
    def top_customers(self, k: int = 20): return Q.top_customers(self.wide, self.T, k, tx=self.tx)
    def top_products(self): return Q.top_products(self.T)
    def value_comparison(self): return Q.value_comparison(self.wide, self.T, tx=self.tx)
    def recently_active(self, days: int = 30): return Q.recently_active(self.C, self.T, self.as_of, days, self._exact)
    def business_kpis(self, days: int = 30): return Q.business_kpis(self.wide, self.T, self.as_of, days, tx=self.tx)
    def customer_growth(self): return Q.customer_growth(self.C)
    def purchase_frequency_by_category(self): return Q.purchase_frequency_by_category(self.T)
    def avg_spend_by_segment(self): return Q.avg_spend_by_segment(self.wide, self.T, tx=self.tx)

    def inactive_customers(self, days: int = 180, k: int | None = 10):
        return Q.inactive_customers(self.wide, self.T, self.as_of, days, k, tx=self.tx)

    # ------------------------------------------------------- R / A / C families
    def report(self, name: str) -> DataFrame:
        """A named report (R1-R4) of the batch job."""
        return Rp.generate_reports(self.profile)[name]

    def reports(self) -> dict[str, DataFrame]:
        return Rp.generate_reports(self.profile)

    def executive_summary(self): return Rp.executive_summary(self.profile)
    def custom_summary(self): return Rp.custom_summary(self.export)
    def key_statistics(self): return Rp.key_statistics(self.profile)
    def top_by_spend(self, k: int = 20): return Rp.top_by_spend(self.export, k)
    def at_risk(self): return Rp.at_risk(self.export)
    def segment_engagement(self): return Rp.segment_engagement(self.export)

    def tutorial(self, name: str, *args, **kwargs) -> DataFrame:
        """Any tutorial analytic (A01-A17) by function name, over the export."""
        return getattr(Sg, name)(self.export, *args, **kwargs)

    def chart(self, name: str, *args, **kwargs) -> DataFrame:
        """Any chart dataset (C1-C10) by function name, over the profile."""
        return getattr(Ch, name)(self.profile, *args, **kwargs)
