"""custlens — customer analytics as Spark DataFrame jobs.

Three input tables (customers, transactions, engagement) become a
one-row-per-customer profile and a catalogue of business questions.
Every operator is a pure function ``DataFrame(s) -> DataFrame`` that
builds a lazy plan; nothing is collected to the driver except bounded
scalars (a handful of quantile edges or bucket offsets).

Sub-packages
------------
sources    schemas, table loading, keyed idempotent load, sinks
functions  column helpers (as-of day arithmetic, rounding families),
           distributed rank / running sum / exact percentiles
operators  per-customer summaries, SQL catalogue (S), profile (P),
           reports (R), tutorial analytics (A), chart datasets (C)
plans      session settings, checkpointing, plan inspection
streaming  continuous keyed ingest (insert-or-ignore) with foreachBatch
"""

__version__ = "0.1.0"
