"""Session settings for running the operators.

On a cluster the session usually exists already; ``configure`` only
fills in settings that are unset.  The values are the ones the
operators are designed around:

* AQE on, with partition coalescing and skew-join splitting, so shuffle
  partition counts and join strategies are re-planned from runtime
  sizes (a join side is broadcast only once its materialised size is
  known to be below ``spark.sql.adaptive.autoBroadcastJoinThreshold``).
* ``spark.sql.shuffle.partitions`` sized from the cores; AQE coalesces
  small partitions, so a generous number is cheap.
* Post-shuffle partitions target ~128 MB (``advisoryPartitionSizeInBytes``)
  and scans split files at 256 MB, so at 100 TB a stage has ~400k input
  tasks of bounded size and AQE sizes the shuffles from runtime statistics;
  ``coalescePartitions.initialPartitionNum`` is set from the cluster's cores
  by the deployment, the shuffle-partition count here is only the start.
* Session time zone UTC: every ``as_of`` is a UTC wall-clock time.
* Spark UI off (no server in batch jobs).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Settings applied only when this module builds the session (static confs).
BUILD_ONLY = {
    # remove checkpoint files once their DataFrame is garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "custlens", cpus: int | str = "*", shuffle_partitions: int | None = None,
                  driver_memory: str = "16g", checkpoint_dir: str | None = None, extra: dict | None = None) -> SparkSession:
    """Local session for tests, tools and the benchmark; ``checkpoint_dir`` is where a facade keeps its tables."""
    parts = shuffle_partitions or (int(cpus) * 2 if str(cpus).isdigit() else 16)
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", driver_memory)
         .config("spark.sql.shuffle.partitions", str(parts)))
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in {**DEFAULTS, **BUILD_ONLY, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Fill in unset defaults on an existing session."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, whose executors are this process, may lack the setting; it gets a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared, fault-tolerant folder")
        found = "file://" + tempfile.mkdtemp(prefix="custlens-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")
