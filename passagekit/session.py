"""Spark session settings used by tests, the bench and the examples.

On a cluster the session is created by the platform; ``tune`` only fills
settings that are still unset, so cluster-wide values always win.
"""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for the operators in this package.
#  * AQE re-plans joins with runtime sizes (a broadcast only happens when the
#    measured side is below autoBroadcastJoinThreshold) and splits skewed
#    shuffle partitions of sort-merge joins (one hot title / document).
#  * Arrow batches bound the memory of every mapInPandas/applyInPandas task.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "passagekit") -> SparkSession:
    """Local session for tests and the bench (UI off, no extra ports)."""
    master = master or os.environ.get("PASSAGEKIT_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # checkpoint files (lineage cuts) are removed once their RDD is unreachable
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", os.environ.get("PASSAGEKIT_DRIVER_MEM", "16g"))
         # local runs read single-file tables: spread them over the cores
         .config("spark.passagekit.spread.input", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Set package defaults only where the session has no value yet."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """The Arrow batch limits of this package, where the session has none: the memory
    of Python tasks over long texts follows from them."""
    for k in (k for k in DEFAULTS if k.startswith("spark.sql.execution.arrow.max")):
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, DEFAULTS[k])


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared folder
    there).  When it is unset, a local master (tests) gets a scratch folder;
    on any other master a machine-local folder would be lost to the other
    machines, so that is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        master = sc.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        # ``spark.checkpoint.dir`` is a startup setting and cannot be changed at
        # runtime, so the scratch folder is registered on the context
        d = tempfile.mkdtemp(prefix="passagekit-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def collect_finished(spark: SparkSession) -> None:
    """The driver collects the objects of finished steps, so that Spark deletes their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``passagekit`` importable in executor Python workers.

    Operators that run Python on executors (``mapInPandas`` /
    ``applyInPandas``) refer to functions of this package; this adds a zip of
    the package to the SparkContext once (what ``--py-files`` does at submit
    time), so it works whatever the driver's working directory is.  On a
    cluster, submit with ``--py-files passagekit.zip`` and this is a no-op.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    submitted = sc.getConf().get("spark.submit.pyFiles", "") or ""
    if "passagekit" in submitted:  # shipped with --py-files at submit time
        _SHIPPED.add(key)
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="passagekit-pyfiles-"), "passagekit.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
