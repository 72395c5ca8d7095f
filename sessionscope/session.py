"""SparkSession construction used by tests, bench and scripts.

On a cluster the session comes from the platform; only ``ensure_checkpoint_dir``
is relevant there, and it never overrides a directory the cluster already names.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every run wants: adaptive execution (runtime partition coalescing,
# skew-join splitting, runtime broadcast of sides that turn out small) and no UI.
_BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a cohort too large to broadcast still filters the other side below its shuffle;
    # the filter itself is bounded (32 MB)
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "4g",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "32000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "268435456",
    "spark.sql.session.timeZone": "UTC",
    # compiled whole-stage code is cached per generated source; a session
    # running dozens of distinct operators needs more than the default 100
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def build_session(
    master: str | None = None,
    app_name: str = "sessionscope",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library's defaults.

    ``shuffle_partitions`` should be sized to the data: roughly total shuffle
    bytes / 128 MB on a cluster, the core count in local tests.  AQE then
    coalesces small partitions at runtime.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the checkpoint directory, setting one only when none is configured.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that setting
    always wins.  The local fallback exists for tests on one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if fallback is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder on shared storage; "
            "a machine-local folder does not survive the loss of an executor"
        )
    target = fallback or tempfile.mkdtemp(prefix="sessionscope-ckpt-")
    os.makedirs(target, exist_ok=True)
    spark.sparkContext.setCheckpointDir(target)
    return target
