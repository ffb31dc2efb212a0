"""Spark session helpers.

Library code never creates a session of its own; it takes the caller's.
``get_spark`` is for tests, the bench and command-line use only.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "tessera") -> SparkSession:
    """The submitted session, or a local one with the settings the engine is tuned for.

    Started by ``spark-submit`` (or inside a running session), the session is
    taken as it is: master, partitions and memory are the submitter's. Else a
    local one: AQE stays on so shuffle partitions are coalesced and skewed
    joins split at run time; the UI stays off (no server is started).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # set by spark-submit for its Python driver
        return SparkSession.builder.getOrCreate()
    master = master or os.environ.get("TESSERA_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The session's ``spark.checkpoint.dir`` wins. Where it is unset, a session
    with a local master (driver and executor are one process, as in tests)
    gets a fresh scratch folder; any other raises, since its executors would
    not see a folder of the driver's machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def default_parallelism(spark: SparkSession) -> int:
    """Task parallelism of the session (classic or Connect)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:
        for key in ("spark.default.parallelism", "spark.sql.shuffle.partitions"):
            try:
                v = spark.conf.get(key, None)
                if v:
                    return int(v)
            except Exception:
                pass
    return 8
