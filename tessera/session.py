"""Session helpers: building a session for tests/bench and finding shared scratch space.

Operators never build sessions themselves; they take DataFrames. Jobs that must cut lineage
(row index on a shuffled input, written intermediate tables) use the folder the cluster names
in ``spark.checkpoint.dir``. Only when that setting is absent (local tests) do we pick our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tessera",
                  extra: dict | None = None) -> SparkSession:
    """A session for tests and benchmarks (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # checkpoint files of the row index are removed once their DataFrame is gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only when none is configured."""
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: the server side owns the setting
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        # Unset: only acceptable in local tests. On a cluster the setting must name a shared
        # folder; a machine-local temporary folder would not survive the loss of this machine.
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not str(master).startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (cluster session without one)")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root for written intermediate tables."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root.rstrip("/"), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def scale_settings(input_bytes: int, executors_cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for an input volume: scan splits and shuffle partitions of about
    ``partition_bytes`` (so a task's share fits executor memory and spills rarely), AQE to merge
    small partitions and split skewed ones at run time.

    Example: 100 TB over 1,000 executors x 8 cores -> ~400k shuffle partitions of 256 MB.
    """
    shuffle = max(executors_cores * 2, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes * 2),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> None:
    for k, v in settings.items():
        spark.conf.set(k, v)
