"""Session settings and shared scratch locations.

Scratch data (streaming checkpoints, round-trip tables, lineage cuts) lives
under the folder the cluster names in ``spark.checkpoint.dir``. Only when that
setting is unset in a ``local[...]`` session do we pick a folder of our own and
record it in the session, so every later call agrees; a cluster must name one.
Written intermediates stay until the folder is emptied: give it a lifetime rule.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings every tickvault job relies on: UTC wall clock for TIMESTAMP_NTZ
# conversions, ANSI arithmetic, adaptive execution for runtime re-planning
# (partition coalescing, skew-join splitting, broadcast conversion).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "tickvault",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def apply_session_defaults(spark: SparkSession) -> None:
    """Runtime-settable defaults for a session someone else built."""
    for k, v in SESSION_DEFAULTS.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing one only if unset.

    ``spark.checkpoint.dir`` cannot be changed on a running session, so a
    folder chosen here is registered with ``setCheckpointDir`` and found
    again through ``getCheckpointDir`` on later calls.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if not sc.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tickvault-ckpt-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root}/tickvault/{name}-{uuid.uuid4().hex}"
