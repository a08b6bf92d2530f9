"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
LOCAL_FOLDER_CONF = "ticketlens.local.folder"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "ticketlens") -> SparkSession:
    """Local session as used by tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def named_folder(spark: SparkSession) -> str | None:
    """The shared folder of this session: the cluster's, or the one that ``use_local_folder`` chose."""
    return spark.conf.get(CHECKPOINT_CONF, None) or spark.conf.get(LOCAL_FOLDER_CONF, None)


def use_local_folder(spark: SparkSession) -> SparkSession:
    """Where the session names no folder and runs on one machine (tests, bench, smoke runs): a new one of our own.

    ``spark.checkpoint.dir`` cannot be set on a running session, so the choice is kept under a key of our own; on a cluster nothing
    is chosen, and ``checkpoint_dir`` fails.
    """
    if not named_folder(spark) and spark.sparkContext.master.split("[")[0] == "local":
        spark.conf.set(LOCAL_FOLDER_CONF, tempfile.mkdtemp(prefix="ticketlens-"))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; error when unset."""
    current = named_folder(spark)
    if not current:
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; name a shared folder (tests and the bench choose one on their machine)")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (never a machine-local temp dir on a cluster)."""
    return "/".join([checkpoint_dir(spark).rstrip("/"), *parts])
