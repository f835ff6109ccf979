"""Session helpers: a local session for tests, shared scratch space."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def local_session(app: str = "docmill", cores: str | int = "*", shuffle: int = 8,
                  checkpoints: str | None = None) -> SparkSession:
    """Single-JVM session for tests and the bench, with a shared folder of its own; clusters bring theirs."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("DOCMILL_DRIVER_MEMORY", "12g"))
        .config(CHECKPOINT_CONF, checkpoints or tempfile.mkdtemp(prefix="docmill-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    Raises ValueError where the setting is missing, or names a `file:` folder while the
    executors run on other machines: they would each write to a disk of their own.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        raise ValueError(f"{CHECKPOINT_CONF} is not set; name a folder that the driver and all executors share")
    if root.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF}={root} is on one machine; name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


WORKSPACES: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder (never reused, so a rerun cannot collide)."""
    root = scratch_root(spark).rstrip("/")
    folder = WORKSPACES[-1] if WORKSPACES else spark.sparkContext.applicationId
    return f"{root}/{folder}/{label}-{uuid.uuid4().hex}"


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Owns the tables staged inside it and drops them at its end; results are written before that.

    Tables staged outside belong to the application: they are below a folder of its id.
    """
    name = f"workspace-{uuid.uuid4().hex}"
    path = f"{scratch_root(spark).rstrip('/')}/{name}"
    WORKSPACES.append(name)
    try:
        yield path
    finally:
        WORKSPACES.remove(name)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands Python batches of at most 1,000 rows, and bytes as bounded; no batch grows with the table or its texts.

    A Python worker holds two batches at a time, whatever pieces its kernel takes of them.
    """
    before = {name: spark.conf.get(name) for name in BATCH_LIMITS}
    for name, most in BATCH_LIMITS.items():
        now = int(re.match(r"-?\d+", before[name])[0]) if re.fullmatch(r"-?\d+b?", before[name], re.I) else 0
        spark.conf.set(name, str(min(now, most) if now > 0 else most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has ended; by default they stay until the driver collects its garbage.

    A frame that runs twice inside deals its rows twice.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and cut its lineage there."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    For results that several writes need: they are computed once, and a lost executor
    rereads files instead of recomputing.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
