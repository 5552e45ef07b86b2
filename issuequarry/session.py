"""Session settings and scratch storage shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def get_session(app_name: str = "issuequarry", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the jobs are tuned for.

    On a cluster, pass no master: the submit command names it, the shuffle
    partition count and the checkpoint folder.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session without that setting (a bare local test session) gets a
    temporary folder of its own; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="issuequarry-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root."""
    return f"{scratch_root(spark)}/issuequarry/{name}-{uuid.uuid4().hex}"


#: For tables of long texts, which it makes a good deal smaller than the default does.
TEXT_CODEC = "zstd"


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: they go with their query, not when the driver next collects garbage.

    So the disk holds the shuffles of one write at a time, however many a job makes.
    """
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def written(df: DataFrame, name: str, codec: str | None = None, **facts: Column) -> tuple[DataFrame, dict]:
    """Cut lineage by writing ``df`` to the shared scratch folder and reading it back.

    Unlike a cached frame the table survives the loss of executors, and later
    stages read only the columns they need. ``facts`` are aggregates observed
    during the write, so that sizes cost no pass of their own. ``codec`` replaces the session's compression.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation()
    if facts:
        df = df.observe(seen, *[fact.alias(key) for key, fact in facts.items()])
    with shuffles_released(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), (seen.get if facts else {})


def checkpointed(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The written table alone."""
    return written(df, name, codec)[0]
