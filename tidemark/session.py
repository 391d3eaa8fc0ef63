"""Session defaults and the shared working folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and a RocksDB state store.

    On a cluster leave ``master`` unset and let spark-submit decide; tests and the
    bench pass ``local[n]``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone; stored timestamps carry no zone and mean UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent, as in local tests, a temporary folder is used.
    """
    root = spark.conf.get(SHARED_DIR_CONF, None)
    if root is None and spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    if root is None:
        raise ValueError(f"set {SHARED_DIR_CONF} to a folder every executor can reach")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_STAGED: list[str] = []  # paths written by this driver and not yet released


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    Used where several branches of one plan need the same expensive rows: the files survive lost
    executors and end the lineage, which in-memory caching would not.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_paths() -> list[str]:
    """What ``staged`` has written so far and ``release`` has not emptied."""
    return list(_STAGED)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Give back the space of staged results that nothing reads any more, by writing an empty table over each."""
    for path in paths:
        if path in _STAGED:
            spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)
            _STAGED.remove(path)
