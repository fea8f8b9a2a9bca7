"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from datetime import datetime, timezone
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

LOCAL = {
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "ledgerloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the defaults above; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    settings = dict(DEFAULTS)
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            settings.update(LOCAL)
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return adopt(spark)


def adopt(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on in a session built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def utc_now() -> datetime:
    """Current time in UTC without a zone, as the tables store it."""
    return datetime.now(timezone.utc).replace(tzinfo=None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts the lineage of rows that several later steps scan: they then read the columns they
    need, and a lost executor costs its tasks and not the steps before.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def together(spark: SparkSession, *steps: Callable[[], Any]) -> list[Any]:
    """Results of steps that do not depend on each other, in order; their Spark jobs run side by side.

    All of them end before the first failure, in the order given, is raised.
    """
    if not steps:
        return []
    with ThreadPoolExecutor(len(steps)) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        wait(begun)
    return [b.result() for b in begun]
