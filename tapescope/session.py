"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tapescope", master: str | None = None, shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the operators rely on (UTC, AQE, Arrow).

    On a cluster leave ``master`` and ``shuffle_partitions`` unset and let the
    submit command choose them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every operator needs to a given session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the session's setting, else a test folder.

    A machine-local folder is only ever chosen for a local master, where the
    driver and the executors are one process.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tapescope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    A checkpointed frame would carry on the constraints and partitionings of the
    plan it came from, which multiply in loops until planning dominates; a
    written table starts clean and has true sizes for the planner.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tapescope-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple[str, str], str] = {}


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of one application read: made and written by the first of them.

    ``name`` must say all that the table depends on.  A table that is gone is made again.
    """
    key = (spark.sparkContext.applicationId, name)
    if key in _KEPT:
        try:
            return spark.read.parquet(_KEPT[key])
        except AnalysisException:
            del _KEPT[key]
    df = make()
    path = f"{checkpoint_dir(spark).rstrip('/')}/tapescope-kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT[key] = path
    return spark.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Make kept tables anew at their next use, as a bench must."""
    _KEPT.clear()
