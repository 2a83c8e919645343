"""Session helpers: a tuned local session, table access and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def local_session(cpus: str | int = "*", app: str = "tidemark", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A UTC session for one machine; on a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column | str) -> Column:
    """Epoch microseconds of a timestamp (either timestamp type; NTZ is read as UTC when the session is UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a private one is set only where none is and all runs on one machine."""
    sc = spark.sparkContext
    if (have := sc.getCheckpointDir()) is not None:
        return have
    where = sc.getConf().get("spark.checkpoint.dir")
    if where is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        where = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    sc.setCheckpointDir(where)
    return where
