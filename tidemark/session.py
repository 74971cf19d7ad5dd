"""Session defaults and the few runtime helpers that operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; `conf` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the folder that is set or that the cluster names in spark.checkpoint.dir. Where none is, a session whose tasks
    all run in the driver's own process (local mode) takes a folder of its warehouse; any other raises, as a folder of one
    machine would lose what its executors write."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoint")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and return it with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df` as a table of the driver, marked for broadcast, if it has at most `rows` rows; else as it is (Spark then joins by
    shuffle, with adaptive splitting of hot keys). It is computed once, behind a limit. For reference tables such as decks
    and elements, and for results per series or kind, of which there usually are few."""
    got = df.limit(rows + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(got, df.schema)) if got.num_rows <= rows else df
