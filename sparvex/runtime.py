"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that holds checkpoints.

    A cluster names it in `spark.checkpoint.dir`. Where that is unset, as in local tests, a folder of
    our own is set once.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "sparvex-checkpoints")
    sc.setCheckpointDir(named)
    return named


#: Spark's own setting that drops the shuffle files of a plan once it has run.
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage. The shuffle files behind it are dropped then."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_DROP, before) if before is not None else spark.conf.unset(_DROP)
