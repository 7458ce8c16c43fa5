"""Intermediate rows that are read more than once, and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset, under a local master only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="longwatch-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: work behind them is done now, and not again for each use."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
