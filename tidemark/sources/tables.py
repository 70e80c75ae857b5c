"""Reading the Parquet tables of a directory."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What may stand around a word such as a status or an operation.
BLANKS = " \t\r\n"


def importable(spark: SparkSession) -> None:
    """Lets Python workers of this session import this library from where the driver has it.

    Where executors don't share that path, the library has to be shipped (--py-files).
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of `folder`; with `columns`, only those are read."""
    importable(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def has_key(name: str):
    """A null or empty key is no key."""
    return F.col(name).isNotNull() & (F.octet_length(name) > 0)


def partitions(spark: SparkSession) -> int:
    """The shuffle width the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: that of spark.checkpoint.dir.

    Only a local session without that setting gets a folder on this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir()
