"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder.  Only on a local master may it be
unset: then a folder of our own is made and set.  An application's tables are
deleted when it ends; its frames may read them until then.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; raises on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cuelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cuelake-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation of
    everything above.  An empty frame keeps its schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def whole(text: Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(text, F.lit(""))


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name}`")
