"""Reliable cuts of the lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table of rates or counts that are broadcast at most.
BROADCAST_ROWS = 200_000


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that ``spark.checkpoint.dir`` names; only a local master may do without the setting."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        local = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if not folder and not local:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tesselink-checkpoint-"))
    return df.checkpoint()


def side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` cut, as the narrow side of a join: broadcast if it has at most ``most`` rows, as counted, else joined by shuffle.

    A frequent key of the other side then stays where it is, or is split at run time, both sides being plain tables.
    """
    narrow = cut(df)
    return F.broadcast(narrow) if narrow.count() <= most else narrow


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all cores: for rows that are small but costly, which would be gathered into few tasks by their size."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
