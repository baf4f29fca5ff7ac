"""What several operators of this folder need: words, hashes, durable cuts of the lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only; Spark's lower() also folds other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_interval(*cols: Column) -> Column:
    """A draw from the columns as a double inside (0, 1): 52 bits of the MD5 of their strings, which SQL can repeat."""
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those named, in any case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def packed(own: list[str]) -> Column:
    """The columns ``own`` as one struct, so that columns made along the way cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(None).cast("boolean").alias("none"))


def unpacked(name: str, own: list[str]) -> list[Column]:
    """The columns of the struct ``name`` that ``packed`` made."""
    return [F.col(name).getField(c).alias(c) for c in own]


#: Rows of one checkpoint file, where their number is known.
FILE_ROWS = 250_000


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint.

    ``rows``, if known, bounds the number of rows; they are then written to as few files as that needs.
    The folder is the one that ``spark.checkpoint.dir`` names.  Only a local master without that setting
    gets a temporary folder; on a cluster executors would not share it, so there it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            master = context.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tesselink-checkpoint-")
        context.setCheckpointDir(folder)
    return (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).checkpoint(eager=True)
