"""Helpers of this subpackage: word patterns, key columns, stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word pattern of all contracts here, and A-Z for lower-casing.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """A text with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; on a local master one of our own if unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """stored(), after which nothing refers to what made it: shuffles, broadcast tables, plans and generated classes are
    dropped now instead of some time later, when many steps' worth of them have filled the driver."""
    out = stored(df, name)
    df.sparkSession._jvm.System.gc()
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table made by stored() that no later step reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def join_by_share(rows: DataFrame, table: DataFrame, key: str, n_rows: int, most: int = 1000) -> DataFrame:
    """rows with the columns of table that its key finds, null where there is none; no key makes a task of many rows.

    table has each key once, with the number n of rows that hold it. Keys of at least n_rows / most rows are `most` at
    most: they are broadcast. All others meet in a shuffle, rows without a key in neither.
    """
    heavy = F.broadcast(table.filter(F.col("n") * most >= n_rows).drop("n"))
    light = table.filter(F.col("n") * most < n_rows).drop("n")
    keyed = rows.filter(F.col(key).isNotNull())
    none = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns if c not in (key, "n")]
    return (
        keyed.join(heavy, key)
        .unionByName(keyed.join(heavy, key, "left_anti").join(light, key, "left"))
        .unionByName(rows.filter(F.col(key).isNull()).select("*", *none))
    )
