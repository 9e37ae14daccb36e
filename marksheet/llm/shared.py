"""Places and tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only in single-JVM local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marksheet-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(table: DataFrame) -> None:
    """Delete what materialise() wrote for table, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.delete_dir(path)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Ids up to this number (8 bytes each) are sent to every task; more are joined by shuffling.
MAX_BROADCAST_IDS = 1_000_000
#: Ids that stand in for missing ones are this or greater.
FIRST_STAND_IN = 1 << 62


def named_id() -> Column:
    """The doc_id of a row of documents; for rows without one, a number that stands for their text."""
    return F.coalesce("doc_id", F.pmod(F.xxhash64("text"), F.lit(1 << 61)) + FIRST_STAND_IN)


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where every row has an id."""
    return docs.select(named_id().alias("doc_id"), "text")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) without the rows whose named_id is among ids(doc_id)."""
    ids = materialise(ids.select(F.col("doc_id").alias("dropped_id")).distinct(), "dropped-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, named_id() == ids.dropped_id, "left_anti")
