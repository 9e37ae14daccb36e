"""Tables that a job writes for its own later steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed value: rows that a task of spread() has on average.
ROWS_A_TASK = 500_000


def by_shuffle(df: DataFrame) -> DataFrame:
    """df for one side of a join that deals rows by their keys. Sizes of what is exploded or put into structs are guessed far too small, and
    Spark would gather such a side in the driver to broadcast it."""
    return df.hint("merge")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each worked out once a row: plain ones are copied into every expression and filter that names them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def spread(df: DataFrame, *keys: str, rows: int = ROWS_A_TASK, a_core: int = 1) -> DataFrame:
    """df dealt by keys into tasks of about that many rows, as many for each core at least, so that what sorts in a task hold doesn't grow
    with the table. df is counted for that, which costs little where it is a plain Parquet table. Windows and aggregates by these keys deal
    nothing anew."""
    tasks = max(-(-df.count() // rows), a_core * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet below spark.checkpoint.dir, read again: what several steps read is built once, and survives lost executors. In
    local mode without that setting, below a temporary folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marksheet-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
