"""What the corpus operators share: sessions, checkpoints and byte tables."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z only and turns every other byte below 0x80 that is neither a digit nor a letter into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def arrow_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small, as one text can be long: a batch is what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only where none is named and the master is local, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "chronokg-checkpoints")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def materialize(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors.

    With ``tidy``, for steps of long chains, the shuffles of steps that nothing
    refers to any more are let go at once; else they lie on the executors' disks
    until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    out = df.checkpoint(eager=True)
    if tidy:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Keys of one join that are broadcast at most, and rows of a key below which it is never one of them.
HOT_KEYS, HOT_LEAST = 5_000, 256


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined by ``key`` with ``counted``, which has a row for each key and in ``n`` how many of ``rows`` hold it.

    Keys of more than their share of all rows, at most ``HOT_KEYS`` of them, are
    broadcast, so that no task gets all the rows of one; the others are shuffled.
    Both sides should be settled, as they are read several times.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(HOT_LEAST, total // HOT_KEYS)
    few = F.broadcast(counted.where(hot))
    cold = rows.join(F.broadcast(counted.where(hot).select(key)), key, "left_anti").join(counted.where(~hot), key)
    return rows.join(few, key).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def as_bytes(df: DataFrame, text: str = "text"):
    """The text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
