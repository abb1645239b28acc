"""What the corpus operators share: checkpoints, salting, grouping, table access."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once, and of an Arrow batch while a checkpoint is made.
WORKED_ON, BATCH_BYTES = 1 << 20, 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``. Where the setting is
    absent, a temporary folder is set on a local master, as in tests; on a cluster a folder
    of one machine would not do, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder.

    The files survive lost executors and Spark deletes them with the frame when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on. While it is made, Arrow
    batches are smaller than the session's, whose setting is the same again afterwards.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = WORKED_ON) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts in ``column`` have some ``most`` bytes, or one row each.

    Spark itself bounds a batch by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``);
    what is worked out of the texts takes many times their room, so slices are smaller.
    """
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= most:
            yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt_of(spark: SparkSession, *cols: Column) -> Column:
    """As many salts as shuffle partitions: a hot key then spreads over all of them."""
    return F.pmod(F.xxhash64(*cols), F.lit(shuffle_partitions(spark)))


def few(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most`` rows, which is counted;
    else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def gathered(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df``, known to have ``rows`` rows, in no more partitions than ``each`` rows ask for."""
    return df.coalesce(max(1, -(-rows // each)))
