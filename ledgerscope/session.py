"""Session defaults, lineage cuts and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SPLIT_ROWS_KEY = "spark.ledgerscope.splitRows"
# Rows of one key that one task may sort. Larger groups are cut into ordered slices.
SPLIT_ROWS_DEFAULT = 4_000_000


def build_session(app: str = "ledgerscope", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on. Cluster settings given outside win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh one only on a local master without it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="ledgerscope-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Ends a plan: the result outlives any executor and the plan behind it is dropped.

    Written by column like any other table. A checkpoint runs its last stage twice and keeps whole rows uncompressed.
    """
    return materialize(df, "cut")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for a written table."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def split_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SPLIT_ROWS_KEY, str(SPLIT_ROWS_DEFAULT)))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table several branches read to the shared folder and reads it back by column."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """A table kept on the executors' disks by ``key``, so that rounds join it without shuffling it again.

    ``df`` comes from a written table, from which anything an executor loses is made again. ``unique`` drops repeats.
    The caller unpersists it after the last round.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(width, key)
    return (dealt.distinct() if unique else dealt).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)
