"""Access to tables in a folder and small helpers for laying out work.

``table``  one Parquet table (a file or a folder of part files).
``spread`` gives a tiny input enough partitions for CPU-heavy Python work; an
           input that already fills the cores is left alone, so large tables
           are never shuffled for it.
``by_keys`` lays rows out by keys in as many partitions as shuffles have.
``cut``    cuts lineage by a reliable checkpoint in the folder the session
           names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def by_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, in as many partitions as the session sets for shuffles.

    For groups of small rows that take much computing: by bytes alone they would be put into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leafmill-"))
    return df.checkpoint()


#: Rows up to which a set of keys is sent to every executor; beyond it the join shuffles.
KEYS_SENT = 100_000


def drop_keys(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose ``name`` isn't among ``keys``; the size of ``keys`` decides how."""
    keys = keys.select(name).distinct()
    few = keys.limit(KEYS_SENT + 1).count() <= KEYS_SENT
    return df.join(F.broadcast(keys) if few else keys, name, "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose ``name`` is among ``keys``; the size of ``keys`` decides how."""
    keys = keys.select(name).distinct()
    few = keys.limit(KEYS_SENT + 1).count() <= KEYS_SENT
    return df.join(F.broadcast(keys) if few else keys, name, "left_semi")
