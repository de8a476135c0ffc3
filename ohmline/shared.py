"""Small helpers that every part of the library uses: reading tables, cutting lineage, naming columns."""

from __future__ import annotations

import sys
import tempfile
import threading
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a finished write drops its shuffle files at once, not when the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Held while the setting is changed: one table is written at a time.
WRITING = threading.RLock()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session whose master is ``local`` may leave it unset: then a temporary folder is chosen once.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    What follows no longer depends on the plan that made it, so a lost executor costs a re-read, not a
    recomputation. The files stay for as long as the folder does; the shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ohmline/{uuid.uuid4().hex}"
    with WRITING:
        before = spark.conf.get(CLEAN_UP, "false")
        spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/ohmline/".split(":", 1)[-1].lstrip("/")
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if root in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def joined_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` where all ``keys`` are equal, and null equals null; without keys, each with each.

    The keys are those of ``left``; what else both have must differ in name.
    """
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    named = right.withColumnsRenamed(names)
    if not names:
        return left.join(named)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(named, same, how).drop(*names.values())


def ship(module: str) -> None:
    """Let Spark send the functions of ``module`` to its workers by value, so they need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
