"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where none is set."""
    where = spark.conf.get(CHECKPOINT_CONF, None)
    if not where:
        where = spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='veilwork-')}"
        spark.conf.set(CHECKPOINT_CONF, where)
        atexit.register(_remove_local, where.removeprefix("file://"))
    return where.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Written tables in the shared folder that cut lineage.

    They survive lost executors (unlike local checkpoints) and keep columnar
    pruning and size statistics (unlike RDD checkpoints).  `drop` removes a
    table as soon as no later step reads it; the rest goes at exit.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/veilwork/{uuid.uuid4().hex}"
        self.at: dict[int, str] = {}
        _ROOTS.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = path
        out._veilwork_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._veilwork_path)

    def release(self) -> None:
        """Let go of the shuffle files of finished steps.  Spark deletes them when
        the driver's collector meets their last reference, by default every
        half an hour; until then each step's files lie under the next one's."""
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        _delete(self.spark, self.root)


_ROOTS: list[Scratch] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear_all() -> None:
    for s in _ROOTS:
        try:
            s.clear()
        except Exception:  # the session is gone; the folder's owner cleans it
            return


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text column, empty where it is null."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))
