"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_saved: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Let the executors import this package: the driver serves a zip of it,
    once for each application, as `--py-files` would."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    top = tempfile.mkdtemp(prefix="veilwork-zip-")
    atexit.register(shutil.rmtree, top, True)
    with zipfile.ZipFile(f"{top}/veilwork_src.zip", "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(f"{top}/veilwork_src.zip")
    _shipped.add(sc.applicationId)


def _shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and one machine does all."""
    conf = "spark.checkpoint.dir"
    where = spark.conf.get(conf, None) or spark.sparkContext.getConf().get(conf)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{conf} must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="veilwork-")
        atexit.register(shutil.rmtree, top, True)
        where = f"file://{top}"
        spark.conf.set(conf, where)
    return where.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """A frame written to the shared folder and read again, so that what several
    later steps use is computed once and survives lost executors.  The table
    goes when the program ends, as later queries may still read it."""
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/veilwork/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _saved.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_saved() -> None:
    for spark, path in _saved:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the folder's owner cleans it
            return
