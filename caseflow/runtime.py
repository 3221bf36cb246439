"""What a session needs before functions of this package run on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so they need no installed copy."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="caseflow-")) / "caseflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that all executors share: spark.checkpoint.dir, or, on one machine, the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = _scratch[-1] if _scratch else base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/caseflow-{uuid.uuid4().hex}"


_scratch: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Everything stored inside is deleted at the end; for work whose results are plain values."""
    folder = shared_dir(spark)
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.remove(folder)
        _delete(spark, folder)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote for df; nothing may refer to it any more."""
    for f in df.inputFiles()[:1]:
        _delete(df.sparkSession, f.rsplit("/", 1)[0])
