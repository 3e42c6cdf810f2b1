"""Tables that are written once to shared storage: they cut a lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of tables written inside open scratch() blocks, innermost last.
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only a local session without one gets a folder of its own; on a cluster a missing setting is an error, since
    other machines would not see a local folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save_state(tables: dict[str, DataFrame], folder: str) -> str:
    """Tables as a new version of a state.  Its mark comes last, so a save that breaks off leaves the version before it."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{folder}/{time.time_ns():020d}"
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
    spark.createDataFrame([(name,) for name in tables], "name string").coalesce(1).write.json(f"{version}/whole")
    return version


def load_state(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last version that was saved as a whole; none where there is no such version."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/whole/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        return {}
    version = max(str(f.getPath().getParent().getParent()) for f in found)
    names = spark.read.schema("name string").json(f"{version}/whole").collect()
    return {r["name"]: spark.read.parquet(f"{version}/{r['name']}") for r in names}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that written() makes inside the block, once it has ended; its result must be written outside.

    If the block fails they stay, for whoever looks into it.
    """
    _SCRATCH.append([])
    try:
        yield
    except BaseException:
        _SCRATCH.pop()
        raise
    for path in _SCRATCH.pop():
        delete(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write once to shared storage and read back; columns stay prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that written() made, as soon as nothing will read it again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(spark, path)
