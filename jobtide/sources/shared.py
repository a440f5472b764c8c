"""Folders every executor can reach, for checkpoints and tables written on the way."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_SHIPPED: set[str] = set()
# Folders that ``written`` made, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the one named by ``spark.checkpoint.dir``.

    Without that setting only a local session gets a folder of its own; on a cluster a machine-local
    folder would not survive the loss of an executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="jobtide-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write rows that several later steps need to a shared folder and go on from there.

    Later steps neither repeat the work nor lose it with an executor.
    """
    path = shared_folder(df.sparkSession, label)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, label: str, **figures: Column) -> tuple[DataFrame, dict[str, int]]:
    """``written``, and figures of its rows (aggregates, by name) that are gathered while they are written, so that none needs a scan of its own."""
    watched = Observation(label)
    kept = written(df.observe(watched, *[value.alias(name) for name, value in figures.items()]), label)
    return kept, watched.get


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` put aside as soon as nothing reads it any more: later steps build on what was written after it."""
    for table in tables:
        spark = table.sparkSession
        known = _WRITTEN.get(spark.sparkContext.applicationId, [])
        for folder in {file.rpartition("/")[0].rpartition("/")[2] for file in table.inputFiles()}:
            for path in [p for p in known if p.rpartition("/")[2] == folder]:
                known.remove(path)
                _delete(spark, path)
    for table in tables[:1]:
        let_go(table.sparkSession)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage now: Spark deletes the shuffle files of finished steps only once their plans are gone, which can take until the disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def put_aside(spark: SparkSession) -> int:
    """How many tables this application has put aside so far; a mark for ``clear_written``."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def clear_written(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what this application has put aside with ``written``, after the mark ``since`` and but for the table ``keep``; call it once the results that build on it are saved."""
    known = _WRITTEN.get(spark.sparkContext.applicationId, [])
    kept = {file.rpartition("/")[0].rpartition("/")[2] for file in keep.inputFiles()} if keep is not None else set()
    for path in known[since:]:
        if path.rpartition("/")[2] not in kept:
            known.remove(path)
            _delete(spark, path)


def broadcast_if_small(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Mark a join side for broadcast when measuring shows that it is small; otherwise leave the choice to Spark.

    Meant for narrow rows met by very wide ones, where moving the wide side would cost far more than measuring.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the few steps that run Python in tasks.

    Not needed where the package is installed on every node or was given with ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='jobtide-zip-')}/jobtide", "zip", root, "jobtide")
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
