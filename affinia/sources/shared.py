"""Tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that this process has written and not removed yet, in order.
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, as in tests,
    and an error on a cluster, whose machines would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='affinia-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which goes with ``free`` or when the driver's JVM ends in good order."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    target, fs = _target(spark, path)
    fs.deleteOnExit(target)
    _PATHS.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def mark() -> int:
    """A point in time for ``free``."""
    return len(_PATHS)


def free(spark: SparkSession, since: int = 0, *keep: DataFrame) -> None:
    """Remove what was written since a mark, except the kept frames of ``written``. Frames that still
    read from it fail then: call it once results are used or written."""
    kept = {getattr(f, "_written_at", None) for f in keep}
    for path in _PATHS[since:]:
        if path not in kept:
            target, fs = _target(spark, path)
            fs.delete(target, True)
    _PATHS[since:] = [p for p in _PATHS[since:] if p in kept]


def exists(df: DataFrame) -> bool:
    """Whether a frame of ``written`` has not been removed."""
    return getattr(df, "_written_at", None) in _PATHS
