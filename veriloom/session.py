"""Session helpers: where lineage is cut, and how intermediate tables are written."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


class NoSharedFolder(RuntimeError):
    """The session names no folder that all executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a master whose tasks run in this very process may leave it unset; on a cluster
    a local folder would scatter the rows over machines, so that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise NoSharedFolder(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"veriloom-{os.getuid()}")


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, which ``drop_written`` deletes."""
    path = f"{shared_dir(spark)}/veriloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The returned frame has no lineage beyond the files, so a lost executor costs
    only the running tasks, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written() -> None:
    """Delete the tables that ``written`` made in this process; a long session calls it once results are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone already; the folder belongs to the cluster
            pass


atexit.register(drop_written)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the cluster, once per application."""
    import shutil
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="veriloom-")
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the file until it ends
    path = Path(folder) / "veriloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
