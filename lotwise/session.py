"""Session helpers: configuration, shared scratch folder, checkpoint folder."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app: str = "lotwise", master: str | None = None, shuffle_partitions: int | None = None, **conf):
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach: the one named by ``spark.checkpoint.dir``.

    Only when the session names none and all its threads run in the driver (a ``local`` master, as in tests) a temporary
    folder is made, once per application; on a cluster a missing folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-lotwise-")
    return _local_roots[app]


def ship_package(spark: SparkSession) -> None:
    """Give this package's sources to the Python workers, once per application, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(here)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join(name, os.path.relpath(path, here)))
    folder = tempfile.mkdtemp(prefix="spark-ship-")  # on the driver, which serves it to executors until the end
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{name}_package.zip")
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a table that this application writes for itself."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, used between the rounds of iterative operators."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later passes scan pruned columns."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, label))


def write_table(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that this application wrote for itself and no longer reads."""
    root = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/"
    if not path.startswith(root):
        raise ValueError(f"{path} is not a scratch table of this application")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table that was written to the end still lies at ``path``."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def side_by_side(spark: SparkSession, tasks: Sequence[Callable], workers: int = 4) -> list:
    """Run independent Spark jobs (fits of folds, restarts, draws) a few at a time; results in order."""
    wrap = inheritable_thread_target(spark)
    with ThreadPoolExecutor(min(workers, max(1, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(wrap(t)) for t in tasks]]
