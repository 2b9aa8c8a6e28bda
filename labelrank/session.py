"""Session-level helpers: checked broadcasts, stored intermediate tables, folders every executor can reach."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

SMALL_ROWS = 100_000
SMALL_BYTES = 64 * 1024 * 1024
_LOOK = 1_000


def small_rows(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> list[Row] | None:
    """All rows of ``df`` if they are few and small, else None.

    A first look at some rows is complete for a tiny table. Otherwise it tells how wide a row is, and so
    how many rows may come to the driver at all; Spark stops reading when the limit is reached.
    """
    look = min(_LOOK, max_rows + 1)
    rows = df.limit(look).collect()
    if len(rows) == look:
        width = max(1, len(pickle.dumps(rows)) // look)
        allowed = min(max_rows, max_bytes // width)
        rows = df.limit(allowed + 1).collect() if allowed >= look else None
        if rows is None or len(rows) > allowed:
            return None
    return rows if len(pickle.dumps(rows)) <= max_bytes else None


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """Join side for a table that is expected to be small.

    Measured first: a small one becomes a local relation with a broadcast hint, so the big side of the
    join is not shuffled. A larger one is returned as it is; the join then shuffles and AQE splits hot keys.
    """
    rows = small_rows(df, max_rows, max_bytes)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every node can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="labelrank-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/labelrank/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give ``checkpoint()`` a folder where the session has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written once to the shared folder and read back.

    For a derived table that several jobs read: each reads the columns it needs instead of deriving the
    table again, and a lost executor loses none of it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete the files behind a table from ``staged``, once nothing reads it any more."""
    spark = stored.sparkSession
    for folder in {f.rpartition("/")[0] for f in stored.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A stored table that has fewer parts than there are cores, spread over all cores.

    For work that is heavy per row. A table with enough parts is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def at_least_cores(spark: SparkSession, parallelism: int) -> int:
    """Fits to run at the same time so that fits of one task each leave no core idle; 1 stays one by one."""
    return max(parallelism, spark.sparkContext.defaultParallelism) if parallelism > 1 else parallelism


def at_once(spark: SparkSession, actions: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Results of all actions, in their order; up to ``parallelism`` of them run at the same time.

    For actions that each start Spark jobs too small to fill the cluster. The first failure is raised.
    """
    if parallelism <= 1:
        return [action() for action in actions]
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(action)) for action in actions]]
