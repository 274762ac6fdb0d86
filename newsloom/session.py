"""Session helpers: shared scratch folder, package shipping, measured broadcasts."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def ship_package() -> None:
    """Send the few Python helpers with the jobs, so workers need no install."""
    cloudpickle.register_pickle_by_value(sys.modules["newsloom"])


_SPREAD_TASKS = 64
_DEALT_BYTES = 4 << 20  # of texts that one task works on
_scratch: list[str] = []  # what this session has written and not removed


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where everything runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="newsloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder on whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_paths() -> tuple[str, ...]:
    """The scratch paths of this session that are not removed yet."""
    return tuple(_scratch)


def clear_scratch(spark: SparkSession, paths) -> None:
    """Remove scratch paths that nothing reads any more."""
    for path in paths:
        if path in _scratch:
            _scratch.remove(path)
            remove_path(spark, path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; one that is not there yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: read column-wise by several consumers, and the lineage ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes the session allows for a broadcast side; 0 when broadcasts are off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text[:-1] if text.endswith("b") else text
    size = int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)
    return max(size, 0)


def measured_bytes(df: DataFrame) -> int:
    """Size of a table as text, measured in one distributed pass."""
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()
    return row["n"] or 0


#: State on disk instead of a map in the heap that every batch copies; a batch writes its changes only, in bounded memory.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def state_per_core(spark: SparkSession):
    """A stream that is started inside deals its state over a partition per core, or over fewer if the session says so.

    Every batch writes every partition of the state, however few rows it has, so
    more of them only lengthen a batch.  The state is on disk, unless the session
    names a store.  A stored checkpoint keeps its number and its store.
    """
    name = "spark.sql.shuffle.partitions"
    settings = {name: str(min(int(spark.conf.get(name)), spark.sparkContext.defaultParallelism))}
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None:
        settings |= _STATE
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spread(df: DataFrame, key: str) -> DataFrame:
    """More tasks for a small stored table whose rows are costly to work on.

    A table whose scan already has a task per core, or _SPREAD_TASKS tasks, is
    returned as it is, so a large one is never shuffled here, however many
    cores there are.  Only for scans: counting the partitions of a plan with a
    shuffle would run it.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, _SPREAD_TASKS)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def dealt(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """Rows with texts that are costly to work on, dealt evenly over tasks: one per _DEALT_BYTES, at least one per core.

    `size` is the number of bytes of the texts.  The files of a scan say little
    about the work in them: texts that are alike take hardly any room.  `keys`
    must tell rows apart, so that no task gets many of them.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // _DEALT_BYTES))
    return df.repartition(tasks, *keys)
