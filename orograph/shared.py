"""Tables in the folder that all executors share, to cut lineage in iterations."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. One of our own only where it is unset and
    Spark runs in one process; elsewhere executors couldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="orograph-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Makes Spark drop the shuffle files of a query once it has ended.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _State:
    """What the driver remembers. A copy that travels to a task is empty."""

    def __init__(self):
        self.lock, self.writers, self.before = threading.Lock(), 0, "false"
        self.written: list[str] = []
        self.named: dict[int, list[list[str]]] = {}  # by thread: the lists of ``tables``

    def __reduce__(self):
        return _State, ()


_state = _State()


class _dropping_shuffles:
    """Sets the option while any thread writes, and puts it back after the last."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        with _state.lock:
            if not _state.writers:
                _state.before = self.conf.get(_DROP_SHUFFLES, "false")
                self.conf.set(_DROP_SHUFFLES, "true")
            _state.writers += 1

    def __exit__(self, *error):
        with _state.lock:
            _state.writers -= 1
            if not _state.writers:
                self.conf.set(_DROP_SHUFFLES, _state.before)


def folder_of(spark: SparkSession) -> str:
    """A new path in the shared folder. It goes when the driver ends, or with ``clear``."""
    path = f"{shared_folder(spark).rstrip('/')}/orograph-{uuid.uuid4().hex}"
    if not _state.written:
        atexit.register(_at_exit)
    _state.written.append(path)
    for named in _state.named.get(threading.get_ident(), []):
        named.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read from there: later stages don't depend
    on executors that computed it, nothing is computed twice, and the shuffle files behind
    it go as soon as it is written. The table goes when the driver ends, or with ``clear``."""
    spark = df.sparkSession
    path = folder_of(spark)
    with _dropping_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_seeing(df: DataFrame, *ends: Column) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates of the rows by name, taken as they are written: no scan more.
    Only for least and greatest values, which a task that is run again doesn't change."""
    seen = Observation()
    done = cut(df.observe(seen, *ends))
    return done, seen.get


@contextmanager
def tables():
    """A list to which the paths of all tables are added that ``cut`` writes meanwhile in
    this thread, in their order."""
    named: list[str] = []
    own = _state.named.setdefault(threading.get_ident(), [])
    own.append(named)
    try:
        yield named
    finally:
        own[:] = [x for x in own if x is not named]


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables that ``cut`` wrote. What reads them can't be used after."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in list(paths):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _state.written:
            _state.written.remove(name)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that ``cut`` wrote so far. What reads them can't be used after."""
    drop(spark, _state.written)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clear(spark)
