"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

# Plan settings every job relies on.  The skew rule has to win over an extra shuffle:
# one partner, company code or export file may hold a third of all rows.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # HotSpot never compiles a longer method: such a stage runs operator by operator
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # a table in folders is written without sorting its rows by folder, which keeps their order in
    # a folder as well; a task with more folders sorts the rest (no table here has as many)
    "spark.sql.maxConcurrentOutputFileWriters": "32",
    # as Spark has them; TABLE_SETTINGS differ
    "spark.sql.sources.fileCompressionFactor": "1.0",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "false",
}

# For queries on the tables of exports, whose stages are tables of their own.
TABLE_SETTINGS = {
    # keys and codes take about a tenth of their size in a file: what is sent to all executors, and
    # built by the driver, is told by the size it has there
    "spark.sql.sources.fileCompressionFactor": "10.0",
    # nothing reads a shuffle again once its table is written
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

JOBS_AT_ONCE = 8


def at_once(work: Callable, jobs: Iterable) -> list:
    """Results of `work` for every job; Spark fills its cores from several plans at a time."""
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        return list(pool.map(work, jobs))


class Stages(Mapping):
    """Results by name, each made once, when it is first asked for."""

    def __init__(self, names: Iterable[str], make: Callable[[str], object]) -> None:
        self._make, self._made = make, {}
        self._locks = {name: threading.Lock() for name in names}

    def __getitem__(self, name: str):
        with self._locks[name]:
            if name not in self._made:
                self._made[name] = self._make(name)
            return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._locks)

    def __len__(self) -> int:
        return len(self._locks)

    def __contains__(self, name: object) -> bool:
        return name in self._locks

    def all(self) -> Stages:
        """Make what is still to be made, several at a time."""
        at_once(self.__getitem__, list(self))
        return self


def tune(spark: SparkSession) -> SparkSession:
    """Apply the plan settings to a running session."""
    for key, value in PLAN_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def tune_tables(spark: SparkSession) -> SparkSession:
    """Apply the settings for queries on the tables of exports as well."""
    tune(spark)
    for key, value in TABLE_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "ledgercheck") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in PLAN_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a working folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_folders(spark: SparkSession, pattern: str) -> None:
    """Remove all working folders a pattern names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(path) or ():
        files.delete(status.getPath(), True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder the cluster names in spark.checkpoint.dir.

    Only a session that names none (a test on one machine) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="ledgercheck-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
