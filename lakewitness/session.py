"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import cached_property
from pathlib import Path
from threading import Lock, RLock

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

_LOCAL_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SHIPPING = Lock()
# Tasks that ``together`` runs at a time.
LANES = 4
# Seconds a broadcast may take while ``together`` runs: its job waits for the stages of earlier ones, however long they are.
PATIENCE = 86_400
BROADCAST_TIMEOUT = "spark.sql.broadcastTimeout"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# By application and setting: how many threads hold it, and the value to be restored by the last one.
_HELD: dict[tuple[str, str], tuple[int, str | None]] = {}
_MAKING = Lock()


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("lakewitness")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, where results that must outlive an executor go.

    A temporary folder is taken only where nothing is configured and the master is local; on a
    cluster a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="lakewitness-")
    return _LOCAL_FOLDERS[sc.applicationId]


def new_path(spark: SparkSession, name: str = "") -> str:
    """A path nothing uses yet, in the folder of this application, which may be deleted when the application has ended."""
    return f"{shared_folder(spark).rstrip('/')}/lakewitness/{spark.sparkContext.applicationId}/{name}{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Hold a setting of the session; when several threads do, the last one restores it."""
    key = spark.sparkContext.applicationId, name
    with _MAKING:
        users, before = _HELD.get(key, (0, None))
        if not users:
            before = spark.conf.get(name, None)
            spark.conf.set(name, value)
        _HELD[key] = users + 1, before
    try:
        yield
    finally:
        with _MAKING:
            users, before = _HELD.pop(key)
            if users > 1:
                _HELD[key] = users - 1, before
            elif before is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write a relation that several later queries read to the shared folder, cutting its lineage.

    A written table is computed once, survives lost executors, and its file sizes let the planner
    broadcast small evidence and shuffle large evidence. The shuffle files behind the table are deleted once it is written, not when the
    driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark)
    with _setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class shared(cached_property):
    """A ``cached_property`` that tasks of ``together`` may ask for at the same time: the first one makes it, the others wait."""

    def __get__(self, instance, owner=None):
        if instance is None:
            return self
        with _MAKING:
            lock = instance.__dict__.setdefault("_making", {}).setdefault(self.attrname, RLock())
        with lock:
            return super().__get__(instance, owner)


def together(spark: SparkSession, tasks: list[Callable[[], object]]) -> list:
    """Results of tasks that need nothing of each other: while the jobs of one leave cores idle, those of the others run.

    Tasks may share relations that are ``shared``.
    """
    with _setting(spark, BROADCAST_TIMEOUT, str(PATIENCE)), ThreadPoolExecutor(LANES) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def is_input_error(error: Exception) -> bool:
    """Whether an error comes from the data or the request, and not from the cluster (a lost executor, a full disk).

    Errors of Spark that name a condition, such as a failed cast or an unreadable file, are about the data; an aborted job
    names none.
    """
    if isinstance(error, Py4JJavaError):
        return str(error.java_exception.getMessage()).startswith("[")
    return isinstance(error, (PySparkException, ValueError, KeyError, TypeError, ArithmeticError))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; Python functions in tasks import it there."""
    sc = spark.sparkContext
    with _SHIPPING:
        if sc.applicationId in _SHIPPED:
            return
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="lakewitness-")) / "lakewitness.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
