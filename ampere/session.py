"""Session helpers: building a local session for tests/bench, finding the
shared checkpoint folder on a cluster and sending the package to its workers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ampere") -> SparkSession:
    """Session for tests and the bench. On a cluster, build your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # call-site capture for error messages costs py4j round trips on every
        # functions.* call while plans are built; off for batch runs
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("AMPERE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: (application, folder) found to be shared by driver and executors
_SHARED: set[tuple[str, str]] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that is used
    as is, also where it is a mount under ``file:`` that all machines share.
    Without the setting a cluster uses a folder in the warehouse, and a
    local-mode session (tests, bench) a fresh one under /tmp. On a cluster, a
    ``file:`` folder is tried once per application: one that executors write
    to but the driver does not see raises. Spark makes a subfolder of its own
    per application; it is removed when the application ends.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():  # Spark sets it from spark.checkpoint.dir itself where it can
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _unnamed_folder(spark))
    folder = sc.getCheckpointDir()
    seen = (sc.applicationId, folder)
    if not sc.master.startswith("local") and seen not in _SHARED:
        if _file_system(spark, folder).getScheme() == "file":
            _require_shared(spark, folder)
        _SHARED.add(seen)
    return delete_on_exit(spark, folder)


def _unnamed_folder(spark: SparkSession) -> str:
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="ampere-ckpt-", dir="/tmp")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ampere-checkpoints"


def _require_shared(spark: SparkSession, folder: str) -> None:
    """Raise unless the driver sees every file that tasks write to a folder."""
    tasks = max(2, min(spark.sparkContext.defaultParallelism, 64))
    probe = f"{folder.rstrip('/')}/shared-{uuid.uuid4().hex}"
    spark.range(0, tasks, 1, tasks).write.parquet(probe)
    seen = _part_files(spark, probe)
    if seen < tasks:
        raise RuntimeError(f"the checkpoint folder is {folder}: the driver sees {seen} of {tasks} files that executors wrote there; "
                           "set spark.checkpoint.dir to a folder that all machines share")


def _part_files(spark: SparkSession, path: str) -> int:
    """Part files of a table that the driver sees; the table is removed."""
    files, p = _file_system(spark, path), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = sum(f.getPath().getName().startswith("part-") for f in files.listStatus(p))
    files.delete(p, True)
    return found


def delete_on_exit(spark: SparkSession, path: str) -> str:
    """Have the file system remove ``path`` when the application ends."""
    _file_system(spark, path).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _file_system(spark: SparkSession, path: str):
    """The file system of a path (one without a scheme: the default one)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: application -> the folder that holds the package sent to its executors
_SENT: dict[str, tempfile.TemporaryDirectory] = {}
_SENDING = threading.Lock()


def send_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as
    ``--py-files`` would: a worker need not find the driver's folders. Called
    before a function that uses other parts of the package goes to workers."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    with _SENDING:
        if sc.applicationId in _SENT or not package.is_dir():  # in an archive: it was sent to the driver too
            return
        folder = tempfile.TemporaryDirectory(prefix=f"{package.name}-package-")
        archive = f"{folder.name}/{package.name}-package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        sc.addPyFile(archive)
        _SENT[sc.applicationId] = folder
