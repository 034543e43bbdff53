"""Session helpers: where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only where the session names none, and runs in one local JVM, is a temporary
    folder of this machine used; on a cluster that is an error, as other machines
    could not read what is written there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a table
    that survives the loss of executors, and later scans prune its columns. The shuffle
    files of the write go with its end, as nothing reads them again; the table goes with
    the session's JVM, if ``discard`` hasn't removed it by then."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    SharedFolder(spark, path).remove_at_exit()
    return spark.read.schema(df.schema).parquet(path)


def whole_files(spark: SparkSession) -> SparkSession:
    """A session beside ``spark``, whose scans give each file to one task, whole. What it
    reads takes part in plans of ``spark`` as the right side of a join."""
    beside = spark.newSession()
    for setting in ("maxPartitionBytes", "openCostInBytes"):
        beside.conf.set(f"spark.sql.files.{setting}", 1 << 50)
    return beside


#: Inputs with less than this for each core are spread before heavy work on their rows.
SPREAD_BYTES = 2 << 20


def spread(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """A small input over all cores, however few files or row groups it lies in. Large
    inputs have splits enough, and are not moved. ``of`` is the input that ``df`` was
    filtered from, if it was: then its size counts, and only what is left of it moves."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str((df if of is None else of)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BYTES * cores else df


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, once nothing will read it again."""
    spark = df.sparkSession
    home = shared_dir(spark).split(":")[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":")[-1].lstrip("/").startswith(home + "/"):
            SharedFolder(spark, folder).remove()


def partitions_of(df: DataFrame, each: int = 8 << 20) -> int:
    """How many partitions a table that ``materialize`` wrote is worked on in: by its bytes,
    whatever the session's number, and no fewer than there are cores."""
    spark = df.sparkSession
    size = sum(SharedFolder(spark, folder).size() for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()})
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once per application, so that
    they need no copy of it on their own path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessera-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))


class SharedFolder:
    """Small files in a folder of any file system that the session reaches.

    A file appears whole or not at all: it is written under another name, then renamed.
    ``create`` fails if the name is taken, which makes numbered records a log with one
    winner per number.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        root = self._at("")
        return [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        draft = f".draft-{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.exists(name) and self._fs.rename(self._at(draft), self._at(name)):
            return True
        self._fs.delete(self._at(draft), False)
        return False

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def remove_at_exit(self) -> None:
        self._fs.deleteOnExit(self._at(""))

    def changed(self) -> tuple[int, int]:
        """The folder's or file's time of change, and size: others, once it is replaced."""
        status = self._fs.getFileStatus(self._at(""))
        return status.getModificationTime(), status.getLen()

    def size(self, name: str = "") -> int:
        return int(self._fs.getContentSummary(self._at(name)).getLength()) if self.exists(name) else 0
