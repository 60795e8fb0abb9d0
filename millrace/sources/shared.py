"""Tables that are written to cut a lineage or to use a result twice.

They go below the folder that the cluster names in ``spark.checkpoint.dir``,
which the driver and all executors share, so a lost executor costs nothing.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Collection, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Application, scope and path of each table. A scope is its thread's own, so that jobs that run beside each other keep their tables apart.
_WRITTEN: list[tuple[str, str, str]] = []
_LOCK = threading.Lock()
_OWN = threading.local()


def _scopes() -> list[str]:
    if not hasattr(_OWN, "scopes"):
        _OWN.scopes = [""]
    return _OWN.scopes


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A local session without one gets a temporary folder, as in tests. On a
    cluster such a folder would lie on each machine's own disk, so there the
    setting is required.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def shipped(spark: SparkSession) -> str:
    """Sends the package to the executors of a running session, whose tasks import it by name; returns the archive's path.

    A session whose executors have the package installed, or were started with it in ``--py-files``, needs no call.
    """
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*")):
            if file.is_file() and "__pycache__" not in file.parts:
                out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))  # Spark's own file service hands it out
    return str(archive)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    with _LOCK:
        _WRITTEN.append((spark.sparkContext.applicationId, _scopes()[-1], path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables that this thread writes inside belong to the name, so that ``release`` can delete them apart from others."""
    _scopes().append(name)
    try:
        yield
    finally:
        _scopes().pop()


def release(spark: SparkSession, *scopes: str, keep: Collection[str] = ()) -> int:
    """Deletes the tables that ``written`` has made in this application so far, or those of the scopes, and returns how many.

    Tables that hold one of the files in ``keep`` (such as ``df.inputFiles()`` of what is still to be read) stay. Results that still read others must have been
    written elsewhere before. A long-lived session calls it between jobs; folders of ended sessions are
    the cluster's to clear.
    """
    jvm, conf, own = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext.applicationId
    held = {part for file in keep for part in file.split("/")}
    with _LOCK:
        gone = [w for w in _WRITTEN if w[0] == own and (not scopes or w[1] in scopes) and w[2].rsplit("/", 1)[1] not in held]
        _WRITTEN[:] = [w for w in _WRITTEN if w not in gone]
    paths = [jvm.org.apache.hadoop.fs.Path(path) for _, _, path in gone]
    return sum(bool(path.getFileSystem(conf).delete(path, True)) for path in paths)
