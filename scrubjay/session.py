"""Session settings that the library counts on, and the name of the row id."""

from __future__ import annotations

from contextvars import ContextVar
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Hidden column with the stable, 0-based id of a row.
ROW_ID = "__rid"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set what the library counts on: names told apart by case, UTC, time-of-day values."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` (or the context's checkpoint folder)
    names.  Only a local session may go without: it gets a fresh folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="scrubjay-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: The run whose scratch tables are written at the moment, in this thread (or task) alone.
_running: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


class Scratch:
    """The scratch tables of one run, in a folder of their own; other runs' are never touched.

    ``with Scratch(spark) as scratch:`` puts what is written meanwhile in this
    thread there, a run within a run in a folder within the folder.  Nothing is
    deleted by leaving the block: frames are lazy, and who has written the
    result calls ``delete``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, outer = spark, _running.get()
        self.folder = f"{outer.folder if outer else scratch_dir(spark)}/scrubjay-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._store = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def __enter__(self) -> Scratch:
        self._token = _running.set(self)
        return self

    def __exit__(self, *_) -> None:
        _running.reset(self._token)

    def clear(self, keep: DataFrame | None = None) -> int:
        """Delete the tables written so far, but for those that ``keep`` reads; how many went.

        Frames that read them lazily must have been written elsewhere before.
        """
        held = keep.inputFiles() if keep is not None else []
        written = self._store.listStatus(self._path) if self._store.exists(self._path) else []
        gone = [x.getPath() for x in written if not any(f"/{x.getPath().getName()}/" in f for f in held)]
        for path in gone:
            self._store.delete(path, True)
        return len(gone)

    def delete(self) -> None:
        """Delete all of the run's tables."""
        self._store.delete(self._path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, or in the running Scratch's."""
    run = _running.get()
    return f"{run.folder if run else scratch_dir(spark)}/scrubjay-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run of
    everything before.  The schema is kept, so empty tables work too.
    """
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
