"""Small files in the store that Spark writes to: whole reads, streams, and a journal of versions.

All of it goes through Hadoop's file systems, so a folder may lie on HDFS, in
an object store or on a disk.
"""

from __future__ import annotations

import io
import json
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was faster."""


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


class _Out(io.RawIOBase):
    """A file that is written from beginning to end."""

    def __init__(self, stream):
        self._stream, self._n = stream, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._stream.write(bytes(data))
        self._n += len(data)
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def open_write(spark: SparkSession, path: str) -> io.BufferedWriter:
    """A stream to a new or replaced file; folders are made."""
    place, files = _at(spark, path)
    return io.BufferedWriter(_Out(files.create(place, True)), 1 << 20)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file as a whole."""
    place, files = _at(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


class Journal:
    """Versions of a small record: each is written whole under its number, and the highest counts.

    A version is written beside its place and then renamed, which fails if the
    place is taken; so a reader never sees half of one, and of two writers that
    have read the same version the second is refused.  HDFS does that as one
    step; a disk doesn't, so writers in one process take turns there.
    """

    _turn = threading.Lock()

    def __init__(self, spark: SparkSession, folder: str, keep: int = 20):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self.version = 0

    def _versions(self) -> list[int]:
        place, files = _at(self.spark, self.folder)
        names = [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _name(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.json"

    def read(self) -> dict | None:
        """The newest record, whose version is then the one that a commit follows; None if there is none."""
        found = self._versions()
        self.version = found[-1] if found else 0
        return json.loads(read_bytes(self.spark, self._name(self.version))) if found else None

    def commit(self, record: dict) -> int:
        """Write the next version; raises Conflict if there is one already."""
        beside = f"{self.folder}/.{uuid.uuid4().hex}"
        with open_write(self.spark, beside) as out:
            out.write(json.dumps(record, default=str).encode())
        fs, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        source, target = fs.Path(beside), fs.Path(self._name(self.version + 1))
        _, files = _at(self.spark, self.folder)
        context = fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        how = gateway.new_array(getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # never over an existing file
        try:
            with self._turn:
                if (newest := max(self._versions(), default=0)) != self.version:
                    raise Conflict(f"{self.folder}: version {newest} has been written since version {self.version} was read")
                context.rename(source, target, how)
        except Exception as e:
            files.delete(source, False)
            if isinstance(e, Py4JJavaError) and "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{self._name(self.version + 1)}: another writer was faster") from e
            raise
        self.version += 1
        for old in self._versions()[: -self.keep]:
            files.delete(fs.Path(self._name(old)), False)
        return self.version
