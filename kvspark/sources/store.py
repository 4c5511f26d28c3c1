"""Where a table's commits and flushed runs are put: a mounted folder, or any store that Hadoop's file systems reach.

A plain path is a mounted folder, written by the driver's own calls: link, fsync, flock.
A URI (``hdfs://``, ``abfs://``, ``file://``, ...) goes through Hadoop's file systems. There
a commit is published by a rename that fails where the name is taken. HDFS and
ABFS do that in one step; a store without such a step needs a single writer. No lock is held: of two writers
one's commit fails, and ``vacuum`` is for times without another writer. Names are relative to the folder.
"""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

from ..errors import KVIOError
from .lock import TableLock


def place(spark: SparkSession, folder: str) -> Local | Hadoop:
    return Hadoop(spark, folder) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", folder) else Local(folder)


@contextlib.contextmanager
def _errors(what: str):
    try:
        yield
    except (OSError, Py4JError) as e:
        raise KVIOError(f"{what}: {getattr(e, 'java_exception', e)}") from e


def sync_folder(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


class Local:
    def __init__(self, folder: str):
        self.folder = folder

    def _at(self, name: str) -> str:
        return os.path.join(self.folder, name) if name else self.folder

    def make(self, name: str = "") -> None:
        with _errors(name):
            os.makedirs(self._at(name), exist_ok=True)

    def exists(self, name: str) -> bool:
        return os.path.lexists(self._at(name))

    def is_folder(self, name: str) -> bool:
        return os.path.isdir(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder; nothing if it isn't there."""
        with _errors(name), contextlib.suppress(FileNotFoundError):
            return os.listdir(self._at(name))
        return []

    def read(self, name: str) -> bytes:
        with _errors(name), open(self._at(name), "rb") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        """A file, durable with the folders above it when this returns."""
        path = self._at(name)
        with _errors(name):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            for _ in name.split("/"):
                path = os.path.dirname(path)
                sync_folder(path)

    def publish(self, name: str, data: bytes) -> None:
        """A file that is there whole and durable or not at all; an error if the name is taken."""
        final = self._at(name)
        temp = os.path.join(os.path.dirname(final), f".{uuid.uuid4().hex}.tmp")
        try:
            with _errors(name):
                with open(temp, "wb") as f:
                    f.write(data)
                    f.flush()
                    os.fsync(f.fileno())
                os.link(temp, final)
                sync_folder(os.path.dirname(final))
        finally:
            with contextlib.suppress(OSError):
                os.unlink(temp)

    def remove(self, name: str) -> None:
        """Delete a file, or a folder with what is in it, if it is there."""
        path = self._at(name)
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        else:
            with _errors(name), contextlib.suppress(FileNotFoundError):
                os.unlink(path)

    def rename(self, old: str, new: str) -> None:
        with _errors(old):
            os.rename(self._at(old), self._at(new))

    def lock(self) -> TableLock:
        return TableLock(self.folder)


class Hadoop:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self._context = spark.sparkContext
        self._hadoop = spark._jvm.org.apache.hadoop
        self._bytes = spark._jvm.org.apache.commons.io.IOUtils.toByteArray
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._hadoop.fs.Path(folder)
        with _errors(folder):
            self._fs = root.getFileSystem(conf)
            self._files = self._hadoop.fs.FileContext.getFileContext(root.toUri(), conf)

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def make(self, name: str = "") -> None:
        with _errors(name):
            self._fs.mkdirs(self._at(name))

    def exists(self, name: str) -> bool:
        with _errors(name):
            return self._fs.exists(self._at(name))

    def is_folder(self, name: str) -> bool:
        with _errors(name):
            return self._fs.exists(self._at(name)) and self._fs.getFileStatus(self._at(name)).isDirectory()

    def names(self, name: str = "") -> list[str]:
        with _errors(name):
            return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))] if self._fs.exists(self._at(name)) else []

    def read(self, name: str) -> bytes:
        with _errors(name):
            stream = self._fs.open(self._at(name))
            try:
                return bytes(self._bytes(stream))
            finally:
                stream.close()

    def write(self, name: str, data: bytes) -> None:
        with _errors(name):
            out = self._fs.create(self._at(name), False)
            try:
                out.write(bytearray(data))
                out.hsync()
            finally:
                out.close()

    def publish(self, name: str, data: bytes) -> None:
        parent = name.rpartition("/")[0]
        temp = f"{parent}/.{uuid.uuid4().hex}.tmp"
        try:
            self.write(temp, data)
            self._rename(temp, name)
        finally:
            with contextlib.suppress(KVIOError):
                self.remove(temp)

    def _rename(self, old: str, new: str) -> None:
        kind = self._hadoop.fs.Options.Rename
        never_over = self._context._gateway.new_array(kind, 1)
        never_over[0] = kind.NONE
        with _errors(old):
            self._files.rename(self._at(old), self._at(new), never_over)

    def remove(self, name: str) -> None:
        with _errors(name):
            self._fs.delete(self._at(name), True)

    def rename(self, old: str, new: str) -> None:
        self._rename(old, new)

    def lock(self) -> NoLock:
        return NoLock()


class NoLock:
    """In place of a lock where there is none."""

    def release(self) -> None:
        pass
