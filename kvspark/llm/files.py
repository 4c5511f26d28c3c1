"""Plain files in shared folders, read and written by tasks: a byte range at a time.

Local and mounted paths are opened directly, other schemes by Arrow's file systems.
Lists of files come from Hadoop's, on the driver.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)


def writer(uri: str) -> pa.NativeFile:
    """A new file; its folder is made if need be. It counts from its being closed on."""
    system, path = place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, buffer_size=1 << 20)


def reader(uri: str) -> pa.NativeFile:
    """A file for ``read_at``."""
    system, path = place(uri)
    return system.open_input_file(path)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files at a path, below a folder, or by a glob; those whose names begin with _ or . are no data."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: list[tuple[str, int]] = []
    for status in system.globStatus(p) or ():
        every = system.listFiles(status.getPath(), True)
        while every.hasNext():
            f = every.next()
            if not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)
