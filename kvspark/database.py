"""A database: a folder of independent tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidTableNameError, TableExistsError, TableNotFoundError
from .sources.store import place
from .table import Table


def validate_name(name: str) -> str:
    """Any name but the empty one, paths, and dots."""
    if not name or "/" in name or "\\" in name or name in (".", ".."):
        raise InvalidTableNameError(f"not a table name: {name!r}")
    return name


class Database:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._open: dict[str, Table] = {}
        self._store = place(spark, folder)
        self._store.make()

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, validate_name(name))

    def create_table(self, name: str, **options) -> Table:
        """A new table; an error if anything of that name is there."""
        if self._store.exists(validate_name(name)):
            raise TableExistsError(name)
        return self.table(name, **options)

    def table(self, name: str, **options) -> Table:
        """The table of that name, created on demand; the same handle while it is open."""
        path = self._path(name)
        if name not in self._open:
            self._open[name] = Table(self.spark, path, **options)
        return self._open[name]

    def delete_table(self, name: str) -> None:
        """Renamed first, so the name is gone at once; then removed. Fails if the table is open elsewhere."""
        path = self._path(name)
        if not self._store.is_folder(name):
            raise TableNotFoundError(name)
        if name in self._open:
            self._open.pop(name).close()
        lock = place(self.spark, path).lock()
        gone = f".deleted-{uuid.uuid4().hex}"
        self._store.rename(name, gone)
        lock.release()
        self._store.remove(gone)

    def list_tables(self) -> list[str]:
        """Sorted names of the folders that hold a table."""
        return sorted(n for n in self._store.names() if not n.startswith(".deleted-") and self._store.is_folder(f"{n}/_commits"))

    def tables_df(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.list_tables()], "table_name string")

    def register_views(self) -> None:
        """Every open table's state as a temporary view, for SQL."""
        for name, table in self._open.items():
            table.df().createOrReplaceTempView(name)

    def close(self) -> None:
        for t in self._open.values():
            t.close()
        self._open = {}

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
