"""Interactive transactions: buffered mutations over a pinned version, committed in one piece."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from .errors import KVError
from .functions.values import LOG, Value
from .operators import resolve


class Txn:
    """Reads its own writes. Leaving the ``with`` block without ``commit`` rolls back."""

    def __init__(self, table):
        self._table, self._version, self._own, self._open = table, table.version, {}, True

    def _check(self) -> None:
        if not self._open:
            raise KVError("the transaction has ended")

    def set_value(self, key: bytes, value: Any) -> None:
        self._check()
        self._own[bytes(key)] = Value.of(value)

    def put(self, key: bytes, value: bytes) -> None:
        self.set_value(key, Value("bytes", bytes(value)))

    def delete(self, key: bytes) -> None:
        self._check()
        self._own[bytes(key)] = None

    delete_value = delete

    def get_value(self, key: bytes) -> Value | None:
        self._check()
        key = bytes(key)
        return self._own[key] if key in self._own else self._table.get_value(key)

    def get(self, key: bytes) -> bytes | None:
        v = self.get_value(key)
        return None if v is None else v.as_bytes()

    def df(self) -> DataFrame:
        """What the transaction sees, as key, value."""
        self._check()
        rows = [(bytearray(k), "D" if v is None else "P", v and v.row(), 0, i) for i, (k, v) in enumerate(self._own.items())]
        own = self._table.spark.createDataFrame(rows, LOG)
        return resolve.state(resolve.overlay(self._table.log_df(self._version), own), "over", "at")

    def commit(self) -> None:
        self._check()
        if self._table.version != self._version:
            raise KVError("the table changed under the transaction")
        self._open = False
        self._table.write(self._own.items())

    def rollback(self) -> None:
        self._open = False
        self._own = {}

    def __enter__(self) -> Txn:
        return self

    def __exit__(self, *_: object) -> None:
        if self._open:
            self.rollback()
