"""Versioned key-value tables on Spark: byte keys, typed values, newest committed entry wins."""

from .database import Database
from .errors import CorruptDataError, InvalidTableNameError, KVError, KVIOError, TableExistsError, TableLockedError, TableNotFoundError, UnexpectedValueError
from .functions.bounds import EXCLUDED, INCLUDED, UNBOUNDED, Bound, prefix_successor
from .functions.values import Value
from .table import Table
from .txn import Txn

__all__ = [
    "Database", "Table", "Txn", "Value", "Bound", "EXCLUDED", "INCLUDED", "UNBOUNDED", "prefix_successor",
    "KVError", "KVIOError", "TableLockedError", "InvalidTableNameError", "TableExistsError", "TableNotFoundError", "UnexpectedValueError", "CorruptDataError",
]
