"""What can go wrong."""


class KVError(Exception):
    """Base of all errors raised here."""


class KVIOError(KVError, OSError):
    """The storage failed."""


class TableLockedError(KVIOError):
    """The table is open elsewhere."""


class InvalidTableNameError(KVError, ValueError):
    """Empty, a path, or a dot name."""


class TableExistsError(KVError):
    """create_table on a name that is taken."""


class TableNotFoundError(KVError):
    """delete_table on a name that isn't there."""


class UnexpectedValueError(KVError):
    """A cell of another kind was read through the bytes interface."""


class CorruptDataError(KVError):
    """Stored data can't be what was written."""
