"""One writer a table: an exclusive, non-blocking lock on the driver."""

from __future__ import annotations

import os

from ..errors import KVIOError, TableLockedError

try:
    import fcntl
except ImportError:  # not on this platform
    fcntl = None


class TableLock:
    def __init__(self, folder: str):
        self._fd = None
        try:
            self._fd = os.open(os.path.join(folder, "LOCK"), os.O_RDWR | os.O_CREAT, 0o644)
            if fcntl:
                fcntl.flock(self._fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            os.close(self._fd)
            self._fd = None
            raise TableLockedError(f"table is already open: {folder}") from None
        except OSError as e:
            raise KVIOError(str(e)) from e

    def release(self) -> None:
        if self._fd is not None:
            os.close(self._fd)  # closing lets go of the lock
            self._fd = None
