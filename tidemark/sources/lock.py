"""An advisory lock for files that several processes on one machine share.

Spark's own writers need none (they commit by rename); this is for driver-side tools that update a container file in
place. Writers put up a sentinel file ``<path>.lock``; readers wait while it stands, then share the lock.
"""

from __future__ import annotations

import fcntl
import os
import time
from collections.abc import Iterator
from contextlib import contextmanager

from tidemark.exceptions import CouldNotAcquireFileLockError

# Seconds that readers and writers wait at most, and between attempts.
READ_WAIT, WRITE_WAIT, POLL = 30.0, 60.0, 0.1


def sentinel(path: str) -> str:
    return f"{path}.lock"


@contextmanager
def locked(path: str, mode: str, wait: float | None = None) -> Iterator[int]:
    """A descriptor of ``path`` under a shared ('r') or exclusive ('w') lock; 'w' neither creates nor empties the file early."""
    if mode not in ("r", "w"):
        raise ValueError(f"lock mode {mode!r} is neither 'r' nor 'w'")
    until = time.monotonic() + ((READ_WAIT if mode == "r" else WRITE_WAIT) if wait is None else wait)
    mine = handle = None
    try:
        while handle is None:
            if mode == "w" and mine is None:
                try:
                    mine = os.open(sentinel(path), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                except FileExistsError:
                    pass
            if mine is not None or (mode == "r" and not os.path.exists(sentinel(path))):
                fd = os.open(path, os.O_RDONLY if mode == "r" else os.O_RDWR | os.O_CREAT)
                try:
                    fcntl.flock(fd, (fcntl.LOCK_SH if mode == "r" else fcntl.LOCK_EX) | fcntl.LOCK_NB)
                    handle = fd
                    break
                except OSError:
                    os.close(fd)
            if time.monotonic() >= until:
                raise CouldNotAcquireFileLockError(f"{path} stayed locked")
            time.sleep(POLL)
        yield handle
    finally:
        if handle is not None:
            os.close(handle)
        if mine is not None:
            os.close(mine)
            os.unlink(sentinel(path))
