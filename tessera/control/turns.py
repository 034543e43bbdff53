"""One refresh at a time, and of a burst of requests at most one more that waits."""

from __future__ import annotations

import errno
import fcntl
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

GO, COVERED, GAVE_UP = "go", "covered", "gave up"
POLL_S, NOTICE_S = 0.05, 1.0


class _Flock:
    def __init__(self, path: str):
        self.path, self._fd = path, -1

    def try_lock(self) -> bool:
        """Whether it is ours now. A file system that cannot lock doesn't keep us out."""
        if self._fd < 0:
            self._fd = os.open(self.path, os.O_RDWR | os.O_CREAT | os.O_CLOEXEC, 0o666)
        try:
            fcntl.flock(self._fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            return e.errno not in (errno.EWOULDBLOCK, errno.EAGAIN, errno.EACCES)
        return True

    def release(self) -> None:
        if self._fd >= 0:
            os.close(self._fd)
            self._fd = -1


def _wait(lock: _Flock, give_up_s: float | None, notice: Callable[[str], None]) -> bool:
    began, told = time.monotonic(), False
    while not lock.try_lock():
        waited = time.monotonic() - began
        if give_up_s is not None and waited >= give_up_s:
            return False
        if waited >= NOTICE_S and not told:
            notice("waiting for another refresh of the index to finish")
            told = True
        time.sleep(POLL_S)
    return True


@contextmanager
def exclusive(index: str, notice: Callable[[str], None] = lambda _: None) -> Iterator[None]:
    """Hold the index's lock: ``<index>.lock`` beside it."""
    lock = _Flock(f"{index}.lock")
    try:
        _wait(lock, None, notice)
        yield
    finally:
        lock.release()


@contextmanager
def turn(index: str, give_up_s: float | None = None, notice: Callable[[str], None] = lambda _: None) -> Iterator[str]:
    """A turn at refreshing: ``go`` with the lock held; ``covered`` if someone already waits
    who will list the files only later than now; ``gave up`` after ``give_up_s``.

    The waiting place is given free only once the lock is held, and before the files are
    listed: whoever finds it taken knows that a listing is still to come.
    """
    lock, queue = _Flock(f"{index}.lock"), _Flock(f"{index}.queue")
    try:
        if not queue.try_lock():
            yield COVERED
            return
        got = _wait(lock, give_up_s, notice)
        queue.release()
        yield GO if got else GAVE_UP
    finally:
        queue.release()
        lock.release()
