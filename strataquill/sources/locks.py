"""Locks with leases for drivers that share nothing but a file system.

A lock is a folder of numbered files, one for each time it was taken; the highest number holds it. To take it, the next file
is created, which only one driver can do. The holder touches its file from time to time; one that hasn't been touched for a
lease is that of a driver that is gone, and the lock may be taken over by the next number. Nobody deletes or renews what
another driver made, so a late holder can't free or extend a lock that has passed on; :meth:`Lease.check` tells it.

The number is a fencing token: it grows with every holder, so what is written under it can be told from what an earlier one wrote.
"""

from __future__ import annotations

import contextlib
import threading
import time
from types import TracebackType

from pyspark.sql import SparkSession


class Held(RuntimeError):
    """Another driver has the lock."""


class Lost(RuntimeError):
    """The lock has passed on to another driver."""


class Lease:
    def __init__(self, spark: SparkSession, folder: str, seconds: float = 300, beat: bool = True):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder, self.seconds, self.beat = self._path(folder), seconds, beat
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.token: int | None = None
        self._stop = threading.Event()

    def _at(self, name: str):
        return self._path(self.folder, name)

    def _files(self) -> tuple[dict[int, float], set[int]]:
        """When each number was last touched, and the numbers that were given back."""
        if not self.fs.exists(self.folder):
            return {}, set()
        found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self.folder)]
        return {int(n): t for n, t in found if n.isdigit()}, {int(n.split(".")[0]) for n, _ in found if n.endswith(".free")}

    def acquire(self) -> int:
        taken, freed = self._files()
        last = max(taken, default=0)
        if last and last not in freed and time.time() - taken[last] < self.seconds:
            raise Held(f"{self.folder.getName()} is held under {last}")
        self.fs.mkdirs(self.folder)
        try:
            made = self.fs.createNewFile(self._at(f"{last + 1:012d}"))
        except Exception as error:  # some file systems raise where a file is there
            raise Held(f"{self.folder.getName()} was taken") from error
        if not made:
            raise Held(f"{self.folder.getName()} was taken")
        self.token = last + 1
        # Of numbers below one's own, nothing depends on any more.
        for number in taken:
            if number < last:
                with contextlib.suppress(Exception):
                    self.fs.delete(self._at(f"{number:012d}"), False)
                    self.fs.delete(self._at(f"{number:012d}.free"), False)
        if self.beat:
            threading.Thread(target=self._beating, daemon=True).start()
        return self.token

    def renew(self) -> None:
        """Begins the lease anew."""
        self.check()
        self.fs.setTimes(self._at(f"{self.token:012d}"), int(time.time() * 1000), -1)

    def check(self) -> None:
        """Raises :class:`Lost` if the lock isn't held any more."""
        if self.token is None or max(self._files()[0], default=0) != self.token:
            raise Lost(f"{self.folder.getName()} isn't held under {self.token}")

    def release(self) -> None:
        """Gives the lock back; nothing happens if it has passed on."""
        self._stop.set()
        if self.token is not None:
            with contextlib.suppress(Lost):
                self.check()
                self.fs.createNewFile(self._at(f"{self.token:012d}.free"))
        self.token = None

    def _beating(self) -> None:
        while not self._stop.wait(self.seconds / 3):
            try:
                self.renew()
            except Lost:
                return
            except Exception:  # a file system that is away for a moment; the lease has two more tries
                continue

    def __enter__(self) -> Lease:
        self.acquire()
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.release()
