"""State between runs: cursors, chunk checkpoints, positions and leases, as small JSON files in one folder.

Files go through Spark's own file systems, so the folder may be in any store that Spark reaches.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any
from urllib.parse import quote

from pyspark.sql import SparkSession


class LeaseLost(RuntimeError):
    """A write under a lease that another holder has taken over."""


class StateStore:
    """Named JSON documents, each a row of numbered files of which the newest counts.

    A write renames a finished file to the next number, which fails if that number is there. So a reader always finds a whole document, a
    crash leaves the one before, and of two writers that saw the same document one is told.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._folder = folder.rstrip("/")

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}")

    def _numbers(self, name: str) -> list[int]:
        top = self._path("")
        fs = top.getFileSystem(self._conf)
        if not fs.exists(top):
            return []
        pattern = re.compile(re.escape(quote(name, safe="")) + r"\.([0-9]{20})\.json")
        return sorted(int(m[1]) for s in fs.listStatus(top) if (m := pattern.fullmatch(s.getPath().getName())))

    def _file(self, name: str, number: int) -> Any:
        return self._path(f"{quote(name, safe='')}.{number:020d}.json")

    def numbered(self, name: str) -> tuple[int, dict | None]:
        """The newest document and its number; (-1, None) without one."""
        for _ in range(20):  # a file that is listed may be replaced before it is read
            numbers = self._numbers(name)
            if not numbers:
                return -1, None
            path = self._file(name, numbers[-1])
            try:
                stream = path.getFileSystem(self._conf).open(path)
            except Exception:
                continue
            try:
                return numbers[-1], json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        raise OSError(f"{name} can't be read")

    def read(self, name: str) -> dict | None:
        return self.numbered(name)[1]

    def swap(self, name: str, number: int, value: dict) -> bool:
        """Store a document after the one of that number; False, and nothing is stored, if another one came first."""
        draft, path = self._path(f"_{uuid.uuid4().hex}"), self._file(name, number + 1)
        fs = draft.getFileSystem(self._conf)
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(value, default=str).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        try:
            context.rename(draft, path, self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            fs.delete(draft, False)
            if fs.exists(path):
                return False
            raise
        for old in self._numbers(name):
            if old < number:  # the one before stays, for readers that have just listed it
                fs.delete(self._file(name, old), False)
        return True

    def write(self, name: str, value: dict) -> None:
        while not self.swap(name, self.numbered(name)[0], value):
            pass

    def delete(self, name: str) -> None:
        """Oldest first, so that a crash can't bring an old document back."""
        for number in self._numbers(name):
            path = self._file(name, number)
            path.getFileSystem(self._conf).delete(path, False)

    def advance(self, name: str, field: str, value: Any) -> bool:
        """Store a position only if it lies ahead of the stored one; a rewind is refused."""
        while True:
            number, now = self.numbered(name)
            now = now or {}
            if now.get(field) is not None and value <= now[field]:
                return False
            if self.swap(name, number, now | {field: value}):
                return True

    @contextmanager
    def lease(self, name: str, seconds: float = 60.0, clock: Callable[[], float] = time.time, renewed: bool = True) -> Iterator[Lease]:
        """One holder at a time: yields a lease that is true if it was free, or had expired. It is renewed every third of its time until it ends."""
        held = Lease(self, f"{name}.lease", seconds, clock)
        held.acquire()
        stop = threading.Event()

        def renew() -> None:
            while not stop.wait(seconds / 3) and held.renew():
                pass

        if held and renewed:
            threading.Thread(target=renew, daemon=True).start()
        try:
            yield held
        finally:
            stop.set()
            held.release()


class Lease:
    """A claim on a name. Its fence rises with every holder, so that what is written under an older one can be told and refused."""

    def __init__(self, store: StateStore, name: str, seconds: float, clock: Callable[[], float]) -> None:
        self.store, self.name, self.seconds, self.clock = store, name, seconds, clock
        self.owner, self.fence, self._number = uuid.uuid4().hex, 0, -1
        self._turn = threading.Lock()

    def __bool__(self) -> bool:
        return self.fence > 0

    def acquire(self) -> bool:
        number, now = self.store.numbered(self.name)
        now = now or {"until": 0, "fence": 0}
        if now["until"] >= self.clock():
            return False
        fence = now["fence"] + 1
        if self.store.swap(self.name, number, {"owner": self.owner, "until": self.clock() + self.seconds, "fence": fence}):
            self.fence, self._number = fence, number + 1
        return bool(self)

    def renew(self) -> bool:
        """Hold on for another term; False, and the lease is lost, if someone else has it."""
        with self._turn:
            if self and self.store.swap(self.name, self._number, {"owner": self.owner, "until": self.clock() + self.seconds, "fence": self.fence}):
                self._number += 1
            else:
                self.fence = 0
            return bool(self)

    def require(self) -> None:
        """Fail unless the lease is still held; called before a write that must not come from two holders."""
        if not self.renew():
            raise LeaseLost(self.name)

    def release(self) -> None:
        with self._turn:
            if self:
                self.store.swap(self.name, self._number, {"owner": None, "until": 0, "fence": self.fence})
                self.fence = 0
