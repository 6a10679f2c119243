"""Numbered generations: directories, markers, order of steps, retention.

All paths go through the Hadoop file system, so any store that Spark can write
to will do.
"""

from __future__ import annotations

import gzip
import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..config import GenerationSettings

DONE = "_SUCCESS"


class Store:
    """File operations on whatever store a path belongs to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self.at(name)).getLength() if self.exists(name) else 0

    def make(self, name: str) -> None:
        self._fs.mkdirs(self.at(name))

    def touch(self, name: str) -> None:
        self._fs.create(self.at(name), True).close()

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def names(self, name: str = "") -> list[str]:
        """Sorted names in a directory, without the done marker."""
        if not self.exists(name):
            return []
        return sorted(n for s in self._fs.listStatus(self.at(name)) if (n := s.getPath().getName()) != DONE)

    def write_text(self, name: str, text: str) -> None:
        out = self._fs.create(self.at(name), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()

    def write_bytes(self, name: str, content: bytes) -> None:
        """Under another name first, which readers leave out, so nobody sees a part of it."""
        folder, _, own = name.rpartition("/")
        hidden = f"{folder}/_{own}.inprogress" if folder else f"_{own}.inprogress"
        out = self._fs.create(self.at(hidden), True)
        out.write(bytearray(content))
        out.close()
        self._fs.rename(self.at(hidden), self.at(name))

    def age_minutes(self, name: str) -> float:
        return time.time() / 60 - self._fs.getFileStatus(self.at(name)).getModificationTime() / 60_000

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()


class Generations:
    """An instance's generations, each ``00000``, ``00001``, …"""

    def __init__(self, spark: SparkSession, root: str):
        self.store, self.spark = Store(spark, root), spark

    @staticmethod
    def name(generation: int) -> str:
        return f"{generation:05d}"

    def every(self) -> list[int]:
        return [int(n) for n in self.store.names() if n.isdigit() and len(n) == 5]

    def done(self, generation: int) -> bool:
        return self.store.exists(f"{self.name(generation)}/{DONE}")

    def newest_done(self) -> int | None:
        return max((g for g in self.every() if self.done(g)), default=None)

    def path(self, generation: int, table: str) -> str:
        return f"{self.store.root}/{self.name(generation)}/{table}"

    def open_next(self) -> int:
        """The generation that takes new input; it is made if need be."""
        every = self.every()
        pending = [g for g in every if not self.done(g)]
        g = pending[-1] if pending else (every[-1] + 1 if every else 0)
        self.store.make(f"{self.name(g)}/inbound")
        return g

    def settled(self, generation: int, patience_minutes: float = 20) -> bool:
        """Whether no file is being written to a generation's input; what is left over goes."""
        at = f"{self.name(generation)}/inbound"
        pending = [n for n in self.store.names(at) if n.endswith((".inprogress", "._COPYING_"))]
        for n in list(pending):
            if self.store.age_minutes(f"{at}/{n}") > patience_minutes:
                self.store.delete(f"{at}/{n}")
                pending.remove(n)
        return not pending

    def should_run(self, generation: int, data_threshold_mb: int = -1, minutes_since_last: float = 0, time_threshold_minutes: int = -1, forced: bool = False) -> bool:
        """First and forced runs go ahead; else by age or by new data."""
        if forced or self.newest_done() is None:
            return True
        if 0 <= time_threshold_minutes <= minutes_since_last:
            return True
        return 0 <= data_threshold_mb <= self.store.size(f"{self.name(generation)}/inbound") / 1e6

    def due(self, generation: int, settings: GenerationSettings, minutes_since_last: float = 0, forced: bool = False) -> bool:
        """Whether the settings ask for a run, and nothing is being written to its input."""
        return self.settled(generation) and self.should_run(generation, settings.data_threshold_mb, minutes_since_last, settings.time_threshold_minutes, forced)

    def table(self, generation: int, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step's table: read where it is complete, else made (again)."""
        at = self.path(generation, name)
        if not self.store.exists(f"{self.name(generation)}/{name}/{DONE}"):
            self.store.delete(f"{self.name(generation)}/{name}")
            make().write.parquet(at)
        return self.spark.read.parquet(at)

    def finish(self, generation: int, stats: dict, keep: int = 10) -> None:
        name = self.name(generation)
        self.store.write_text(f"{name}/manifest.json", json.dumps(stats, sort_keys=True))
        self.store.delete(f"{name}/tmp")
        self.store.touch(f"{name}/{DONE}")
        done = [g for g in self.every() if self.done(g)]
        for g in done[: max(0, len(done) - keep)]:
            self.store.delete(self.name(g))


class Runner:
    """Builds generations when they are due, forced or not, until it is interrupted."""

    def __init__(self, generations: Generations, build: Callable[[int], dict], settings: GenerationSettings = GenerationSettings(), now: Callable[[], float] = time.monotonic):
        self.generations, self.build, self.settings, self.now = generations, build, settings, now
        self.last, self.forced, self.stopped = now(), False, False

    def force_run(self) -> None:
        self.forced = True

    def interrupt(self) -> None:
        self.stopped = True

    def tick(self) -> int | None:
        """Build the open generation if that is due; its number."""
        g = self.generations
        open_ = g.open_next()
        if self.stopped or not g.due(open_, self.settings, (self.now() - self.last) / 60, self.forced):
            return None
        self.forced = False
        g.finish(open_, self.build(open_), self.settings.keep)
        self.last = self.now()
        return open_


class AppendLog:
    """Lines that become gzip files of the open generation's input, so many at a time."""

    def __init__(self, generations: Generations, writes: int = 10_000):
        self.generations, self.writes, self.held = generations, writes, []

    def append(self, *lines: str) -> None:
        self.held += lines
        if len(self.held) >= self.writes:
            self.roll()

    def roll(self) -> str | None:
        """Write what is held; the file's name."""
        if not self.held:
            return None
        name = f"{self.generations.name(self.generations.open_next())}/inbound/{uuid.uuid4().hex}.csv.gz"
        self.generations.store.write_bytes(name, gzip.compress("".join(f"{x}\n" for x in self.held).encode(), mtime=0))
        self.held = []
        return name


class Reloading:
    """A value that is made again after some time; a failure keeps the old one and waits longer."""

    def __init__(self, make: Callable, seconds: float = 300, now: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.now = make, seconds, now
        self.value, self.due, self.failed = None, float("-inf"), 0

    def get(self):
        if self.now() >= self.due:
            try:
                self.value, self.failed = self.make(), 0
            except Exception:
                if self.value is None:
                    raise
                self.failed += 1
            self.due = self.now() + self.seconds * 2 ** min(self.failed, 6)
        return self.value


def schedule(dependencies: Iterable[tuple[str, str | None]]) -> list[list[str]]:
    """Levels of steps from (step, needs) pairs; a cycle is an error."""
    needs: dict[str, set[str]] = {}
    for step, before in dependencies:
        needs.setdefault(step, set())
        if before is not None:
            needs[step].add(before)
            needs.setdefault(before, set())
    levels: list[list[str]] = []
    while needs:
        ready = sorted(s for s, b in needs.items() if not b)
        if not ready:
            raise ValueError(f"steps depend on each other: {sorted(needs)}")
        levels.append(ready)
        needs = {s: b - set(ready) for s, b in needs.items() if s not in ready}
    return levels
