"""How fresh an answer is: commits behind, a result kept for some seconds, one writer at a time."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def staleness(commits: DataFrame, indexed: str | None, changed_files: int | None) -> DataFrame:
    """One row (behind, stale, blocker) for an index of a commit, among commits (commit, place), the newest of the highest place.

    stale is null where it can't be known: an indexed commit that isn't among them. Without an index there is
    nothing to read: a blocker.
    """
    own = commits.filter(F.col("commit") == F.lit(indexed)).agg(F.max("place").alias("at"))  # one row
    told = commits.crossJoin(F.broadcast(own)).agg(F.count_if(F.col("place") > F.col("at")).alias("newer"), F.max("at").alias("at"))
    behind = F.when(F.col("at").isNotNull(), F.col("newer"))
    stale = F.when(behind.isNotNull(), (behind > 0) | F.lit((changed_files or 0) > 0))
    return told.select(behind.alias("behind"), (F.lit(True) if changed_files else stale).alias("stale"), F.lit("no index" if indexed is None else None).alias("blocker"))


class Kept:
    """Results by key for `seconds`: asked again within that time, the same frame is returned, cached by its executors."""

    def __init__(self, seconds: float = 5.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self._held = seconds, clock, {}

    def get(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        for old in [k for k, (until, _) in self._held.items() if until <= now]:
            self._held.pop(old)[1].unpersist()
        if key not in self._held:
            self._held[key] = now + self.seconds, make().cache()
        return self._held[key][1]


class WriteLock:
    """One writer at a time, across processes: a file in the table's folder that only one can create.

    A lock that its holder hasn't renewed for `expires` seconds is taken over: who renames the old file first. A holder whose lock
    was taken over leaves the new one alone.
    """

    def __init__(self, spark: SparkSession, folder: str, wait: float = 60.0, expires: float = 600.0):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(f"{folder}/.lock")
        self._system = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._wait, self._expires, self._mine = wait, expires, uuid.uuid4().hex

    def __enter__(self) -> WriteLock:
        until = time.monotonic() + self._wait
        while True:
            try:
                out = self._system.create(self._path, False)
                out.write(bytearray(self._mine.encode()))
                out.close()
                return self
            except Exception as error:  # py4j wraps the file system's
                if not self._system.exists(self._path):
                    if time.monotonic() > until:
                        raise error
                    continue
                age = time.time() - self._system.getFileStatus(self._path).getModificationTime() / 1000
                if age > self._expires:
                    self._take_over()
                elif time.monotonic() > until:
                    raise TimeoutError("another writer holds the table") from error
                else:
                    time.sleep(0.1)

    def _holder(self, path=None) -> str | None:
        try:
            stream = self._system.open(path or self._path)
        except Exception:  # gone meanwhile
            return None
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _take_over(self) -> None:
        seen, old = self._holder(), self._path.suffix(f".{uuid.uuid4().hex}")
        if seen is None or not self._system.rename(self._path, old):
            return
        if self._holder(old) != seen:  # somebody took over before and holds it now
            self._system.rename(old, self._path)
        else:
            self._system.delete(old, False)

    def renew(self) -> bool:
        """Hold the lock for another `expires` seconds; False if it was taken over."""
        mine = self._holder() == self._mine
        if mine:
            self._system.setTimes(self._path, int(time.time() * 1000), -1)
        return mine

    def __exit__(self, *_) -> None:
        if self._holder() == self._mine:
            self._system.delete(self._path, False)
