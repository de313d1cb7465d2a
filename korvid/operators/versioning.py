"""Versions of rows: snapshots, visibility, retention; and stages of transactions.

A table's changes are rows with a version.  A snapshot is the last row of
each key up to a version.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Isolation levels and stage machines.
LEVELS = ("read_uncommitted", "read_committed", "repeatable_read", "serializable")
STAGES = {
    "ready": {"reading", "writing"}, "reading": {"ready", "rolling_back"}, "writing": {"committing", "rolling_back"},
    "committing": {"ready", "rolling_back"}, "rolling_back": {"ready"},
}
ASYNC_STAGES = {"none": {"waiting"}, "waiting": {"completing", "none"}, "completing": {"completed"}, "completed": {"none"}}
MAX_VERSIONS = 1000


def visible(version: Column, written_at: Column, level: str, snapshot: int, read_time: Column) -> Column:
    """Whether a snapshot sees a version at an isolation level; a null version is never seen."""
    if level not in LEVELS:
        raise ValueError(f"no isolation level {level!r}")
    if level == "read_uncommitted":
        rule = F.lit(True)
    elif level == "read_committed":
        rule = written_at <= read_time
    else:
        rule = version <= snapshot
    return version.isNotNull() & F.coalesce(rule, F.lit(False))


def as_of(df: DataFrame, key: str, version: str, at: int, columns: list[str], deleted: str | None = None) -> DataFrame:
    """The last row of each key up to a version; keys whose last row is a deletion are gone.

    An aggregation, so each task sends one row a key.
    """
    names = [version, *columns, *([deleted] if deleted else [])]
    last = df.where(F.col(version) <= at).groupBy(key).agg(F.max_by(F.struct(*names), F.col(version)).alias("_x"))
    if deleted:
        last = last.where(~F.coalesce(F.col(f"_x.{deleted}"), F.lit(False)))
    return last.select(key, *[F.col(f"_x.{c}") for c in [version, *columns]])


def retained(df: DataFrame, key: str, version: str, oldest: int) -> DataFrame:
    """Rows that a snapshot at ``oldest`` or later can still see: newer ones, and the last of each key before it."""
    base = df.where(F.col(version) <= oldest).groupBy(key).agg(F.max(version).alias("_base"))
    return df.join(base, key, "left").where((F.col(version) > oldest) | (F.col(version) == F.col("_base"))).drop("_base")


def collected(df: DataFrame, version: str, written_at: str, oldest: int, before: object, limit: int = MAX_VERSIONS) -> DataFrame:
    """Different (version, time) that stay when versions are collected.

    A version goes if it is older than the oldest snapshot and was written
    before a time; of what is left, at most ``limit`` stay, the newest.
    """
    seen = df.groupBy(version).agg(F.max(written_at).alias(written_at))
    stay = seen.where(~F.coalesce((F.col(version) < oldest) & (F.col(written_at) < before), F.lit(False)))
    return stay.orderBy(F.desc(version)).limit(limit)


def newest_versions(df: DataFrame, version: str, limit: int = MAX_VERSIONS) -> DataFrame:
    """Different versions, at most ``limit``, the newest."""
    return df.select(version).distinct().orderBy(F.desc(version)).limit(limit)


def bad_transitions(log: DataFrame, txn: str, seq: str, stage: str, rules: dict[str, set[str]] = STAGES) -> DataFrame:
    """Steps of a log of stages that the machine doesn't allow."""
    from pyspark.sql import Window

    before = F.lag(stage).over(Window.partitionBy(txn).orderBy(seq))
    step = log.withColumn("previous", before)
    allowed = reduce(lambda a, b: a | b, [(F.col("previous") == a) & F.col(stage).isin(*sorted(b)) for a, b in rules.items()])
    return step.where(F.col("previous").isNotNull() & ~F.coalesce(allowed, F.lit(False)))


def check_transition(old: str, new: str, rules: dict[str, set[str]] = STAGES) -> None:
    if new not in rules.get(old, set()):
        raise ValueError(f"{old} can't become {new}")


@dataclass
class Snapshot:
    """A version to read at; tables may have one of their own."""

    version: int
    refs: int = 1
    valid: bool = True
    tables: dict[str, int] = field(default_factory=dict)

    def version_of(self, table: str) -> int:
        return self.tables.get(table, self.version)


class Versions:
    """Version numbers and the snapshots that hold them."""

    def __init__(self, level: str = "repeatable_read") -> None:
        self.current, self.level, self.gc_runs, self.collected = 0, level, 0, 0
        self._open: list[Snapshot] = []
        self._made: dict[int, float] = {}

    def create(self) -> int:
        self.current += 1
        self._made[self.current] = time.monotonic()
        return self.current

    def collect(self, age_seconds: float = 0.0, limit: int = MAX_VERSIONS) -> int:
        """Forget versions older than the oldest snapshot and than an age, and beyond ``limit`` the oldest; how many went."""
        oldest, now = self.oldest() or self.current, time.monotonic()
        gone = [v for v, t in self._made.items() if v < oldest and now - t >= age_seconds]
        gone += sorted(v for v in self._made if v not in gone)[: max(0, len(self._made) - len(gone) - limit)]
        for v in gone:
            del self._made[v]
        self.gc_runs, self.collected = self.gc_runs + 1, self.collected + len(gone)
        return len(gone)

    def statistics(self) -> dict:
        """Versions, snapshots and collections so far."""
        return {
            "current_version": self.current, "versions": len(self._made), "snapshots": len(self._open), "oldest_snapshot": self.oldest(),
            "isolation_level": self.level, "gc_runs": self.gc_runs, "versions_collected": self.collected,
        }

    def snapshot(self, version: int | None = None) -> Snapshot:
        if version is not None and not 0 <= version <= self.current:
            raise ValueError(f"no version {version}")
        s = Snapshot(self.current if version is None else version)
        self._open.append(s)
        return s

    def retain(self, s: Snapshot) -> int:
        s.refs += 1
        return s.refs

    def release(self, s: Snapshot) -> int:
        s.refs = max(0, s.refs - 1)
        if not s.refs and s in self._open:
            self._open.remove(s)
        return s.refs

    def invalidate(self, s: Snapshot) -> None:
        s.valid = False

    def oldest(self) -> int:
        """The oldest version that a snapshot holds, 0 if none does."""
        return min((s.version for s in self._open), default=0)


class TransactionTimeout(RuntimeError):
    """A transaction that ran out of time and was rolled back."""


class Transaction:
    """Changes of one table that take effect together, as a new version, or not at all.

    With ``seconds`` it is rolled back on its own when they are over; whatever
    is asked of it then fails.
    """

    def __init__(self, versions: Versions, table: DataFrame, seconds: float | None = None):
        self.versions, self.before = versions, table
        self.table = table
        self.snapshot = versions.snapshot()
        self.stage = "ready"
        self.version: int | None = None
        self.seconds, self.began, self.timed_out, self.done = seconds, time.monotonic(), False, False
        self._lock = threading.RLock()
        self._timer: threading.Timer | None = None
        if seconds is not None:
            self._timer = threading.Timer(seconds, self._expire)
            self._timer.daemon = True
            self._timer.start()

    def elapsed(self) -> float:
        return time.monotonic() - self.began

    def remaining(self) -> float | None:
        """Seconds that are left, 0 at least; None without a limit."""
        return None if self.seconds is None else max(0.0, self.seconds - self.elapsed())

    def _expire(self) -> None:
        with self._lock:
            if not self.done:
                self.timed_out = True
                self.rollback()

    def _check(self) -> None:
        if self.seconds is not None and not self.done and self.elapsed() >= self.seconds:
            self._expire()
        if self.timed_out:
            raise TransactionTimeout(f"more than {self.seconds} s")

    def _finish(self) -> None:
        if not self.done:
            self.done = True
            self.versions.release(self.snapshot)
        if self._timer is not None:
            self._timer.cancel()

    def _go(self, stage: str) -> None:
        check_transition(self.stage, stage)
        self.stage = stage

    def apply(self, change: Callable[[DataFrame], DataFrame]) -> None:
        with self._lock:
            self._check()
            if self.stage == "ready":
                self._go("writing")
            self.table = self.table.transform(change)

    def commit(self) -> DataFrame:
        with self._lock:
            self._check()
            if self.stage == "writing":
                self._go("committing")
                self.version = self.versions.create()
                self._go("ready")
            self._finish()
            return self.table

    def rollback(self) -> DataFrame:
        with self._lock:
            if self.stage != "ready":
                self._go("rolling_back")
                self._go("ready")
            self.table = self.before
            self._finish()
            return self.table

    def sees(self, version: int) -> bool:
        return version <= self.snapshot.version


@contextmanager
def transaction(versions: Versions, table: DataFrame, seconds: float | None = None):
    """Commit at the end, roll back and pass the error on if there is one; with ``seconds``, roll back when they are over."""
    t = Transaction(versions, table, seconds)
    try:
        yield t
    except BaseException:
        t.rollback()
        raise
    t.commit()
