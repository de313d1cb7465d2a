"""Results as streams: rows one by one or in batches, with cancellation and time limits."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import with_row_index

# Default sizes.
BATCH_ROWS = 50


class Interrupted(RuntimeError):
    """A query that was cancelled or took too long."""


@dataclass
class Cancel:
    """A flag that a running query looks at."""

    seconds: float | None = None
    _event: threading.Event = field(default_factory=threading.Event)
    _began: float = field(default_factory=time.monotonic)

    def cancel(self) -> None:
        self._event.set()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set() or (self.seconds is not None and time.monotonic() - self._began >= self.seconds)

    def check(self) -> None:
        if self.cancelled:
            raise Interrupted("cancelled" if self._event.is_set() else f"took more than {self.seconds} s")


class ResultStream:
    """The rows of a table in the order of a key; only a partition or two is held at a time."""

    def __init__(self, df: DataFrame, key: str, where: Column | None = None, cancel: Cancel | None = None):
        self.df = df if where is None else df.where(where)
        self.key, self.cancel, self.position, self.done = key, cancel or Cancel(), 0, False

    def size(self) -> int:
        """Rows that the stream will give, the filter included."""
        return self.df.count()

    def stop(self) -> None:
        self.cancel.cancel()

    def __iter__(self) -> Iterator[Row]:
        for row in self.df.orderBy(F.col(self.key).asc_nulls_first()).toLocalIterator(prefetchPartitions=True):
            self.cancel.check()
            self.position += 1
            yield row
        self.done = True

    def numbered(self, rows: int = BATCH_ROWS) -> DataFrame:
        """What the stream gives, as a table: every row with the number of its batch and its place in it."""
        numbered = with_row_index(self.df, self.key, name="_korvid_row")
        at = F.col("_korvid_row")
        return numbered.withColumns({"batch": F.floor(at / rows).cast("long"), "place": (at % rows).cast("long")}).drop("_korvid_row")

    def batches(self, rows: int = BATCH_ROWS) -> Iterator[list[Row]]:
        """Lists of ``rows`` rows; the last may be shorter."""
        held: list[Row] = []
        for row in self:
            held.append(row)
            if len(held) == rows:
                yield held
                held = []
        if held:
            yield held


def process(df: DataFrame, key: str, visit: Callable[[object, int], None], cancel: Cancel | None = None) -> int:
    """Hand every key and its place to a processor, in order, until it fails or is cancelled; how many there were."""
    cancel, i = cancel or Cancel(), 0
    cancel.check()
    for row in df.select(key).orderBy(F.col(key).asc_nulls_first()).toLocalIterator(prefetchPartitions=True):
        cancel.check()
        visit(row[0], i)
        i += 1
    return i


def run_interruptibly[R](spark: SparkSession, action: Callable[[], R], cancel: Cancel | None = None, poll: float = 0.05) -> R:
    """Run an action under a tag of its own; cancelling, or running out of time, interrupts its jobs only."""
    cancel, tag = cancel or Cancel(), f"korvid-{uuid.uuid4().hex}"
    out: dict = {}

    def work() -> None:
        spark.addTag(tag)
        try:
            out["value"] = action()
        except BaseException as e:
            out["error"] = e
        finally:
            spark.removeTag(tag)

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    while thread.is_alive():
        thread.join(poll)
        if thread.is_alive() and cancel.cancelled:
            spark.interruptTag(tag)
            thread.join(poll)
            cancel.check()
    if "error" in out:
        if cancel.cancelled:
            raise Interrupted("cancelled") from out["error"]
        raise out["error"]
    return out["value"]


class QueryManager:
    """Running queries by name."""

    def __init__(self) -> None:
        self._running: dict[str, Cancel] = {}

    def register(self, name: str, cancel: Cancel | None = None) -> Cancel:
        if name in self._running:
            raise KeyError(f"{name} is running")
        self._running[name] = cancel or Cancel()
        return self._running[name]

    def finish(self, name: str) -> None:
        self._running.pop(name, None)

    def cancel(self, name: str) -> bool:
        if name not in self._running:
            return False
        self._running[name].cancel()
        return True

    def cancel_all(self) -> int:
        for c in self._running.values():
            c.cancel()
        return len(self._running)

    def names(self) -> list[str]:
        return sorted(self._running)

    def clean(self) -> int:
        """Forget queries that were cancelled or ran out of time; how many there were."""
        gone = [n for n, c in self._running.items() if c.cancelled]
        for n in gone:
            del self._running[n]
        return len(gone)
