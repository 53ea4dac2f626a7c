"""Notifications between holders of one store handle, delivered at commit.

A hub lives in the driver: delivery is a side effect and has no place in a
distributed plan.  ``queue_rows`` gives the same queue discipline over a table.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalode import errors as E
from stratalode import validate

CAPACITY = 1024


@dataclass(frozen=True)
class Notification:
    sequence: int
    channel: str
    payload: str
    dropped_before: int = 0


class Subscription:
    """The queue of one listener; the oldest item is dropped when it is full."""

    def __init__(self, hub: Hub, channel: str):
        self.hub, self.channel, self.queue, self.closed = hub, channel, deque(), False

    def deliver(self, item: Notification) -> None:
        self.queue.append(item)
        if len(self.queue) > CAPACITY:
            gone = self.queue.popleft()
            self.queue[0] = replace(self.queue[0], dropped_before=self.queue[0].dropped_before + gone.dropped_before + 1)

    def try_receive(self) -> Notification | None:
        if self.closed:
            raise E.ClosedHandle("the subscription is closed")
        return self.queue.popleft() if self.queue else None

    def close(self) -> None:
        self.closed = True
        self.queue.clear()
        if self in self.hub.subscriptions:
            self.hub.subscriptions.remove(self)


class Hub:
    """Channels, and the scopes of open transactions and savepoints."""

    def __init__(self) -> None:
        self.subscriptions: list[Subscription] = []
        self.sequence = 0
        self.scopes: list[tuple[str | None, list[Notification]]] = []

    def listen(self, channel: str) -> Subscription:
        sub = Subscription(self, validate.channel(channel))
        self.subscriptions.append(sub)
        return sub

    def notify(self, channel: str, payload: str = "") -> int:
        """Queue for the commit of the innermost scope, or deliver now; the sequence number is used either way."""
        validate.channel(channel)
        validate.payload(payload)
        self.sequence += 1
        item = Notification(self.sequence, channel, payload)
        if self.scopes:
            self.scopes[-1][1].append(item)
        else:
            self._deliver([item])
        return self.sequence

    def _deliver(self, items: list[Notification]) -> None:
        for item in items:
            for sub in self.subscriptions:
                if sub.channel == item.channel:
                    sub.deliver(item)

    def begin(self, name: str | None = None) -> None:
        self.scopes.append((name, []))

    def _find(self, name: str) -> int:
        for i in reversed(range(len(self.scopes))):
            if self.scopes[i][0] == name:
                return i
        raise E.InvalidArgument(f"no savepoint {name!r}")

    def release(self, name: str) -> None:
        """Scopes from the named one on join their parent; the bottom one delivers."""
        at = self._find(name)
        items = [x for _, scope in self.scopes[at:] for x in scope]
        del self.scopes[at:]
        if self.scopes:
            self.scopes[-1][1].extend(items)
        else:
            self._deliver(items)

    def rollback_to(self, name: str) -> None:
        at = self._find(name)
        del self.scopes[at + 1 :]
        self.scopes[at][1].clear()

    def commit(self) -> None:
        items = [x for _, scope in self.scopes for x in scope]
        self.scopes.clear()
        self._deliver(items)

    def rollback(self) -> None:
        self.scopes.clear()


def queue_rows(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What stands in each channel's queue after all (channel, sequence, payload) were sent and none was received."""
    newest = Window.partitionBy("channel").orderBy(F.desc("sequence"))
    kept = items.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= capacity)
    sizes = items.groupBy("channel").agg(F.count("*").alias("n"))
    dropped = F.when((F.col("place") == capacity) & (F.col("n") > capacity), F.col("n") - capacity).otherwise(F.lit(0))
    return kept.join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, "channel").select("channel", "sequence", "payload", dropped.cast("long").alias("dropped_before"))
