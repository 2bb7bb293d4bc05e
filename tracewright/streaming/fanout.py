"""Changes handed on to listeners, each with a bounded queue: a slow one misses events and holds nobody up."""

from __future__ import annotations

import queue
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events that wait for one listener at most.
WAITING = 200


class FanOut:
    def __init__(self, waiting: int = WAITING):
        self.waiting, self.listeners, self.lock = waiting, [], threading.Lock()

    def listen(self) -> queue.Queue:
        own: queue.Queue = queue.Queue(self.waiting)
        with self.lock:
            self.listeners.append(own)
        return own

    def leave(self, own: queue.Queue) -> None:
        with self.lock:
            self.listeners = [x for x in self.listeners if x is not own]

    def publish(self, event: str) -> int:
        """Gives an event to every listener that has room; how many got it."""
        with self.lock:
            listeners = list(self.listeners)
        got = 0
        for own in listeners:
            try:
                own.put_nowait(event)
                got += 1
            except queue.Full:
                pass
        return got


def feed(stream: DataFrame, hub: FanOut, checkpoint: str, *order: str):
    """Starts a query that publishes a stream's rows as JSON, batch after batch and within one by ``order``.

    A batch comes to the driver partition by partition, and no further than a queue is long: listeners keep no more.
    """

    def hand_on(batch: DataFrame, _: int) -> None:
        rows = batch.select(F.to_json(F.struct("*")).alias("event"), *order).orderBy(*order).limit(hub.waiting) if order else batch.select(F.to_json(F.struct("*")).alias("event")).limit(hub.waiting)
        for row in rows.toLocalIterator():
            hub.publish(row.event)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(hand_on).trigger(availableNow=True).start()
