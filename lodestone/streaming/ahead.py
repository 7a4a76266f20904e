"""Batches in order on the driver, the next ones fetched while one is used."""

from __future__ import annotations

import queue
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row


def batches_ahead(df: DataFrame, rows: int, ahead: int = 1) -> Iterator[list[Row]]:
    """Lists of ``rows`` rows in the order of ``df``, the last maybe shorter; a thread keeps up to ``ahead`` more ready.

    At most ``ahead + 2`` batches and two of Spark's partitions are held.  An error of the source is raised where its batch
    would have come; a consumer that stops early ends the thread.
    """
    ready: queue.Queue = queue.Queue(maxsize=ahead)
    stop = threading.Event()

    def put(item) -> bool:
        while not stop.is_set():
            try:
                ready.put(item, timeout=0.1)
                return True
            except queue.Full:
                continue
        return False

    def read() -> None:
        try:
            batch: list[Row] = []
            for row in df.toLocalIterator(prefetchPartitions=True):
                batch.append(row)
                if len(batch) == rows:
                    if not put((batch, None)):
                        return
                    batch = []
            if batch and not put((batch, None)):
                return
            put((None, None))
        except Exception as e:  # handed on to the consumer
            put((None, e))

    thread = threading.Thread(target=read, daemon=True)
    thread.start()
    try:
        while True:
            batch, error = ready.get()
            if error is not None:
                raise error
            if batch is None:
                return
            yield batch
    finally:
        stop.set()
        thread.join()
