"""User functions over rows."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame

from probelake.session import durable


def ordered_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: Sequence[str],
                partitions: int | None = None) -> DataFrame:
    """A user function over Arrow batches, results in input order.

    ``fn`` maps a batch to a batch that still carries the ``order`` columns; the width of the work is the
    partition count, and the order is restored by one range sort at the end.
    """
    spread = df.repartition(partitions) if partitions else df

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return spread.mapInPandas(run, schema).orderBy(*order)


class _RowsByPartition(AccumulatorParam):
    """Finished rows of each partition; a task that runs again counts once."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):
        for k, n in b.items():
            a[k] = max(n, a.get(k, 0))
        return a


def ordered_map_with_progress(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, on_done: Callable[[int], None],
                              poll_seconds: float = 0.2) -> DataFrame:
    """A user function over Arrow batches; results stand in the order of ``df``, and progress is reported while it runs.

    Rows never leave their partition and partitions keep their order, so nothing is sorted or moved: read the result with
    ``toLocalIterator`` to get it in input order. The result is written to the shared folder. ``on_done`` is called on the
    driver with the number of finished input rows, which only rises: after each look that finds more tasks done, and at
    the end with all rows. An error of ``on_done`` or ``fn`` is raised here.
    """
    finished = df.sparkSession.sparkContext.accumulator({}, _RowsByPartition())

    def run(batches):
        n = 0
        for pdf in batches:
            n += len(pdf)
            yield fn(pdf)
        finished.add({TaskContext.get().partitionId(): n})

    over, failed, reported = threading.Event(), [], [0]

    def report() -> None:
        n = sum(finished.value.copy().values())
        if n > reported[0] and not failed:
            reported[0] = n
            on_done(n)

    def watch() -> None:
        while not over.wait(poll_seconds):
            try:
                report()
            except Exception as e:  # raised below, on the caller's thread
                failed.append(e)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        out = durable(df.mapInPandas(run, schema))
    finally:
        over.set()
        watcher.join()
    report()
    if failed:
        raise failed[0]
    return out
