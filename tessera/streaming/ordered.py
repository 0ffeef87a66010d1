"""Online packing of a stream whose rows arrive out of order, with stored state and timers.

Next fit depends on the order of its items, and a stream's files and tasks do not keep it. Here an item waits in the state
until the watermark has passed its event time: from then on no earlier one can come. A timer at the earliest waiting time
then takes all items that are due, by event time and number, and fills the open bin; a bin that the next item does not fit
into is done and leaves the state as one row. When nothing waits, a second timer closes the open bin after ``idle``
without items, so that the last bin of a shard comes out too.

The state of a shard is the items within the watermark's delay, one open bin of at most the budget (or one item), and
three numbers, whatever the length of the stream. It is kept by the session's state store, which must be able to hold
lists and timers: see ``state_store``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ITEM = "at long, item long, tokens long"
BINS = "bin_id long, n_items long, tokens long, items array<long>"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started in this block keep their state in RocksDB; the session's own setting comes back after it."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


class OrderedNextFit(StatefulProcessor):
    """Key: the shard. Input: item, tokens and event time ``at``; a row without item only moves the watermark."""

    def __init__(self, shard: str, budget: int, idle_ms: int):
        self.shard, self.budget, self.idle = shard, budget, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ITEM)
        self.open = handle.getListState("open", ITEM)
        self.numbers = handle.getValueState("numbers", "bin_id long, fill long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            f = f[f["item"].notna()]
            if len(f):
                items = [(int(a.value // 1_000_000), int(i), int(t)) for a, i, t in zip(f["at"], f["item"], f["tokens"])]
                self.waiting.appendList(items)
                first = min([a for a, _, _ in items] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get())
        due = [x for x in waiting if x[0] <= mark]
        later = waiting[len(due) :]
        bin_id, fill, last = self.numbers.get() if self.numbers.exists() else (0, 0, 0)
        held, done = list(self.open.get()), []
        for at, item, tokens in due:
            if held and fill + tokens > self.budget:
                done.append((bin_id, held))
                bin_id, fill, held = bin_id + 1, 0, []
            held.append((at, item, tokens))
            fill, last = fill + tokens, at
        if held and not later and mark >= last + self.idle:
            done.append((bin_id, held))
            bin_id, fill, held = bin_id + 1, 0, []
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        self.open.put(held) if held else self.open.clear()
        self.numbers.update((bin_id, fill, last))
        if later:
            self.handle.registerTimer(later[0][0])
        elif held:
            self.handle.registerTimer(last + self.idle)
        if done:
            yield pd.DataFrame({self.shard: [key[0]] * len(done), "bin_id": [b for b, _ in done], "n_items": [len(x) for _, x in done], "tokens": [sum(t for _, _, t in x) for _, x in done], "items": [[i for _, i, _ in x] for _, x in done]})

    def close(self) -> None:
        pass


def pack_in_order(stream: DataFrame, shard: str, item: str, tokens: str, time: str, budget: int, late: str = "10 minutes", idle_ms: int = 60_000) -> DataFrame:
    """shard, bin_id, n_items, tokens, items: the closed bins of next fit by (``time``, ``item``), whatever the arrival.

    Items later than ``late`` behind the latest event time are dropped, as the watermark says. Ids of items are integers;
    rows without one are heartbeats that let time pass.
    """
    rows = stream.select(F.col(shard).alias(shard), F.col(item).cast("long").alias("item"), F.col(tokens).cast("long").alias("tokens"), F.col(time).alias("at")).withWatermark("at", late)
    kind = dict(rows.dtypes)[shard]
    return rows.groupBy(shard).transformWithStateInPandas(OrderedNextFit(shard, budget, idle_ms), f"`{shard}` {kind}, {BINS}", "append", "eventtime")
