"""Incremental forms: online packing, dedup, resumable inference, metric windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import batch as batch_ops
from tessera.operators.packing import next_fit_ids


def online_pack(stream: DataFrame, shard: str, order: str, tokens: str, budget: int) -> DataFrame:
    """shard, order, tokens, bin_id: next fit per shard across micro-batches.

    The state is the open bin's number and fill. Rows of a micro-batch are put in the order of their sequence number, and
    batches are taken as they come (``ordered.pack_in_order`` waits for late rows instead); a bin is closed by the item that
    does not fit, so the last one needs no flush: every row has its bin at once.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bin_id, fill, used = (*state.get, True) if state.exists else (0, 0, False)
        f = pd.concat(list(frames)).sort_values(order, kind="stable")
        items = f[tokens].to_numpy(np.int64)
        before = [fill] if used else []  # the open bin is an item before the others
        ids = bin_id + next_fit_ids(np.concatenate((before, items)).astype(np.int64), budget)[len(before) :]
        last = ids == ids[-1]
        state.update((int(ids[-1]), int(items[last].sum()) + (fill if used and ids[-1] == bin_id else 0)))
        yield pd.DataFrame({shard: key[0], order: f[order].to_numpy(), tokens: f[tokens].to_numpy(), "bin_id": ids})

    kinds = dict(stream.dtypes)
    schema = f"{shard} {kinds[shard]}, {order} {kinds[order]}, {tokens} {kinds[tokens]}, bin_id long"
    return stream.groupBy(shard).applyInPandasWithState(run, schema, "bin_id long, fill long", "append", GroupStateTimeout.NoTimeout)


def dedup_stream(stream: DataFrame, content: str, event_time: str | None = None, horizon: str = "1 day") -> DataFrame:
    """First arrival of each content; with an event time the state is bounded by the horizon."""
    keyed = stream.withColumn("sha1", F.sha1(F.col(content).cast("binary")))
    if event_time is None:
        return keyed.dropDuplicates(["sha1"])
    return keyed.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["sha1"])


def incremental_inference(stream: DataFrame, task: batch_ops.Task, backend: batch_ops.Backend, results: str, failures: str, checkpoint: str):
    """Starts a query that answers new records and appends results and failures; keys that have a result are skipped."""
    spark = stream.sparkSession

    def step(df: DataFrame, _: int) -> None:
        try:
            done = spark.read.parquet(results)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        answered = batch_ops.infer(batch_ops.pending(df, done, task), task, backend).persist()
        ok, bad = batch_ops.split_results(answered, task)
        ok.write.mode("append").parquet(results)
        bad.write.mode("append").parquet(failures)
        answered.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metric_windows(stream: DataFrame, time: str, value: str, width: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """window_start, n, mean over tumbling or sliding windows (an extension over the batch log reader)."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), "n", "mean")
