"""Gauges of running streams, and sources that are used up."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Gauges(StreamingQueryListener):
    """Takes the observed metrics of each micro-batch as it ends: a dict a batch, the newest `keep` of them, with gauge (the
    name), batch, rows (read) and state_rows (held in state: what a queue's depth would be)."""

    def __init__(self, keep: int = 10_000):
        self.keep, self.seen, self.ended = keep, [], set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in (p.observedMetrics or {}).items():
            self.seen.append({"gauge": name, "batch": p.batchId, "rows": p.numInputRows, "state_rows": sum(s.numRowsTotal for s in p.stateOperators or []), **row.asDict()})
        del self.seen[: -self.keep]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def wait(self, run_id: str, seconds: float = 30) -> None:
        """Until what was told of a run has come, for the bus is asynchronous."""
        until = time.monotonic() + seconds
        while str(run_id) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)


def gauged(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """stream with aggregates that are computed as its rows pass by, without a job of their own."""
    return stream.observe(name, *(c.alias(k) for k, c in metrics.items()))


def consumed(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as a stream that deletes a file once the micro-batch that read it is committed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("cleanSource", "delete").parquet(path)


def drain(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, gauges: Gauges | None = None, seconds: int = 600) -> None:
    """Runs a stream over what there is. A run that fails may be called again: it goes on with the batch that failed."""
    spark = stream.sparkSession
    if gauges:
        spark.streams.addListener(gauges)
    query = None
    try:
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if not query.awaitTermination(seconds):
            query.stop()
            raise TimeoutError(f"the stream didn't end in {seconds} s")
    finally:
        if gauges:
            if query is not None:
                gauges.wait(query.runId)
            spark.streams.removeListener(gauges)


def totals(spark: SparkSession, gauges: Gauges, name: str) -> DataFrame:
    """batches, rows and the sum of each metric (metric, total) of a gauge."""
    mine = [g for g in gauges.seen if g["gauge"] == name]
    metrics = sorted({k for g in mine for k in g} - {"gauge", "batch", "rows", "state_rows"})
    rows = [(m, sum(g[m] or 0 for g in mine)) for m in [*metrics, "rows"]]
    return spark.createDataFrame([(m, float(t)) for m, t in rows], "metric string, total double").select("metric", F.round("total", 2).alias("total"))
