"""Flows as Structured Streaming queries: offsets, recovery and triggers are Spark's, each micro-batch is one idempotent write."""

from __future__ import annotations

import datetime as dt
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from riverbend.plans.config import Flow
from riverbend.plans.flow import BACKOFF, limited, sink_types, transform


def write_batch(flow: Flow, rows: DataFrame, batch_id: int, present: DataFrame | None = None, client: Callable | None = None) -> None:
    """One micro-batch: change events are reduced to each key's last; the clock is one instant; the batch id names the write, so a
    replayed batch replaces itself."""
    if flow.source.is_stream:
        if flow.conflict is None:
            raise ValueError(f"{flow.name}: a change stream needs a conflict key")
        by_sink = {r.to: r.source for r in flow.rules if r.source is not None}
        rows = flow.source.changes(rows, [by_sink.get(k, k) for k in flow.conflict.key], present)
    out = transform(flow, rows, dt.datetime.now(dt.timezone.utc))
    with limited(rows.sparkSession, flow.query_timeout, flow.name):
        flow.sink.write(out, flow.target, flow.conflict, batch_id, flow.sink.schema(rows.sparkSession, flow.target), client)


def start(spark: SparkSession, flow: Flow, state: str, once: bool = False, per_trigger: int | None = None, present: Callable[[], DataFrame] | None = None, client: Callable | None = None) -> StreamingQuery:
    """Starts the flow on its interval, or (once) until its input is drained. A lookup on update takes the present table that the source configures, if none is given."""
    rows = flow.source.stream(spark, flow.table, per_trigger=per_trigger)
    sink_types(flow, spark)

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(flow, batch, batch_id, present() if present else flow.source.present(spark, flow.table), client)

    writer = rows.writeStream.queryName(flow.name).option("checkpointLocation", f"{state.rstrip('/')}/streams/{flow.name}").foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(1, round(flow.interval * 1000))} milliseconds")).start()


def drain(spark: SparkSession, flow: Flow, state: str, **how) -> None:
    """Runs the flow until its input at this moment is written."""
    if not flow.source.live:
        start(spark, flow, state, True, **how).awaitTermination()
        return
    query = start(spark, flow, state, **how)  # a change stream has no end to stop at by itself
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def forever(begin: Callable[[], StreamingQuery], name: str, stop: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
    """Runs a stream and starts it anew after errors, from its checkpoint, waiting longer and longer; a run of an hour without error ends the count."""
    failures = 0
    while not stop():
        began = clock()
        try:
            begin().awaitTermination()
            return
        except Exception as e:
            failures = 0 if clock() - began > BACKOFF[-1] else failures
            wait = BACKOFF[min(failures, len(BACKOFF) - 1)]
            failures += 1
            logging.getLogger("riverbend").error("%s: %s; next attempt in %s s", name, str(e).splitlines()[0] if str(e) else type(e).__name__, wait)
            sleep(wait)
