"""Runs flows in batches: cursor, read, map, write, save the cursor. Delivery is at least once; keyed writes make replays harmless.

A batch is a range of the cursor: its end is found first, then the rows up to it are read and written in one pass, and the end is saved.
So whatever a retried task reads anew lies in the range, and a source that changes meanwhile can't push rows behind the saved cursor.
"""

from __future__ import annotations

import datetime as dt
import logging
import os
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from threading import Event, Timer
from typing import Literal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riverbend.expr.values import Context
from riverbend.operators import keyset, mapping
from riverbend.operators.changes import OP
from riverbend.plans.config import Flow
from riverbend.sinks import Report
from riverbend.sources import normalised
from riverbend.storage import CursorStore, Store
from riverbend.types import logical_type

#: Waits between attempts in seconds, the last one repeated; fixed values.
BACKOFF = (1, 4, 16, 64, 256, 1024, 3600)


@dataclass
class Metrics:
    """What a flow did: rows, batches, writes, errors by stage, seconds by stage."""

    rows: int = 0
    batches: int = 0
    upserts: int = 0
    deletes: int = 0
    errors: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def timed(self, stage: str, work: Callable):
        began = time.monotonic()
        try:
            return work()
        except Exception:
            self.errors[stage] = self.errors.get(stage, 0) + 1
            raise
        finally:
            self.seconds[stage] = self.seconds.get(stage, 0.0) + time.monotonic() - began


def sink_types(flow: Flow, spark: SparkSession):
    schema = flow.sink.schema(spark, flow.target)
    return None if schema is None else {f.name: (logical_type(f.dataType, f.metadata), f.nullable) for f in schema.fields}


def transform(flow: Flow, rows: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """The flow's mapping as one projection; the clock is one instant for all rows."""
    context = Context(now=now or dt.datetime.now(dt.timezone.utc), env=dict(os.environ))
    keep = (OP,) if OP in rows.columns else ()
    return mapping.apply(rows, list(flow.rules), sink_types(flow, rows.sparkSession), context, keep)


class QueryTimeout(TimeoutError):
    """A flow's query ran longer than its query-timeout."""


@contextmanager
def limited(spark: SparkSession, seconds: float | None, name: str) -> Iterator[None]:
    """Cancels the Spark jobs that are started within, once the time is over."""
    if seconds is None:
        yield
        return
    context, tag, over = spark.sparkContext, f"riverbend-{uuid.uuid4().hex}", Event()

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise QueryTimeout(f"{name}: a query took more than {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    if over.is_set():
        raise QueryTimeout(f"{name}: a query took more than {seconds:g} s")


class Runner:
    """Runs one flow. state: the folder of its cursors, or a store (see riverbend.storage)."""

    #: While draining, a full batch is followed by one of so many times its size, so that passes over a large source grow with its logarithm.
    GROWTH = 8

    def __init__(self, spark: SparkSession, flow: Flow, state: str | Store, client: Callable | None = None, metrics: Metrics | None = None, now: Callable[[], dt.datetime] | None = None):
        self.spark, self.flow, self.client = spark, flow, client
        self.cursors = CursorStore(spark, f"{state.rstrip('/')}/cursors") if isinstance(state, str) else state
        self.metrics = metrics or Metrics()
        self.now = now or (lambda: dt.datetime.now(dt.timezone.utc))

    def batch(self, source: DataFrame | None = None, dry_run: bool = False, limit: int | None | Literal["flow"] = "flow") -> tuple[int, Report | None]:
        """One batch: (rows read, what was written)."""
        flow, m = self.flow, self.metrics
        state = m.timed("cursor", lambda: self.cursors.load(flow.name))
        rows = source if source is not None else flow.source.read(self.spark, flow.table)
        part = keyset.scan(rows, flow.cursor, state, flow.ascending, flow.batch_limit if limit == "flow" else limit)
        if dry_run:
            with limited(self.spark, flow.query_timeout, flow.name):
                m.timed("write", lambda: flow.sink.dry_run(transform(flow, part, self.now())))
            return 0, None
        with limited(self.spark, flow.query_timeout, flow.name):
            following = m.timed("read", lambda: keyset.last(part, flow.cursor, flow.ascending))
        if following is None:
            return 0, None
        part = keyset.scan(rows, flow.cursor, state, flow.ascending).where(keyset.until(flow.cursor, following, flow.ascending, rows.columns))
        seen = Observation()
        out = m.timed("transform", lambda: transform(flow, part.observe(seen, F.count(F.lit(1)).alias("n")), self.now()))
        flow.sink.check([c for c in out.columns if c != OP], flow.conflict)
        with limited(self.spark, flow.query_timeout, flow.name):
            report = m.timed("write", lambda: flow.sink.write(out, flow.target, flow.conflict, schema=flow.sink.schema(self.spark, flow.target), client=self.client))
        m.timed("save", lambda: self.cursors.save(flow.name, following))
        n = int(seen.get["n"])
        m.rows, m.batches, m.upserts, m.deletes = m.rows + n, m.batches + 1, m.upserts + report.upserts, m.deletes + report.deletes
        return n, report

    def once(self, dry_run: bool = False) -> Metrics:
        """Batches until the source has no full one left, each larger than the last."""
        limit = self.flow.batch_limit
        while True:
            n, _ = self.batch(dry_run=dry_run, limit=limit)
            if dry_run or n == 0 or limit is None or n < limit:
                return self.metrics
            limit *= self.GROWTH

    def forever(self, stop: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> Metrics:
        """Batches on the interval's grid, missed ticks skipped; after errors it waits longer and longer."""
        failures = 0
        if self.flow.jitter:  # flows of one interval start apart, each always by the same time
            sleep(zlib.crc32(self.flow.name.encode()) / 2**32 * self.flow.jitter)
        while not stop():
            try:
                n, _ = self.batch()
                failures = 0
                full = self.flow.batch_limit is not None and n >= self.flow.batch_limit
                wait = 0.0 if full else self.flow.interval - clock() % self.flow.interval
            except Exception as e:
                wait = BACKOFF[min(failures, len(BACKOFF) - 1)]
                failures += 1
                logging.getLogger("riverbend").error("%s: %s; next attempt in %s s", self.flow.name, str(e).splitlines()[0] if str(e) else type(e).__name__, wait)
            if wait:
                sleep(wait)
        return self.metrics


def bulk(flow: Flow, rows: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """The whole table through the flow's mapping in one distributed pass."""
    return transform(flow, normalised(rows), now)
