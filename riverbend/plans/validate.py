"""Checks of a flow before it runs: access, fields, conversions, cursor, sink, and a sampled trial."""

from __future__ import annotations

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from riverbend.expr.compiler import compile_expression
from riverbend.expr.values import Context
from riverbend.operators import keyset, mapping
from riverbend.operators.changes import OP
from riverbend.plans import flow as flows
from riverbend.plans.config import Flow

SAMPLE = 100


def validate(spark: SparkSession, flow: Flow) -> list[str]:
    """What is wrong with the flow; empty when it may run. Switches of the flow's validation block leave checks out."""
    on = {"access": True, "fields": True, "inserts": True} | dict(flow.validation)
    found: list[str] = []

    def check(work) -> object:
        try:
            return work()
        except Exception as e:
            found.append(f"{flow.name}: {str(e).splitlines()[0]}")
            return None

    if not on["access"]:
        return found
    rows = check(lambda: flow.source.read(spark, flow.table))
    if rows is None or not on["fields"]:
        return found
    sink = check(lambda: flows.sink_types(flow, spark))
    if not flow.source.is_stream:
        check(lambda: keyset.check(rows, flow.cursor))
    elif flow.conflict is None:
        found.append(f"{flow.name}: a change stream needs a conflict key")
    given = check(lambda: mapping.expand(list(flow.rules), mapping.source_types(rows), sink))
    if given is None:
        return found
    names = [r.to for r in given]
    found += [f"{flow.name}: sink column {n} is made twice" for n in sorted({n for n in names if names.count(n) > 1})]
    types = mapping.source_types(rows)
    for r in given:
        if r.compute is not None:
            check(lambda r=r: compile_expression(r.compute, Context(types)))
    if flow.conflict is not None:
        found += [f"{flow.name}: conflict key {k} is not a sink column" for k in flow.conflict.key if k not in names]
    if sink is not None:
        missing = [n for n, (_t, nullable) in sink.items() if not nullable and n not in names]
        found += [f"{flow.name}: sink column {n} is not nullable and not mapped" for n in missing]
    if on["inserts"]:
        check(lambda: flow.sink.check(names, flow.conflict))
    if not found:
        check(lambda: flows.transform(flow, rows.limit(0)).schema)
    sampling = on.get("sampling", False)
    size = sampling.get("size", SAMPLE) if isinstance(sampling, dict) else SAMPLE
    if not found and (sampling.get("enabled", True) if isinstance(sampling, dict) else sampling):
        check(lambda: tick(spark, flow, size))
    return found


def tick(spark: SparkSession, flow: Flow, size: int = SAMPLE) -> int:
    """A batch of at most size rows as the flow would run it from the start, all of it but the write and the saved cursor: how many rows came through."""
    rows = flow.source.read(spark, flow.table)
    if flow.source.is_stream:
        by_sink = {r.to: r.source for r in flow.rules if r.source is not None}
        part = flow.source.changes(rows.limit(size), [by_sink.get(k, k) for k in flow.conflict.key], flow.source.present(spark, flow.table))
    else:
        part = keyset.scan(rows, flow.cursor, None, flow.ascending, size)
        if keyset.last(part, flow.cursor, flow.ascending) is None:
            return 0
    with flows.limited(spark, flow.query_timeout, flow.name):
        out = flows.transform(flow, part)
        flow.sink.check([c for c in out.columns if c != OP], flow.conflict)
        seen = Observation()
        flow.sink.dry_run(out.observe(seen, F.count(F.lit(1)).alias("n")), size)
    return int(seen.get["n"])
