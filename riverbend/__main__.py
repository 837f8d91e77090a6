"""python -m riverbend run|validate CONFIG [--once] [--dry-run] [--flow NAME] [--state FOLDER] [--metrics FILE] [--metrics-port PORT]"""

from __future__ import annotations

import argparse
import sys
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from pathlib import Path

from pyspark.sql import SparkSession

from riverbend.plans import config, validate
from riverbend.plans.flow import Metrics, Runner
from riverbend.storage import open_store


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("riverbend", description=__doc__)
    parser.add_argument("command", choices=("run", "validate"))
    parser.add_argument("config")
    parser.add_argument("--once", action="store_true", help="drain and stop")
    parser.add_argument("--dry-run", action="store_true", help="plan and try a few rows, write nothing")
    parser.add_argument("--flow", action="append", help="only this flow (repeatable)")
    parser.add_argument("--state", help="folder of cursors and checkpoints, in place of the storage's path")
    parser.add_argument("--metrics", help="file that counters are written to at the end")
    parser.add_argument("--metrics-port", type=int, help="port on this host that serves counters at /metrics")
    given = parser.parse_args(args)
    found = config.load(given.config)
    unknown = [n for n in given.flow or () if n not in found.flows]
    if unknown:
        parser.error(f"no flow {', '.join(unknown)}")
    flows = [f for n, f in found.flows.items() if not given.flow or n in given.flow]
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    wrong = [x for f in flows for x in validate.validate(spark, f)]
    for x in wrong:
        print(x, file=sys.stderr)
    if wrong or given.command == "validate":
        return int(bool(wrong))
    from riverbend import monitoring, streaming

    metrics: dict[str, Metrics] = {f.name: Metrics() for f in flows}
    progress = monitoring.Progress(metrics)
    spark.streams.addListener(progress)
    server = monitoring.serve(lambda: metrics, given.metrics_port) if given.metrics_port is not None else None

    def work(f: config.Flow) -> None:
        if f.source.is_stream:
            state = given.state or found.storages[f.storage]
            if given.dry_run:
                validate.tick(spark, f)
            elif given.once:
                streaming.drain(spark, f, state)
            else:
                streaming.forever(partial(streaming.start, spark, f, state), f.name)
            return
        kind, options = found.stores[f.storage]
        runner = Runner(spark, f, open_store(spark, kind, options, given.state), metrics=metrics[f.name])
        if given.once or given.dry_run:
            runner.once(given.dry_run)
        else:
            runner.forever()

    failed = 0
    try:
        with ThreadPoolExecutor(max(1, len(flows))) as pool:
            for f, result in [(f, pool.submit(work, f)) for f in flows]:
                if error := result.exception():
                    failed += 1
                    print(f"{f.name}: {(str(error) or type(error).__name__).splitlines()[0]}", file=sys.stderr)
    finally:
        spark.streams.removeListener(progress)
        if server:
            server.shutdown()
        if given.metrics:
            Path(given.metrics).write_text(monitoring.exposition(metrics))
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
