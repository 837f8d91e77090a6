"""What flows did, as text that monitoring systems read (Prometheus exposition format), in a file or over HTTP."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

from pyspark.sql.streaming import StreamingQueryListener

from riverbend.plans.flow import Metrics


class Progress(StreamingQueryListener):
    """Metrics of streaming flows by query name, kept up by Spark's progress events."""

    def __init__(self, metrics: dict[str, Metrics] | None = None):
        self.metrics = {} if metrics is None else metrics
        self.failures: list[str] = []
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows:
            return
        m = self.metrics.setdefault(p.name or str(p.id), Metrics())
        m.rows += p.numInputRows
        m.batches += 1
        for stage, millis in (p.durationMs or {}).items():
            m.seconds[stage] = m.seconds.get(stage, 0.0) + millis / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures.append(event.exception)
            m = self.metrics.setdefault(self._names.get(str(event.id), str(event.id)), Metrics())
            m.errors["stream"] = m.errors.get("stream", 0) + 1


def exposition(metrics: Mapping[str, Metrics]) -> str:
    """Counters of every flow: rows, batches, upserts, deletes, and errors and seconds by stage."""
    escape = lambda s: s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    lines = []
    for name in ("rows", "batches", "upserts", "deletes"):
        lines.append(f"# TYPE riverbend_flow_{name}_total counter")
        lines += [f'riverbend_flow_{name}_total{{flow="{escape(f)}"}} {getattr(m, name)}' for f, m in sorted(metrics.items())]
    for name in ("errors", "seconds"):
        lines.append(f"# TYPE riverbend_flow_{name}_total counter")
        lines += [f'riverbend_flow_{name}_total{{flow="{escape(f)}",stage="{escape(s)}"}} {v}' for f, m in sorted(metrics.items()) for s, v in sorted(getattr(m, name).items())]
    return "\n".join(lines) + "\n"


def serve(metrics: Callable[[], Mapping[str, Metrics]], port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Serves the exposition at /metrics from a thread of its own; shutdown() ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            body = exposition(metrics()).encode() if self.path == "/metrics" else b""
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    return server
