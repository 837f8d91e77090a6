"""A document store's change stream as a Spark source: its resume token is the stream's offset, which Spark's checkpoint keeps.

Rows: sequence (the event's number since the stream began), operation, key (the document's key as JSON), document (its image after
the change as JSON, null for deletes). The events come from a client: ``client`` names it as module:function of the options, else a
pymongo client is made from ``url`` and ``database``. A client has read(collection, token, limit, full): events after the token (from now
on without one), each with operationType, documentKey, fullDocument and token, at most limit of them and without waiting for more.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from riverbend.storage import named

FORMAT = "riverbend-changes"
#: Events of one micro-batch where the options don't say; fixed value.
EVENTS = 1024


class WatchClient:
    """Change streams through the pymongo module, where it is installed."""

    def __init__(self, options: dict[str, str]):
        self.database = importlib.import_module("pymongo").MongoClient(options["url"])[options["database"]]

    def read(self, collection: str, token: Any, limit: int, full: str) -> list[dict]:
        out: list[dict] = []
        with self.database[collection].watch(resume_after=token, full_document=full if full != "none" else None) as stream:
            while len(out) < limit and (event := stream.try_next()) is not None:
                out.append({**event, "token": stream.resume_token})
        return out


class ChangeStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "sequence bigint, operation string, key string, document string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))


class _Reader(SimpleDataSourceStreamReader):
    """Offsets are {token, n}. What a failed batch read is read again between its offsets, which the store's log still has."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.limit = int(options.get("limit", EVENTS))

    def _events(self, start: dict, limit: int) -> list[dict]:
        client = named(self.options["client"])(self.options) if "client" in self.options else WatchClient(self.options)
        return client.read(self.options["collection"], start["token"], limit, self.options.get("full", "updateLookup"))

    def initialOffset(self) -> dict:
        return {"token": json.loads(self.options["token"]) if "token" in self.options else None, "n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        events = self._events(start, self.limit)
        end = {"token": events[-1]["token"], "n": start["n"] + len(events)} if events else start
        return iter(self._rows(events, start["n"])), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        many = end["n"] - start["n"]
        events = self._events(start, many) if many else []
        if len(events) < many:
            raise RuntimeError(f"the change stream of {self.options['collection']} no longer has the events of a batch to be read again")
        return iter(self._rows(events, start["n"]))

    @staticmethod
    def _rows(events: list[dict], n: int) -> list[tuple]:
        text = lambda v: None if v is None else json.dumps(v, default=str)
        return [(n + i, e["operationType"], text(e.get("documentKey")), text(e.get("fullDocument"))) for i, e in enumerate(events, 1)]


def stream(spark: SparkSession, options: dict[str, str], fields: dict[str, str]) -> DataFrame:
    """The events as a stream: sequence, operation, document (VARIANT) and the fields by their paths, from the document or, for deletes, from its key."""
    spark.dataSource.register(ChangeStream)
    raw = spark.readStream.format(FORMAT).options(**options).load()
    whole = raw.select("sequence", "operation", F.parse_json("document").alias("document"), F.parse_json("key").alias("__key"))
    path = lambda name: "$" + "".join(f"['{p}']" for p in name.split("."))
    made = [F.coalesce(F.try_variant_get("document", path(n), t), F.try_variant_get("__key", path(n), t)).alias(n) for n, t in fields.items()]
    return whole.select("sequence", "operation", "document", *made)
