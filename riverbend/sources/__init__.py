"""Sources: Parquet folders, JDBC databases, document tables and change streams, as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbend.operators import changes


class SourceError(ValueError):
    """A source that is not configured or read as it must be."""


#: JDBC drivers and URL schemes by kind; fixed values.
JDBC = {
    "postgres": ("org.postgresql.Driver", "postgresql"), "cockroachdb": ("org.postgresql.Driver", "postgresql"), "questdb": ("org.postgresql.Driver", "postgresql"),
    "mysql": ("com.mysql.cj.jdbc.Driver", "mysql"), "mariadb": ("org.mariadb.jdbc.Driver", "mariadb"), "clickhouse": ("com.clickhouse.jdbc.ClickHouseDriver", "clickhouse"),
}


@dataclass(frozen=True)
class Source:
    """name, kind and configuration of a source; ``read`` gives a table's rows, unfiltered: cursors and projections are pushed by Spark."""

    name: str
    kind: str
    config: Mapping[str, Any] = field(default_factory=dict)
    options: Mapping[str, Any] = field(default_factory=dict)

    @property
    def is_stream(self) -> bool:
        return self.kind in ("cdc", "mongo-cdc")

    @property
    def live(self) -> bool:
        """Whether the changes come from a document store itself, and not from files of events."""
        return self.kind == "mongo-cdc" and "path" not in self.config

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        if self.live:  # no events, but their columns
            fields = dict(self.config.get("schema") or {"_id": "string"})
            return spark.createDataFrame([], ", ".join(["sequence bigint", "operation string", "document variant", *[f"`{n}` {t}" for n, t in fields.items()]]))
        if self.kind in ("parquet", "cdc", "mongo-cdc"):
            return normalised(spark.read.parquet(parquet_path(self.config, table)))
        if self.kind == "mongodb":
            return documents(spark, self.config, table)
        if self.kind in JDBC:
            from riverbend.sources import embedded

            if embedded.driver_only(spark, str(self.config.get("url", ""))):
                raise SourceError(f"{self.name}: executors can't open an embedded database; embedded.publish gives them a copy")
            return normalised(spark.read.format("jdbc").options(**jdbc_options(self.kind, self.config, table)).load())
        raise SourceError(f"{self.name}: unknown kind {self.kind!r}")

    def stream(self, spark: SparkSession, table: str, schema: T.StructType | None = None, per_trigger: int | None = None) -> DataFrame:
        """The table as a stream of new files; offsets are kept by the stream's checkpoint."""
        if self.kind not in ("parquet", "cdc", "mongo-cdc"):
            raise SourceError(f"{self.name}: a {self.kind} source is read in batches by cursor")
        if self.live:
            from riverbend.sources import changestream

            full = "none" if self.options.get("mode", "post-image") == "lookup-on-update" else self.config.get("full", "updateLookup")
            given = {k: str(self.config[k]) for k in ("client", "url", "database", "token", "limit") if k in self.config}
            return changestream.stream(spark, given | {"collection": table, "full": full}, dict(self.config.get("schema") or {"_id": "string"}))
        path = parquet_path(self.config, table)
        reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
        return normalised((reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path))

    def sample(self, spark: SparkSession, table: str, n: int) -> DataFrame:
        return self.read(spark, table).limit(n)

    def present(self, spark: SparkSession, table: str) -> DataFrame | None:
        """The table as it is now, for lookups on update: ``present`` is its configured folder of Parquet tables, or of JSON lines."""
        if not self.is_stream or self.options.get("mode", "post-image") != "lookup-on-update" or "present" not in self.config:
            return None
        given = self.config["present"]
        if isinstance(given, Mapping):
            return Source(self.name, given.get("type", "parquet"), given).read(spark, given.get("table", table))
        return normalised(spark.read.parquet(parquet_path({"path": given}, table)))

    def changes(self, df: DataFrame, keys: Sequence[str], table: DataFrame | None = None) -> DataFrame:
        """Events of a change stream tagged as upserts and deletes, the last of each key. The order column and the operation column are
        configured (``order``, ``operation``); mode ``lookup-on-update`` takes rows from the present table instead of the event."""
        tagged = changes.tag(df, self.config.get("operation", "operation"))
        last = changes.latest(tagged, list(keys), self.config.get("order", "sequence"))
        if self.options.get("mode", "post-image") == "lookup-on-update":
            if table is None:
                raise SourceError(f"{self.name}: lookup-on-update needs the present table")
            return changes.with_post_images(last, table, list(keys))
        return last


def parquet_path(config: Mapping[str, Any], table: str) -> str:
    if "path" not in config:
        raise SourceError("a parquet source needs a path")
    return f"{config['path'].rstrip('/')}/{table}" if table.endswith(".parquet") or config.get("bare") else f"{config['path'].rstrip('/')}/{table}.parquet"


def jdbc_options(kind: str, config: Mapping[str, Any], table: str) -> dict[str, str]:
    """Reader and writer options; with ``partition-column`` and bounds the read is split over executors."""
    driver, scheme = JDBC[kind]
    url = config.get("url", "")
    if not url:
        raise SourceError(f"a {kind} component needs a url")
    if not url.startswith("jdbc:"):
        head, _, rest = url.partition("://")
        user, at, place = rest.rpartition("@")
        url = f"jdbc:{scheme}://{place if at else rest}"
        name, _, password = user.partition(":")
        credentials = {"user": name, "password": password} if at else {}
    else:
        credentials = {}
    split = {"partition-column": "partitionColumn", "lower-bound": "lowerBound", "upper-bound": "upperBound", "partitions": "numPartitions", "fetch-size": "fetchsize", "batch-size": "batchsize"}
    return {"url": url, "driver": config.get("driver", driver), "dbtable": table, **credentials, **{new: str(config[old]) for old, new in split.items() if old in config}}


def documents(spark: SparkSession, config: Mapping[str, Any], table: str) -> DataFrame:
    """A document collection: JSON lines, each kept whole as VARIANT in ``document``, with the fields of ``schema`` beside it; a name with
    dots there is the path of a nested field, and a cursor may order by it.

    Without a schema it comes from all documents, in a pass of its own: every field has a column, of a type that holds all its values.
    Fields of several types, and numbers that only a double holds together, stay VARIANT. A value that does not convert is an error there.
    """
    lines = spark.read.text(f"{config['path'].rstrip('/')}/{table}.jsonl").where(F.trim("value") != "")
    whole = lines.select(F.parse_json("value").alias("document"))
    schema = config.get("schema")
    get = F.try_variant_get if schema else F.variant_get
    return whole.select(*[get("document", json_path(n) if schema else f"$['{n}']", t).alias(n) for n, t in (schema or found_schema(whole)).items()], "document")


def json_path(name: str) -> str:
    """The path of a field of nested documents: a.b is the field b of the document a."""
    return "$" + "".join(f"['{p}']" for p in name.split("."))


def found_schema(whole: DataFrame) -> dict[str, str]:
    found = whole.select(F.schema_of_variant_agg("document").alias("s")).first()["s"]
    fields = T.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<", 1)) if found and found.startswith("OBJECT<") and "VARIANT" not in found and found.count("OBJECT<") == 1 and "ARRAY" not in found else None
    if fields is not None:
        return {f.name: f.dataType.simpleString() if f.dataType.simpleString() not in ("void", "double") else "variant" for f in fields.fields}
    keys = whole.select(F.explode(F.json_object_keys(F.to_json("document"))).alias("k")).distinct().orderBy("k").collect()
    return {r["k"]: "variant" for r in keys}


def normalised(df: DataFrame) -> DataFrame:
    """Timestamps without a zone are read as UTC instants (the session's zone must be UTC)."""
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({n: F.col(f"`{n}`").cast("timestamp") for n in naive}) if naive else df
