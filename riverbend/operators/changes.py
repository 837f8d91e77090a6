"""Change events: operations become upserts and deletes, and of one key's events the last counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hidden column that says what a row does.
OP, UPSERT, DELETE = "_op", "U", "D"
# Operations of a change stream; fixed values.
UPSERTS, DELETES, DESTRUCTIVE = ("insert", "replace", "update"), ("delete",), ("drop", "rename", "dropDatabase", "invalidate")


def tag(df: DataFrame, operation: str) -> DataFrame:
    """Adds the operation tag; a destructive event (drop, rename, invalidate) is an error, other kinds are left out."""
    op = F.col(operation)
    code = F.when(op.isin(*UPSERTS), F.lit(UPSERT)).when(op.isin(*DELETES), F.lit(DELETE)).when(op.isin(*DESTRUCTIVE), F.raise_error(F.concat(F.lit("destructive change event: "), op)).cast("string"))
    return df.withColumn(OP, code).where(F.col(OP).isNotNull())


def latest(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """The last event of each key. An aggregate, so a key with many events is combined before the shuffle."""
    by = F.col(order) if isinstance(order, str) else order
    named = [F.col(f"`{c}`") for c in df.columns]
    whole = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct(*named), by).alias("__last"))
    return whole.select("__last.*")


def with_post_images(events: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lookup on update: upserts take the table's present row; an upsert whose row is gone is left out (its delete follows)."""
    rest = [c for c in table.columns if c not in keys]
    alive = events.where(F.col(OP) == UPSERT).select(*keys, OP).join(table, list(keys))
    gone = events.where(F.col(OP) == DELETE).select(*keys, *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in rest], OP)
    return alive.select(*keys, *rest, OP).unionByName(gone)
