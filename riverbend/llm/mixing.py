"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 64-bit hash of its id and text. Sizes are summed by
source and hash bucket; a running sum over a source's buckets finds the bucket
in which its budget ends, and only that bucket is refined by the hash's next
bits, until one hash is left. Documents are then chosen by comparing their
hash with their source's threshold: nothing is sorted, and no source is
gathered anywhere (sums are combined before each shuffle, so a source with most
of all rows costs what its number of buckets costs).

A source's target may be up to ``cap`` times its size: whole copies first, the
rest by threshold. Thresholds are nested: a larger budget takes a superset.
The document on which the budget ends is taken in part, in words.

Defined cases. Null text has size 0; documents of size 0 take 0. A null source
is a source of its own, ordered last; it takes part like any other. Rows with
one hash (repeated rows) share what is left at their threshold in proportion
to their size, rounded down. Empty table: empty result. Other columns are kept
by ``mix`` as they are, whatever their names; work columns live in a struct of
their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbend.llm import shared

#: Bits of the hash that one histogram level resolves, and the levels that cover all 64.
LEVEL_BITS = (12, 12, 12, 12, 16)
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the hash as a number whose signed order is the hash's unsigned order."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(F.col("doc_id").cast("bigint"), text).alias("h"),
    )


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes by repeating weights, capped, excess reshared by weight.

    Resharing until none is above its cap is water-filling: sources ordered by cap over weight are full while the level
    reaches them. The window holds one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("weight"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("*", (F.lit(float(cap)) * F.col("source_size")).alias("most"), (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("all"))
    ahead = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(0, Window.unboundedFollowing)
    per = per.select("*", ((F.col("all") - F.coalesce(F.sum("most").over(ahead), F.lit(0.0))) / F.sum("weight").over(rest)).alias("level"))
    # Past the true level a source is taken off at more than its share, so levels only fall: the largest fitting one is true.
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    return per.select("source", "source_size", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"))


def _unsigned_bits(h: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << bits) - 1))


def thresholds(sized: DataFrame, target: DataFrame, level_bits: tuple[int, ...] = LEVEL_BITS) -> DataFrame:
    """source, source_size, target, copies, edge (hash at which the rest of the budget ends), left, edge_size."""
    words = F.round("target").cast("bigint")
    copies = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = shared.materialise(target.select("source", "source_size", "target", copies.alias("copies"), (words - copies * F.col("source_size")).alias("left")), "targets")
    at = plan.select("source", "left")
    members, low = sized.where(F.col("size") > 0), 64
    found = None
    for bits in level_bits:
        low -= bits
        hist = members.groupBy("source", _unsigned_bits(F.col("h"), low, bits).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("h_min"), F.max("h").alias("h_max"))
        before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
        hist = hist.withColumn("before", before).alias("x").join(at.alias("a"), F.col("x.source").eqNullSafe(F.col("a.source")))
        edge = hist.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
        edge = shared.materialise(edge.select("x.source", "bucket", (F.col("left") - F.col("before")).alias("left"), "words", "h_min", "h_max"), "edges")
        done = edge.where("h_min = h_max").select("source", F.col("h_min").alias("edge"), "left", F.col("words").alias("edge_size"))
        found = done if found is None else found.unionByName(done)
        at = edge.where("h_min < h_max")
        if not at.head(1):
            break
        members = members.alias("m").join(at.alias("a"), F.col("m.source").eqNullSafe(F.col("a.source")) & (_unsigned_bits(F.col("m.h"), low, bits) == F.col("a.bucket"))).select("m.*")
        at = at.select("source", "left")
    joined = plan.drop("left").alias("p").join(found.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left")
    return joined.select("p.*", "f.edge", F.coalesce("f.left", F.lit(0)).alias("left"), F.coalesce("f.edge_size", F.lit(1)).alias("edge_size"))


def _below(h: Column, edge: Column) -> Column:
    """h < edge as unsigned numbers."""
    flip = F.lit(-(1 << 63))
    return h.bitwiseXOR(flip) < edge.bitwiseXOR(flip)


def allocation(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, level_bits: tuple[int, ...] = LEVEL_BITS) -> DataFrame:
    """Per document row: doc_id, source, size, source_size, target, copies taken whole, extra words, taken words, and its hash."""
    sized = shared.materialise(sizes(docs), "sizes")
    plan = shared.materialise(thresholds(sized, targets(sized, weights, share, cap), level_bits), "thresholds")
    x = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")), "left")
    copies = F.col("copies") + F.coalesce(_below(F.col("h"), F.col("edge")), F.lit(False)).cast("bigint")
    at_edge = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    extra = F.when(at_edge, F.floor(F.col("left").cast("decimal(38,0)") * F.col("size") / F.col("edge_size"))).otherwise(F.lit(0)).cast("bigint")
    x = x.select("d.doc_id", "d.source", "size", "source_size", "target", copies.alias("copies"), extra.alias("extra"), "h")
    return x.withColumn("taken", F.when(F.col("size") > 0, F.col("copies") * F.col("size") + F.col("extra")).otherwise(F.lit(0)).cast("bigint"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, level_bits: tuple[int, ...] = LEVEL_BITS) -> DataFrame:
    """The mixed documents themselves, whole: each row as often as the mix takes it (an edge document once more if over half of it is taken).

    Rows keep their columns. Documents without words (size 0) add nothing to any budget and stay once. The plan per source is
    joined to the rows as they stream by; the rows are shuffled only if there are too many sources to broadcast.
    """
    sized = shared.materialise(sizes(docs), "sizes")
    plan = shared.materialise(thresholds(sized, targets(sized, weights, share, cap), level_bits), "thresholds")
    plan = plan.select(F.col("source").alias("__source"), F.struct("copies", "edge", "left", "edge_size").alias("__plan"))
    x = docs.select(F.struct("*").alias("__row"))
    x = x.join(plan, F.col("__row.source").cast("string").eqNullSafe(F.col("__source")), "left")
    text = F.col("__row.text").cast("string")
    h = F.xxhash64(F.col("__row.doc_id").cast("bigint"), text)
    below = F.coalesce(_below(h, F.col("__plan.edge")), F.lit(False)).cast("int")
    half = (F.coalesce(h == F.col("__plan.edge"), F.lit(False)) & (F.col("__plan.left") * 2 > F.col("__plan.edge_size"))).cast("int")
    times = F.when(F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), F.col("__plan.copies").cast("int") + below + half).otherwise(F.lit(1))
    return x.select("__row", F.explode(F.array_repeat(F.lit(0), times)).alias("__copy")).select("__row.*")
