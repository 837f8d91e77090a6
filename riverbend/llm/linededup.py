"""Line dedup with a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line goes down by its number of tokens, then by
its ``LEADING`` first tokens, where a token with a digit counts as a variable
field. A leaf may hold several templates, which are found in ``ROUNDS`` rounds.
In each, every group of lines (a leaf at first) votes: a position's token is
constant if over half of the group's lines (by documents) have it there, other
positions are variable fields, and lines with at least ``LIKENESS`` of their
positions constant belong to the template. If some do, the others are a
group of their own in the next round. If none does, the group holds several templates
or none: it is split at the position where the tokens of many lines (as many as make a template
recurring) hold most lines, by these tokens, and the other lines go on together. Tokens with a digit make no such split.

A template that occurs in at least ``MIN_DOCS`` documents is recurring, one of over
``LONG`` tokens in at least ``LONG_DOCS``; so is a line that occurs in so many as it is. Lines of
recurring templates are dropped from all documents.

Counts are combined before each shuffle. Lines travel as hashes (64 bits and their leaf's 64). Texts are joined by leaf and
by their own hash only, in joins that Spark can split where a key is frequent. Nothing gathers a template's lines or documents.

Defined cases. Null text: stays null, no lines. Lines are cut at line feeds;
lines without a token are never dropped. A line that a document repeats counts
once for it. Repeated rows with one doc_id count as one document. Each row with a null doc_id
counts as a document of its own; its lines are dropped like others. Empty
table: empty result. Other columns are kept unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbend.llm import shared

LEADING = 3
LIKENESS = 0.7
MIN_DOCS = 5
#: Templates of more tokens than this are passages, which recur from this number of documents on.
LONG, LONG_DOCS = 50, 2
ROUNDS = 4
#: Tasks that lines of one group are dealt to.
SALTS = 16
#: Pattern of one token; separators are ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
_SPLIT = r"[\x20\x09-\x0D]+"
_FIELD = "<*>"


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, _SPLIT), lambda t: t != "")


def _token_hash(token: Column) -> Column:
    """A token's hash, odd if it has a digit."""
    return F.xxhash64(token).bitwiseAND(F.lit(-2)).bitwiseOR(token.rlike("[0-9]").cast("bigint"))


def leaf(line: Column, count: Column, leading: int = LEADING) -> Column:
    """The tree's path to a line's leaf, as a hash: token count, then leading tokens with variable fields masked."""
    head = F.regexp_extract(line, r"^[\x20\x09-\x0D]*((?:" + TOKEN + r"[\x20\x09-\x0D]*){0," + str(leading) + "})", 1)
    masked = F.regexp_replace(F.regexp_replace(head, r"[^\x20\x09-\x0D]*[0-9]" + r"[^\x20\x09-\x0D]*", _FIELD.replace("*", "\\*")), _SPLIT, " ")
    return F.xxhash64(count, F.rtrim(masked))


def _lines(text: Column, leading: int) -> Column:
    """v (the line), c (its tokens) and leaf of every line with a token."""
    counted = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("v"), F.regexp_count(x, F.lit(TOKEN)).alias("c")))
    return F.transform(F.filter(counted, lambda s: s["c"] > 0), lambda s: F.struct(s["v"].alias("v"), s["c"].alias("c"), leaf(s["v"], s["c"], leading).alias("leaf")))


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, likeness: float = LIKENESS) -> tuple[DataFrame, DataFrame]:
    """(leaf, line) hashes of the lines to drop, and (text, leaf, line) for every document's text."""
    text = F.col("text").cast("string")
    own = F.array_distinct(F.transform(_lines(text, leading), lambda s: F.struct(s["leaf"].alias("leaf"), F.xxhash64(s["v"]).alias("line"), (s["c"] > LONG).alias("long"))))
    doc = F.col("doc_id").cast("bigint")
    rows = docs.select(doc.alias("doc"), F.when(doc.isNull(), F.monotonically_increasing_id()).alias("row"), F.xxhash64(text).alias("text"), F.explode(own).alias("x"))
    seen = shared.materialise(rows.select("doc", "row", "text", "x.*"), "lines")
    once = seen
    if docs.select(doc.alias("doc")).where("doc is not null").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").head(1):
        once = shared.materialise(seen.select("doc", "row", "leaf", "line", "long").distinct(), "document-lines")
    kinds = once.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.max("long").alias("long"))
    kinds = shared.materialise(kinds.select("leaf", "line", "n", F.when(F.col("long"), F.lit(LONG_DOCS)).otherwise(F.lit(min_docs)).alias("need")), "kinds")
    # A leaf of one line has that line as its template; only leaves of several lines need their tokens.
    mixed = kinds.groupBy("leaf").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max("need").alias("need")).where("total >= need and kinds > 1").select("leaf")
    mixed = shared.materialise(mixed, "leaves")
    flat = docs.select(F.explode(_lines(text, leading)).alias("x")).select("x.leaf", F.col("x.v").alias("text"))
    texts = flat.join(mixed, "leaf").select("leaf", F.xxhash64("text").alias("line"), F.transform(_tokens(F.col("text")), _token_hash).alias("tokens"))
    texts = shared.materialise(texts.dropDuplicates(["leaf", "line"]).join(kinds, ["leaf", "line"]), "tokens")
    fitted = _templates(texts, likeness)
    drop = kinds.where("n >= need").select("leaf", "line")
    if fitted is not None:
        docs_of = once.select("doc", "row", "leaf", "line").join(fitted, ["leaf", "line"]).groupBy("template", "need", "doc", "row").agg(F.lit(1).alias("one")).groupBy("template", "need").agg(F.count("*").alias("docs"))
        found = shared.materialise(docs_of.where("docs >= need").select("template"), "recurring")
        drop = drop.unionByName(fitted.join(found, "template").select("leaf", "line"))
    return shared.materialise(drop.distinct(), "dropped-lines"), seen.select("text", "leaf", "line")


def _salted(rows: DataFrame, of_group: DataFrame, salt: Column) -> DataFrame:
    """rows joined with the one row of their group; a group of very many rows is dealt to SALTS tasks."""
    each = of_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(each, ["group", "salt"]).drop("salt")


def _templates(lines: DataFrame, likeness: float) -> DataFrame | None:
    """leaf, line, need, template of the lines (leaf, line, n, need, tokens) that belong to a template of several lines."""
    live = lines.withColumn("group", F.col("leaf"))
    found = None
    for turn in range(ROUNDS):
        sums = live.groupBy("group").agg(F.sum("n").alias("total"), F.max("need").alias("least")).where("total >= least")
        at = live.select("group", "n", F.posexplode("tokens").alias("pos", "token")).groupBy("group", "pos", "token").agg(F.sum("n").alias("n"))
        at = shared.materialise(_salted(at, sums, F.xxhash64("pos", "token")), "positions")
        # At most one constant a position, so a group's entry is no longer than its lines.
        constant = at.where(F.col("n") * 2 > F.col("total")).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("constants"))
        many = at.where((F.col("n") >= F.col("least")) & (F.col("n") < F.col("total")) & (F.pmod("token", F.lit(2)) == 0))
        pivot = many.groupBy("group", "pos").agg(F.sum("n").alias("held"), F.count("*").alias("ways")).groupBy("group")
        pivot = pivot.agg(F.min(F.struct(-F.col("held"), -F.col("ways"), "pos")).alias("p")).select("group", F.col("p.pos").alias("pivot"))
        info = shared.materialise(sums.select("group").join(constant, "group", "left").join(pivot, "group", "left"), "templates")
        x = _salted(live, info, F.col("line"))
        same = F.aggregate(F.transform("tokens", lambda t, i: F.coalesce(F.element_at("constants", i) == t, F.lit(False)).cast("int")), F.lit(0), lambda a, b: a + b)
        x = shared.materialise(x.withColumn("fits", F.coalesce(same >= F.lit(likeness) * F.size("tokens"), F.lit(False))).drop("constants"), "fitted")
        new = x.where("fits").select("leaf", "line", "need", F.xxhash64(F.lit(turn), "group").alias("template"))
        found = new if found is None else found.unionByName(new)
        if turn == ROUNDS - 1 or not x.where("not fits").head(1):
            break
        some = x.groupBy("group").agg(F.max("fits").alias("some"))
        rest = _salted(x.where("not fits"), some, F.col("line")).withColumn("at", F.get("tokens", F.col("pivot")))
        common = many.select("group", F.col("pos").alias("pivot"), F.col("token").alias("at"), F.lit(True).alias("common"))
        rest = rest.where("some or pivot is not null").join(common, ["group", "pivot", "at"], "left")
        child = F.when(F.col("some"), F.xxhash64(F.lit("rest"), "group")).otherwise(F.xxhash64(F.lit("split"), "group", "pivot", F.when(F.col("common"), F.col("at"))))
        live = shared.materialise(rest.select("leaf", "line", "n", "need", "tokens", child.alias("group")), "rest")
        if not live.head(1):
            break
    return found


def _among(drop: Column) -> Column:
    """The hashes in as many buckets as the root of their number, so that looking up all lines of a long text is no square."""
    buckets = F.ceil(F.sqrt(F.size(drop))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(buckets - 1, F.lit(0))), lambda b: F.filter(drop, lambda v: F.pmod(v, F.greatest(buckets, F.lit(1))) == b))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, likeness: float = LIKENESS) -> DataFrame:
    """docs with the lines of recurring templates taken out of text; two columns are added: n_lines (lines with a token) and n_dropped.

    A column of docs that has one of these names is replaced.
    """
    dropped, seen = recurring(docs, min_docs, leading, likeness)
    mine = seen.join(dropped, ["leaf", "line"]).groupBy(F.col("text").alias("__key")).agg(F.collect_set("line").alias("__drop"))
    rows = docs.select(F.struct("*").alias("__row"))
    # Always the same plan, so that what is shuffled follows the input at every size.
    x = rows.join(shared.materialise(mine.select("__key", _among(F.col("__drop")).alias("__drop")), "drops").hint("merge"), F.xxhash64(F.col("__row.text").cast("string")) == F.col("__key"), "left")
    text = F.col("__row.text").cast("string")
    all_lines = F.split(text, "\n")
    hit = lambda v: F.array_contains(F.get("__drop", F.pmod(F.xxhash64(v), F.size("__drop")).cast("int")), F.xxhash64(v))
    kept = F.when(F.col("__drop").isNull(), all_lines).otherwise(F.filter(all_lines, lambda v: ~hit(v)))
    x = x.select("__row", all_lines.alias("__all"), kept.alias("__kept"))
    count = F.coalesce(F.size(F.filter("__all", lambda v: v.rlike(TOKEN))), F.lit(0)).cast("bigint")
    gone = F.coalesce(F.size("__all") - F.size("__kept"), F.lit(0)).cast("bigint")
    null = F.col("__row.text").isNull()
    changed = F.when(gone > 0, F.array_join("__kept", "\n")).otherwise(F.col("__row.text").cast("string"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    columns = [changed.alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in names]
    return x.select(*columns, F.when(null, F.lit(0)).otherwise(count).cast("bigint").alias("n_lines"), F.when(null, F.lit(0)).otherwise(gone).cast("bigint").alias("n_dropped"))
