"""Mixing of sources to target weights by tokens.

Each source has a budget of tokens: its share, by weight, of all tokens of the corpus (or of a given total). Documents
have hash-random keys; a source's order is that of its keys. Where the budget exceeds the source, all its documents are
taken as often as it holds them whole; from the last, partial epoch the documents up to the budget are taken. To find the
place, keys are split into ranges of some ``RANGE_ROWS`` documents, whose token sums are added up in order; the range in
which the budget ends, one a source, is sorted and summed document by document. Decisions are then a key a source, so
texts aren't moved; only where a source repeats more than ``spread.BLOCK`` times are its copies shuffled by blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.llm.spread import repeated
from tessera.sources.tables import cut

RANGE_ROWS, SEED = 50_000, "mix"
#: Sources up to which the table of budgets is sent to all executors; beyond it the join shuffles, salted.
SENT_SOURCES, SALTS = 50_000, 16


def tokens(text: Column) -> Column:
    """Words: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def _source(c: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))


def _key(epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), epoch.cast("string"), doc_id.cast("string")))


def _with(docs: DataFrame, small: DataFrame, many: bool) -> DataFrame:
    if not many:
        return docs.join(F.broadcast(small), "_src")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("_salt", F.pmod(F.xxhash64("_n", "_id"), F.lit(SALTS)).cast("int")).join(salted, ["_src", "_salt"]).drop("_salt")


def _range() -> Column:
    return F.floor(F.conv(F.substring("_key", 1, 12), 16, 10).cast("double") / float(1 << 48) * F.col("_ranges"))


def plan(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> tuple[DataFrame, bool]:
    """One row a source: whole epochs, what is left for the partial one, and where that ends. True if there are too many
    sources to be sent around."""
    base = cut(docs.select(F.col("doc_id").alias("_id"), _source().alias("_src"), tokens(F.col("text")).alias("_n")))
    by = base.groupBy("_src").agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("rows"))
    if weights is None:
        by = by.withColumn("w", F.round(F.sqrt("t") * 1000).cast("long"))
    else:
        given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (f"s{k}", round(v * 1e9)))) if weights else F.lit(None)
        by = by.withColumn("w", F.coalesce(given[F.col("_src")], F.lit(0)).cast("long"))
    by = cut(by)
    many = by.count() > SENT_SOURCES
    whole = by.agg(F.sum("t").alias("all_t"), F.sum("w").alias("all_w"))
    by = by.crossJoin(F.broadcast(whole)).withColumn("all_t", F.lit(total) if total is not None else F.col("all_t"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    budgets = (
        by.withColumn("big", big("all_t") * big("w")).withColumn("sum_w", big("all_w")).withColumn("budget", F.expr("coalesce(big div nullif(sum_w, 0), 0)"))
        .withColumn("full", F.expr("if(t = 0, 1, budget div t)"))
        .withColumn("rest", F.expr("if(t = 0, 0, budget % t)"))
        .select("_src", F.col("full").alias("_full"), F.col("rest").alias("_rest"), F.ceil(F.col("rows") / RANGE_ROWS).alias("_ranges"))
    )
    budgets = cut(budgets)
    open_ = _with(base, budgets.filter("_rest > 0"), many).withColumn("_key", _key(F.col("_full"), F.col("_id"))).withColumn("_range", _range())
    sums = open_.groupBy("_src", "_rest", "_range").agg(F.sum("_n").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("_src").orderBy("_range")))
    ends = upto.filter("upto > _rest").groupBy("_src").agg(F.min(F.struct("_range", (F.col("_rest") - F.col("upto") + F.col("n")).alias("left"))).alias("e"))
    ends = ends.select("_src", F.col("e._range").alias("_end"), F.col("e.left").alias("_left"))
    within = _with(open_, ends, many).filter("_range = _end")
    running = F.sum("_n").over(Window.partitionBy("_src").orderBy("_key", "_id", "_n").rangeBetween(Window.unboundedPreceding, 0))
    last = within.withColumn("upto", running).filter("upto <= _left").groupBy("_src").agg(F.max(F.struct("_key", "_id", "_n")).alias("_last"))
    return cut(budgets.join(ends.select("_src", "_end"), "_src", "left").join(last, "_src", "left")), many


def _copies(docs: DataFrame, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    by, many = plan(docs, weights, total)
    df = docs.withColumn("_id", F.col("doc_id")).withColumn("_src", _source()).withColumn("_n", tokens(F.col("text")))
    df = _with(df, by, many).withColumn("_key", _key(F.col("_full"), F.col("_id"))).withColumn("_range", _range())
    inside = (F.col("_range") < F.col("_end")) | ((F.col("_range") == F.col("_end")) & (F.struct("_key", "_id", "_n") <= F.col("_last")))
    last = F.when((F.col("_rest") > 0) & F.coalesce(inside, F.lit(False)), 0).otherwise(-1)
    most = by.agg(F.coalesce(F.max("_full"), F.lit(0))).head()[0]
    return repeated(df, F.col("_full") + last + 1, int(most) + 1, "_epoch")


def sampled(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, epoch), a row for each time that a document is taken.

    weights are by source, sources not named have none; by default a source weighs the square root of its tokens. total
    is what the budgets add up to, by default all tokens. A source's last epoch is the longest run of documents in key
    order that doesn't exceed its budget; documents of equal key, doc_id and tokens go together. A null source is a
    source of its own; texts that are null or empty have no tokens and go with their keys; a source without any tokens
    is taken once. A null doc_id has a key like any other. Extra columns play no part.
    """
    plain = docs.select("doc_id", "source", "text")
    return _copies(plain, weights, total).select("doc_id", "source", F.col("_n").alias("n_tokens"), F.col("_epoch").alias("epoch"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """The rows of docs as often as sampled() takes them, with all their columns."""
    names = {c: f"x{i}" if c not in ("doc_id", "source", "text") else c for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return _copies(plain, weights, total).select(*(F.col(n).alias(c) for c, n in names.items()))
