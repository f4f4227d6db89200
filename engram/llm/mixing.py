"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of all words, clamped at
``max_epochs`` times its size; what a clamped source cannot take is reshared by
weight among the others until none is above its clamp.  With the sources in the
order of clamp / weight this has a closed form: the clamped sources are a prefix
of that order, found with running sums, so no loop runs on the driver.

A source's documents then repeat ``floor(target / size)`` times in full, and a
seeded sample of whole documents repeats once more: documents stand in the order
of a seeded hash, and those are taken whose running size stays within the
missing part.  The running sum is over hash buckets first and over the documents
of one bucket after that, so that no source has to fit into one task.  The gap
that is left goes to the one open document whose size is nearest to it.

Defined results: a null or empty text has size 0; a null source is a source of
its own, last in order; a source of size 0 has target 0; repeated rows count
each; an empty table gives an empty result.  Equal rows (same id and text) have
the same hash, and which of them is sampled does not change the result as a bag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.session import cut

MAX_EPOCHS = 3
SEED = 42
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets for the rows (source, source_size) of ``sources``, which has a row
    for each source: small beside the documents, so the windows over the whole
    table are over sums, never over documents."""
    whole = Window.partitionBy()
    weighted = sources.withColumn("weight", ((F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    ordered = whole.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    share = (
        weighted.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("clamped_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_epochs)
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("clamped", F.col("source_size") * max_epochs * F.col("weight_left") <= F.col("weight") * (F.col("total") - F.col("clamped_before")))
    )
    rest = share.withColumn("words_left", F.col("total") - max_epochs * F.coalesce(F.sum(F.when(F.col("clamped"), F.col("source_size"))).over(whole), F.lit(0)))
    rest = rest.withColumn("weight_open", F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(whole))
    target = F.when(F.col("clamped"), (F.col("source_size") * max_epochs).cast("double")).otherwise((F.col("weight") * F.col("words_left")).cast("double") / F.col("weight_open").cast("double"))
    return rest.select("source", "source_size", "weight", target.alias("target"))


def sampled(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Repeats of each row of ``docs`` (doc_id, source, size, row; row: a stable number of its own)."""
    spread = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    rows = docs.withColumn("spread", spread).withColumn("bucket", F.pmod(F.col("spread"), F.lit(BUCKETS)))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = water_fill(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), max_epochs)
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = buckets["source"].eqNullSafe(targets["source"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = (
        buckets.join(targets, same)
        .select(targets["*"], "bucket", "bucket_size")
        .withColumn("repeats", whole)
        .withColumn("missing", F.col("target") - F.col("repeats") * F.col("source_size"))
        .withColumn("before", F.coalesce(F.sum("bucket_size").over(in_order), F.lit(0)))
        .withColumn(
            "once_more",
            F.when(F.col("before") + F.col("bucket_size") <= F.col("missing"), F.lit(1)).when(F.col("before") < F.col("missing"), F.lit(None)).otherwise(F.lit(0)),
        )
    )
    on = rows["source"].eqNullSafe(plan["source"]) & (rows["bucket"] == plan["bucket"])
    joined = rows.join(plan, on).select(rows["*"], *[plan[c] for c in ("source_size", "target", "repeats", "missing", "before", "once_more")])
    open_bucket = Window.partitionBy("source", "bucket").orderBy("spread", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    decided = joined.filter(F.col("once_more").isNotNull())
    split = joined.filter(F.col("once_more").isNull()).withColumn("until", F.col("before") + F.sum("size").over(open_bucket))
    split = split.withColumn("once_more", F.when(F.col("until") <= F.col("missing"), 1).otherwise(0)).drop("until")
    prefix = cut(decided.unionByName(split))
    # One more document closes the gap that the prefix leaves: the one of the nearest size.
    gaps = prefix.groupBy("source", "missing").agg(F.sum(F.col("size") * F.col("once_more")).alias("got")).select(F.col("source").alias("of"), (F.col("missing") - F.col("got")).alias("gap"))
    open_rows = prefix.filter("once_more = 0").join(gaps, F.col("source").eqNullSafe(F.col("of")))
    last = open_rows.filter(F.abs(F.col("size") - F.col("gap")) < F.col("gap")).groupBy("of").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("spread"), F.col("row"))).alias("pick"))
    last = last.select("of", F.col("pick.row").alias("last_row"))
    done = prefix.join(last, F.col("source").eqNullSafe(F.col("of")), "left")
    extra = F.col("once_more") + F.when(F.col("row") == F.col("last_row"), 1).otherwise(0)
    return done.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("repeats") + extra).cast("long").alias("repeats"))


def mix_sources(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The digest that query op7 returns: for each document its size and the
    words that the mixture takes of it."""
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row")))
    return sampled(sizes, max_epochs, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats")


def mixture(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus itself: every row that is taken, once for each repeat.

    Rows get a number once, in the shared folder, and repeats come back by it, so
    rows that repeat an id and a size each keep their own repeats."""
    numbered = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.monotonically_increasing_id().alias("row")))
    sizes = cut(numbered.select(F.col("whole.doc_id").alias("doc_id"), F.col("whole.source").alias("source"), word_count(F.col("whole.text")).alias("size"), "row"))
    taken = sampled(sizes, max_epochs, seed).filter("repeats > 0").select("row", "repeats")
    joined = numbered.join(taken, "row")
    return joined.select("whole", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("repeat")).select("whole.*")
