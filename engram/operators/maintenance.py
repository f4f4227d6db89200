"""Deletes, upserts, eviction and access times as plans over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.schemas import OF_ENTRY

Tables = dict[str, DataFrame]


def in_context_list(context: Column, names: str) -> Column:
    """Whether ``context`` is one of a comma list, exactly; a null context is in none."""
    return F.coalesce(context.isin(names.split(",")), F.lit(False))


def under_directory(path: Column, directory: str, legacy_like: bool = False) -> Column:
    """Whether ``path`` lies in ``directory``; ``legacy_like`` is the looser prefix test, which also meets siblings."""
    if legacy_like:
        return F.lower(path).like(directory.lower() + "%")
    return path.startswith(directory.rstrip("/") + "/")


def without(tables: Tables, hashes: DataFrame) -> Tables:
    """The tables without the entries of ``hashes`` (hash) and all that belongs to them."""
    gone = hashes.select("hash").distinct()
    return tables | {name: tables[name].join(gone, "hash", "left_anti") for name in OF_ENTRY if name in tables}


def cleared(tables: Tables) -> Tables:
    """Empty content, chunks and index; settings and cache stay."""
    return tables | {name: tables[name].limit(0) for name in (*OF_ENTRY, "totals") if name in tables}


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cache_hits(chunks: DataFrame, cache: DataFrame, provider: str, model: str) -> DataFrame:
    """``chunks`` (text_hash) plus ``embedding``, null where the cache has none of the stated size."""
    known = cache.filter((F.col("provider") == provider) & (F.col("model") == model) & (F.size("embedding") == F.col("dimension")))
    return chunks.join(known.select("text_hash", "embedding"), "text_hash", "left")


def evicted(cache: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest rows of the cache (0: all).  The limit is the feature:
    the oldest row that stays is found by a top-k, not by sorting the table in one task."""
    if most <= 0:
        return cache
    edge = cache.select("ins_seq").orderBy(F.col("ins_seq").desc()).limit(most).agg(F.min("ins_seq").alias("edge"))
    return cache.join(F.broadcast(edge), F.col("ins_seq") >= F.col("edge")).drop("edge")  # one row


def cache_without(cache: DataFrame, provider: str | None = None, model: str | None = None) -> DataFrame:
    """The cache without one model's rows, or empty."""
    if provider is None and model is None:
        return cache.limit(0)
    return cache.filter(~((F.col("provider") == provider) & (F.col("model") == model)))


def last_access(content: DataFrame, log: DataFrame) -> DataFrame:
    """``content`` with the latest time of the access log (hash, ts) where there is one."""
    latest = log.groupBy("hash").agg(F.max("ts").alias("ts"))
    return content.join(latest, "hash", "left").withColumn("last_accessed", F.greatest(F.col("last_accessed"), F.coalesce("ts", F.lit(0)))).drop("ts").select(*content.columns)


def first_of_each(docs: DataFrame, key: str = "hash", order: str = "arrival") -> DataFrame:
    """One row of each key, the first to arrive."""
    seen = Window.partitionBy(key).orderBy(order)
    return docs.withColumn("_nth", F.row_number().over(seen)).filter("_nth = 1").drop("_nth")


def rebuild_plan(content: DataFrame, files: DataFrame) -> DataFrame:
    """``content`` plus ``text`` and ``rebuild_from``: where the text of each entry comes
    from when the model changes - the file (``files``: path, text) that is still there,
    the stored value, or nowhere (the entry goes)."""
    here = files.dropDuplicates(["path"]).select("path", F.col("text").alias("file_text"), F.lit(True).alias("on_disk"))
    source = F.when(F.col("on_disk"), "file").when(F.col("value").isNotNull(), "value").otherwise("dropped")
    both = content.join(here, "path", "left").withColumn("rebuild_from", source)
    return both.withColumn("text", F.coalesce("file_text", "value")).drop("on_disk", "file_text")


def token_statistics(index: DataFrame) -> DataFrame:
    """(context, chunks, tokens) of the text index."""
    return index.groupBy("context").agg(F.count("*").alias("chunks"), F.sum("dl").alias("tokens"))
