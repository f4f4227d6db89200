"""Full-text ranking by BM25 over postings, for many queries at once.

Postings are those of an index that is stored (``Memory``), or of texts turned over in
the plan itself (``indexed``); either way words of the queries alone are looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions.text import query_terms, tokens
from engram.operators.postings import inverted
from engram.operators.textjoin import asked_words, joined_ranks
from engram.session import cut

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def indexed(docs: DataFrame, fold: bool = False) -> DataFrame:
    """``docs`` (hash, seq, content) plus the tokens ``words`` and their number ``dl``."""
    return docs.withColumn("words", tokens(F.col("content"), fold)).withColumn("dl", F.size("words").cast("long"))


def corpus_statistics(index: DataFrame) -> DataFrame:
    """One row: texts and mean length of the whole index."""
    return index.agg(F.count("*").alias("n_texts"), F.avg("dl").alias("mean_dl"))


def idf(df: Column, n: Column) -> Column:
    """The weight of a word that ``df`` of ``n`` texts hold."""
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def weighed(weight, tf, dl, mean):
    """What a word of this weight adds to a text's rank, for columns or arrays: the only place where BM25 stands."""
    return -weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def part(tf: Column, dl: Column, df: Column, n: Column, mean: Column) -> Column:
    """What a word adds to a text's rank.  Lower is better."""
    return weighed(idf(df, n), tf, dl, mean)


def first_rows(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query with their ``position``; ties by hash and seq."""
    order = Window.partitionBy("query_id").orderBy("rank", "hash", "seq")
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def rank_words(postings: DataFrame, totals: DataFrame, queries: DataFrame, k: int, require_all: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, hash, seq, rank, position): the best ``k`` texts for each of ``queries``
    (query_id, term), from ``postings`` and the one row of ``totals`` (n_texts, mean_dl).

    Frequencies and lengths are those of the whole index; ``allowed`` (hash)
    restricts the texts that are ranked.  Ranks are compared to nine decimals,
    ties by hash and seq."""
    wanted = queries.select("query_id", "term").distinct()
    tf = postings.select("hash", "seq", "dl", "term", "tf").join(wanted.select("term").distinct(), "term")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    value = part(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_texts"), F.col("mean_dl"))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(totals)).select("hash", "seq", "term", value.alias("part"))  # one row of statistics
    if allowed is not None:
        weighed = weighed.join(allowed.select("hash").distinct(), "hash", "left_semi")
    scored = weighed.join(wanted, "term").groupBy("query_id", "hash", "seq").agg(F.round(F.sum("part"), 9).alias("rank"), F.count("*").alias("hits"))
    if require_all:
        scored = scored.join(wanted.groupBy("query_id").agg(F.count("*").alias("needed")), "query_id").filter("hits = needed")
    return first_rows(scored.select("query_id", "hash", "seq", "rank"), k)


def bm25_topk(index: DataFrame, queries: DataFrame, k: int, require_all: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """What ``rank_words`` gives over the texts of ``index`` (hash, seq, words, dl), for any number of
    queries: blocks of queries and texts meet, and no match is a row (``textjoin``).

    Texts are read once, at once; their words that are asked for stay in the shared folder."""
    wanted = cut(queries.filter("term is not null").select("query_id", "term").distinct())
    held = cut(asked_words(index, wanted))
    told = held.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), F.sum(F.size("tfs")).alias("postings")).first()
    df = held.filter("terms <> ''").select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = wanted.join(df, "term", "left").select("query_id", "term", idf(F.coalesce("df", F.lit(0)), F.lit(told.n)).alias("idf"))
    texts = held if allowed is None else held.join(allowed.select("hash").distinct(), "hash", "left_semi")
    n_queries = wanted.select("query_id").distinct().count()
    return first_rows(joined_ranks(texts, asked, told.mean or 1.0, k, require_all, n_queries, told.postings or 0), k)


def normalised(ranked: DataFrame) -> DataFrame:
    """``ranked`` plus ``text_score``: 1 for the best row of a query, 0 for the worst, 1 where all are equal."""
    of_query = Window.partitionBy("query_id")
    low, high = F.min("rank").over(of_query), F.max("rank").over(of_query)
    return ranked.withColumn("text_score", F.when(high == low, F.lit(1.0)).otherwise((high - F.col("rank")) / (high - low)))


def well_formed(query: str) -> bool:
    """Whether every operator of a query has its sides."""
    try:
        query_terms(query)
    except ValueError:
        return False
    return True


def is_disjunction(query: str) -> bool:
    """Whether a query is words joined by OR alone."""
    return well_formed(query) and all(len(b["need"]) == 1 and len(b["need"][0]) == 1 and not b["without"] for b in query_terms(query))


def words_of(queries: list[str]) -> list[str]:
    """The words of ``queries`` that decide anything, excluded ones too."""
    found = {w for q in queries for b in query_terms(q) for p in [*b["need"], *(p for group in b["without"] for p in group)] for w in p}
    return sorted(found)


def _parsed(spark: SparkSession, queries: list[str]) -> tuple[list[list[str]], DataFrame]:
    """The distinct phrases of ``queries``, and a row (query_id, branches, scoring) for each
    query: its alternatives and the phrases that score, by number."""
    branches = [query_terms(q) for q in queries]
    numbers: dict[tuple[str, ...], int] = {}
    number = lambda phrase: numbers.setdefault(tuple(phrase), len(numbers))
    rows = []
    for i, alternatives in enumerate(branches):
        told = [{"need": [number(p) for p in b["need"]], "without": [[number(p) for p in group] for group in b["without"]]} for b in alternatives]
        rows.append((i, told, sorted({p for b in told for p in b["need"]})))
    schema = "query_id long, branches array<struct<need:array<int>,without:array<array<int>>>>, scoring array<int>"
    return [list(p) for p in numbers], spark.createDataFrame(rows, schema)


def occurrences(postings: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(hash, seq, dl, phrase, tf): how often each of ``phrases`` stands in each text.  A phrase
    stands where the places of its words follow each other; only its words' postings meet."""
    rows = [(k, i, word, len(words)) for k, words in enumerate(phrases) for i, word in enumerate(words)]
    wanted = postings.sparkSession.createDataFrame(rows, "phrase int, at int, term string, size int")
    single = postings.select("hash", "seq", "dl", "tf", "term").join(wanted.filter("size = 1"), "term").select("hash", "seq", "dl", "phrase", F.col("tf").cast("long").alias("tf"))
    if all(len(words) < 2 for words in phrases):
        return single
    placed = postings.join(wanted.filter("size > 1"), "term").select("hash", "seq", "dl", "phrase", "size", "at", F.explode("positions").alias("pos"))
    longer = placed.groupBy("hash", "seq", "dl", "phrase", "size", (F.col("pos") - F.col("at")).alias("begin")).agg(F.count("*").alias("n")).filter("n = size")
    return single.unionByName(longer.groupBy("hash", "seq", "dl", "phrase").agg(F.count("*").alias("tf")))


def satisfying(postings: DataFrame, queries: list[str]) -> DataFrame:
    """(query_id, hash, seq, dl, hits) of the texts that satisfy each query with phrases and
    AND, OR, NOT; ``hits``: the scoring phrases of the query that the text holds, with their
    frequency in the text and the texts that hold them."""
    phrases, parsed = _parsed(postings.sparkSession, queries)
    found = occurrences(postings, phrases)
    df = found.groupBy("phrase").agg(F.count("*").alias("df"))
    asked = parsed.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("branches", lambda b: F.concat(b["need"], F.flatten(b["without"])))))).alias("phrase"))
    held = found.join(df, "phrase").join(asked, "phrase")
    texts = held.groupBy("query_id", "hash", "seq", "dl").agg(F.collect_list(F.struct("phrase", "tf", "df")).alias("hits"))  # as many as a query has phrases
    present = F.transform("hits", lambda h: h["phrase"])
    holds = lambda p: F.array_contains(present, p)
    satisfied = F.exists("branches", lambda b: F.forall(b["need"], holds) & ~F.exists(b["without"], lambda group: F.forall(group, holds)))
    judged = texts.join(parsed, "query_id").filter(satisfied)
    return judged.select("query_id", "hash", "seq", "dl", F.filter("hits", lambda h: F.array_contains(F.col("scoring"), h["phrase"])).alias("hits"))


def matching(index: DataFrame, queries: list[str]) -> DataFrame:
    """``satisfying`` over the texts of ``index``."""
    return satisfying(inverted(index), queries)


def rank_queries(postings: DataFrame, totals: DataFrame, queries: list[str], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, hash, seq, rank) of the best ``k`` texts that satisfy each of ``queries``, as
    one plan; excluded phrases don't score.  ``allowed`` (hash) restricts the texts, not the statistics."""
    rows = satisfying(postings, queries).filter(F.size("hits") > 0)
    if allowed is not None:
        rows = rows.join(allowed.select("hash").distinct(), "hash", "left_semi")
    rows = rows.crossJoin(F.broadcast(totals))  # one row of statistics
    parts = F.transform("hits", lambda h: part(h["tf"], F.col("dl"), h["df"], F.col("n_texts"), F.col("mean_dl")))
    rank = F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 9)
    return first_rows(rows.select("query_id", "hash", "seq", rank.alias("rank")), k).drop("position")


def bm25_search(index: DataFrame, queries: list[str], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """``rank_queries`` over the texts of ``index``."""
    return rank_queries(inverted(index), corpus_statistics(index), queries, k, allowed)
