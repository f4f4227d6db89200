"""The best texts by BM25 for many queries at once, as a join of blocks.

A query with frequent words matches a large share of all texts, so matches grow with the
product of queries and texts; as rows of a join they fill any disk.  Here query blocks and
text blocks meet in pairs, dealt over tasks.  A pair adds up its scores in arrays, one query
after the other, and sends its best ``k`` texts of each query on: what is shuffled are the
texts' words that some query asks for, and ``k`` rows of each query and pair.

Within a pair, words that can't lift a text to the ``k``-th best score are looked up for the
texts that are left alone (MaxScore): the ``k``-th best posting of any of a query's words is
a score that ``k`` texts reach.  Bounds are compared with room for rounding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.session import cut

#: Queries of a block.
QUERY_ROWS = 32_768
#: Postings of a block of texts, and so few that more tasks than there are cores don't pay.
POSTINGS, FEW_POSTINGS = 1 << 21, 1 << 17
#: Distinct words of all queries that travel to the texts; where there are more, texts send all their words.
WORDS = 1 << 17
#: Room for rounding when a bound is compared; ranks have nine decimals.
SLACK = 1e-7
#: What a pair gets of its postings: word, text (hash, seq), length and frequency, one by one.
Flat = tuple[pa.Array, pa.Array, pa.Array, np.ndarray, np.ndarray]


def _asked_words(words: pa.Array | None):
    """The words of each text that are among ``words`` (None: all), joined by blanks, with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.num_rows, batch.column("words")
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            if words is not None:
                known = pc.is_in(coded.dictionary, value_set=words).to_numpy(zero_copy_only=False)
                some = known[code]
                code, row = code[some], row[some]
            key, tf = np.unique(row * max(1, len(coded.dictionary)) + code, return_counts=True)
            row, code = np.divmod(key, max(1, len(coded.dictionary)))
            offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            terms = pc.binary_join(pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(code))), " ")
            tfs = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("hash", "seq", "dl")), terms, tfs], names=["hash", "seq", "dl", "terms", "tfs"])

    return run


def asked_words(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, seq, dl, terms, tfs) of every text of ``index`` (hash, seq, words, dl): its words that
    are among ``wanted`` (term), joined by blanks, and how often each stands in it."""
    words = [r.term for r in wanted.filter("term is not null").select("term").distinct().limit(WORDS + 1).collect()]
    known = pa.array(words, pa.string()) if len(words) <= WORDS else None
    kinds = {f.name: f.dataType.simpleString() for f in index.schema}
    schema = f"hash {kinds['hash']}, seq {kinds['seq']}, dl long, terms string, tfs array<int>"
    return index.select("hash", "seq", "dl", "words").mapInArrow(_asked_words(known), schema)


def _of_texts(rows: pa.Table) -> Flat:
    """The postings of rows of ``asked_words``."""
    rows = rows.combine_chunks()
    column = lambda c: rows.column(c).chunk(0)
    lists = pc.split_pattern(column("terms"), " ")
    of = pa.array(np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy())))
    return lists.flatten(), column("hash").take(of), column("seq").take(of), column("dl").take(of).to_numpy(), column("tfs").flatten().to_numpy()


def _of_blocks(rows: pa.Table) -> Flat:
    """The postings of blocks (``postings.BLOCKS``)."""
    rows = rows.combine_chunks()
    column = lambda c: rows.column(c).chunk(0)
    of = pa.array(np.repeat(np.arange(len(rows)), np.diff(column("hashes").offsets.to_numpy())))
    return column("term").take(of), column("hashes").flatten(), column("seqs").flatten(), column("dls").flatten().to_numpy(), column("tfs").flatten().to_numpy()


def _numbered(hashes: pa.Array, seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each posting's text, in the order of (hash, seq), nulls first, and a posting of each text."""
    none = hashes.is_null().to_numpy(zero_copy_only=False)
    value, seq = (pc.fill_null(a, 0).to_numpy(zero_copy_only=False) for a in (hashes, seqs))
    order = np.lexsort((seq, value, ~none))
    head = np.ones(len(order), dtype=bool)
    head[1:] = np.any([a[order][1:] != a[order][:-1] for a in (none, value, seq)], axis=0)
    text = np.empty(len(order), dtype=np.int64)
    text[order] = np.cumsum(head) - 1
    return text, order[head]


class _Postings:
    """The weighed postings of a block of texts, by word."""

    def __init__(self, term: np.ndarray, text: np.ndarray, part: np.ndarray, n_terms: int, k: int):
        order = np.lexsort((text, term))
        term, text, part = term[order], text[order], part[order]
        head = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])]))
        # Rows of one (hash, seq) are one text of the ranking.
        self.text, self.part = text[head], np.add.reduceat(part, head)
        self.rows = None if len(head) == len(term) else np.diff(np.append(head, len(term)))
        self.start = np.searchsorted(term[head], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        held = np.flatnonzero(np.diff(self.start))
        self.most[held] = -np.minimum.reduceat(self.part, self.start[held])
        self.k, self._reached = k, {}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.start[term], self.start[term + 1])
        return self.text[part], self.part[part]

    def reached(self, term: int) -> float:
        """A score that ``k`` texts reach by this word alone."""
        if term not in self._reached:
            parts = self.of(term)[1]
            self._reached[term] = -np.partition(parts, self.k - 1)[self.k - 1] if len(parts) >= self.k else 0.0
        return self._reached[term]

    def at(self, term: int, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``texts`` hold a word, and what it adds to each of them."""
        here, parts = self.of(term)
        place = np.minimum(np.searchsorted(here, texts), len(here) - 1)
        held = here[place] == texts
        return held, np.where(held, parts[place], 0.0)


def _candidates(of: _Postings, terms: list[int], scores: np.ndarray) -> np.ndarray:
    """The texts that may be among the best for ``terms``, in rising order; ``scores`` is zeros, and is so again."""
    reached = max(of.reached(t) for t in terms) - SLACK
    rising = sorted(terms, key=lambda t: (of.most[t], t))
    below = np.cumsum([of.most[t] for t in rising])
    left_out = int(np.searchsorted(below, reached, side="left")) if reached > 0 else 0
    for t in rising[left_out:]:
        texts, parts = of.of(t)
        scores[texts] -= parts
    rest = below[left_out - 1] if left_out else 0.0
    found = np.flatnonzero(scores > 0) if reached <= rest else np.flatnonzero(scores >= reached - rest)
    scored = scores[found]
    scores[:] = 0.0
    for i in range(left_out - 1, -1, -1):
        scored = scored - of.at(rising[i], found)[1]
        some = scored >= reached - (below[i - 1] if i else 0.0)
        found, scored = found[some], scored[some]
    if len(scored) > of.k:
        found = found[scored >= np.partition(scored, len(scored) - of.k)[len(scored) - of.k] - SLACK]
    return found


def _holding_all(of: _Postings, terms: list[int], needed: int, n_texts: int) -> np.ndarray:
    """The texts that hold all ``needed`` words, of which the block holds ``terms``; counted by
    postings, as ``rank_words`` does where ids repeat."""
    if of.rows is not None:
        hits = np.zeros(n_texts, dtype=np.int64)
        for t in terms:
            hits[of.of(t)[0]] += of.rows[of.start[t] : of.start[t + 1]]
        return np.flatnonzero(hits == needed)
    if len(terms) < needed:
        return np.zeros(0, dtype=np.int64)
    rarest, *others = sorted(terms, key=lambda t: of.start[t + 1] - of.start[t])
    texts = of.of(rarest)[0]
    for t in others:
        texts = texts[of.at(t, texts)[0]]
    return texts


def _pair(k: int, require_all: bool, mean: float, flat: Callable[[pa.Table], Flat], schema: pa.Schema):
    """The best ``k`` texts of a block for each query of another."""
    from engram.operators.fulltext import weighed

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return schema.empty_table()
        queries = queries.sort_by([("query_id", "ascending"), ("term", "ascending")]).combine_chunks()
        asked = queries.column("term").chunk(0).dictionary_encode()
        code = asked.indices.to_numpy()
        idf = np.empty(len(asked.dictionary))
        idf[code] = queries.column("idf").to_numpy()
        words, hashes, seqs, dl, tf = flat(rows)
        coded = words.dictionary_encode()
        term = pc.fill_null(pc.index_in(coded.dictionary, value_set=asked.dictionary), -1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
        some = np.flatnonzero(term >= 0)
        if not len(some):
            return schema.empty_table()
        term, hashes, seqs = term[some], hashes.take(pa.array(some)), seqs.take(pa.array(some))
        text, one = _numbered(hashes, seqs)
        of = _Postings(term, text, weighed(idf[term], tf[some].astype(np.float64), dl[some].astype(np.float64), mean), len(idf), k)
        ids = queries.column("query_id").chunk(0)
        number = ids.dictionary_encode().indices.to_numpy()
        head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        scores, best = np.zeros(len(one)), []
        for a, b in zip(head, [*head[1:], len(number)], strict=True):
            mine = code[a:b]
            terms = [int(t) for t in mine if of.start[t] < of.start[t + 1]]
            if not terms:
                continue
            found = _holding_all(of, terms, len(mine), len(one)) if require_all else _candidates(of, terms, scores)
            # Scores of what is left are added up in the order of the words, alike in all blocks.
            rank = np.zeros(len(found))
            for t in terms:
                rank += of.at(t, found)[1]
            nine = np.rint(rank * 1e9)
            first = np.lexsort((found, nine))[:k]
            best.append((np.full(len(first), a), found[first], nine[first] / 1e9))
        if not best:
            return schema.empty_table()
        at, found, rank = (np.concatenate(c) for c in zip(*best, strict=True))
        taken = pa.array(one[found])
        return pa.Table.from_arrays([ids.take(pa.array(at)), hashes.take(taken), seqs.take(taken), pa.array(rank)], schema=schema)

    return run


def _every(n: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def text_blocks(postings: int, tasks: int) -> int:
    """How many blocks so many postings make up."""
    return max(_blocks(postings, POSTINGS), min(tasks, _blocks(postings, FEW_POSTINGS)))


def _met(queries: DataFrame, rows: DataFrame, k: int, require_all: bool, mean: float, flat: Callable[[pa.Table], Flat], kinds: dict[str, str]) -> DataFrame:
    """(query_id, hash, seq, rank): the best ``k`` of each pair of blocks, of ``queries`` (query_id, term,
    idf) and ``rows``, both with ``qb`` and ``tb``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"query_id {kinds['query_id']}, hash {kinds['hash']}, seq {kinds['seq']}, rank double"
    schema = to_arrow_schema(queries.sparkSession.createDataFrame([], ddl).schema)
    by = ["qb", "tb"]
    return queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(_pair(k, require_all, mean, flat, schema), ddl)


def query_block(n: int) -> Column:
    return F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")


def joined_ranks(texts: DataFrame, queries: DataFrame, mean: float, k: int, require_all: bool, n_queries: int, n_postings: int) -> DataFrame:
    """(query_id, hash, seq, rank): the best ``k`` of ``texts`` (``asked_words``) for each of ``queries``
    (query_id, term, idf) are among the rows."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema} | {"query_id": dict(queries.dtypes)["query_id"]}
    nq = _blocks(n_queries, QUERY_ROWS)
    nt = text_blocks(n_postings, texts.sparkSession.sparkContext.defaultParallelism)
    asked = queries.select("query_id", "term", "idf", query_block(nq).alias("qb"), _every(nt, "tb"))
    held = texts.filter("terms <> ''").withColumn("tb", F.pmod(F.xxhash64("hash", "seq"), F.lit(nt)).cast("int")).select("*", _every(nq, "qb"))
    return _met(asked, held, k, require_all, mean, _of_texts, kinds)


def stored_ranks(blocks: DataFrame, queries: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(query_id, hash, seq, rank): the best ``k`` texts of a stored index in segments
    (``postings.segmented``) for each of ``queries`` (query_id, term) are among the rows.  Of the index,
    the blocks of the queries' words are read, without their places."""
    from engram.operators.fulltext import idf

    wanted = cut(queries.filter("term is not null").select("query_id", "term").distinct())
    words = cut(wanted.select("term").distinct())
    told = totals.first()
    mine = blocks.join(F.broadcast(words) if words.count() <= WORDS else words, "term", "left_semi")
    df = mine.groupBy("term").agg(F.sum("n").alias("df"))
    nq = _blocks(wanted.select("query_id").distinct().count(), QUERY_ROWS)
    asked = wanted.join(df, "term", "left").select("query_id", "term", idf(F.coalesce("df", F.lit(0)), F.lit(told.n_texts)).alias("idf"), query_block(nq).alias("qb"))
    asked = asked.crossJoin(F.broadcast(mine.select(F.col("part").alias("tb")).distinct()))  # as many rows as segments
    rows = mine.select("term", "hashes", "seqs", "dls", "tfs", F.col("part").alias("tb"), _every(nq, "qb"))
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "hash": "bigint", "seq": "int"}
    return _met(asked, rows, k, False, told.mean_dl or 1.0, _of_blocks, kinds)
