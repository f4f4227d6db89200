"""Phrase collocation mining with stripes.

A stripe belongs to a prefix (up to three words of a language) and holds a counter for
each next word, and one for all occurrences that no wanted word follows.  Stripes are
made level by level:

0. The stripe of the empty prefix counts words.  Its sum is the language's size.
1. to 3. Each task counts stripes of its texts, joined in memory before anything is
   sent.  Stripes of one prefix meet and are added up element by element.  An entry is
   how often prefix and word occur together, a stripe's sum how often the prefix
   occurs, and its greatest entry how often its commonest extension does; so phrases,
   the parts of their cuts and what subsumes them are read from one structure.

A phrase that is frequent enough has frequent parts only.  So a task leaves a prefix, or
a next word, that can't be part of one to the common counter: frequent phrases of a
level set a bit of a filter of fixed size (``BITS``), which travels to the tasks of the next one.
The filter lets some others through, never the other way round, so counts are exact.
Stripes of a bucket of first words travel as one row.  Where a first word occurs more than ``QUOTA``
times, its stripes are dealt into parts by their next words; buckets are as many as the corpus
needs.  So what a task adds up at once is bounded.

Scores are integers of exact decimals.  Words are known by 64-bit hashes until the
phrases that are returned get their words back.

Defined results: a null language is ``und``, like that text itself; null or empty texts
have no words; repeated rows and ids count as often as they stand there; a piece of
text is never longer than its document, and phrases never cross pieces.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.session import cut
from engram.llm.textops import IS_WORD, LOWER, U64, mix, slices, utf8, words

LONGEST = 4
LEAST, PERCENT, TOP, FACTOR = 30, 80, 2000, 2_000_000
#: Bits of the filter of a level: 8 MB, however many phrases are frequent.
BITS = 1 << 26
#: Occurrences of a key from which on its stripes are dealt into parts by their next words; words
#: of the corpus for each bucket of keys.
QUOTA, BUCKET = 4_000_000, 500_000
#: Bytes of text and entries of stripes that a task holds at once.
SLICE, HELD = 4 << 20, 2_000_000
#: Where pieces end, and what words are made of.
IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IS_PART = IS_WORD & ~IS_BREAK
_STEP = U64(0x9E3779B97F4A7C15)


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _grown(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return mix(phrase * U64(31) ^ (word + _STEP))


class _Text:
    """The words of some rows: hash, number of the row's language, and whether the next word is of the same piece."""

    def __init__(self, part: pa.RecordBatch, known: dict[str, int]):
        column = part.column("text")
        w = words(column, table=IS_PART)
        self.data, _ = utf8(column)
        self.start, self.end, self.hash = w.start, w.end, np.maximum(w.hash, U64(1))  # 0 is no word
        row = np.repeat(np.arange(part.num_rows), np.diff(w.first))
        coded = part.column("lang").dictionary_encode()
        numbers = np.array([known.setdefault(x, len(known)) for x in coded.dictionary.to_pylist()], dtype=np.int64)
        self.lang = numbers[coded.indices.to_numpy()][row] if len(row) else np.zeros(0, np.int64)
        seeds = np.array([_seed(x) for x in known], dtype=U64)
        self.seed = seeds[self.lang]
        piece = np.cumsum(IS_BREAK[self.data], dtype=np.int32)[self.start]
        self.same = np.zeros(len(row), dtype=bool)
        self.same[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])


def _heads(columns: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows begin to differ from the row before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, word, f) of some rows at a time."""
    known: dict[str, int] = {}
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            t = _Text(part, known)
            if not len(t.hash):
                continue
            order = np.argsort(t.hash ^ t.seed)
            head = _heads([t.hash[order], t.lang[order]])
            first, count = order[head], np.diff(np.append(head, len(order)))
            size = t.end[first] - t.start[first]
            ends = np.concatenate([[0], np.cumsum(size)])
            letters = LOWER[t.data[np.repeat(t.start[first] - ends[:-1], size) + np.arange(ends[-1])]]
            text = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)])
            yield pa.RecordBatch.from_arrays([pa.array(list(known)).take(pa.array(t.lang[first])), pa.array(t.hash[first].view(np.int64)), text, pa.array(count)], names=["lang", "h", "word", "f"])


def _bit(phrase: np.ndarray, bits: int) -> np.ndarray:
    return (phrase >> U64(64 - bits.bit_length() + 1)).astype(np.int64)


def _bits_of(m: int, bits: int):
    """The bits (slot, bits) that phrases (lang, p1 .. p{m}, next) set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("lang").dictionary_encode()
            phrase = np.array([_seed(x) for x in coded.dictionary.to_pylist()], dtype=U64)[coded.indices.to_numpy()]
            for c in [*(f"p{i}" for i in range(1, m + 1)), "next"]:
                phrase = _grown(phrase, batch.column(c).to_numpy().view(U64))
            bit = np.sort(_bit(phrase, bits))
            head = _heads([bit >> 6])
            ored = np.bitwise_or.reduceat(np.left_shift(np.int64(1), bit & 63), head)
            yield pa.RecordBatch.from_arrays([pa.array((bit[head] >> 6).astype(np.int32)), pa.array(ored)], names=["slot", "bits"])

    return run


def _filter(frequent: DataFrame, m: int) -> np.ndarray:
    """The filter of the frequent phrases of ``m + 1`` words: ``BITS`` bits, in longs."""
    set_bits = frequent.mapInArrow(_bits_of(m, BITS), "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, dtype=np.int64)
    out[set_bits.column("slot").to_numpy()] = set_bits.column("bits").to_numpy()
    return out


def _passes(filter_bits: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    bit = _bit(phrase, len(filter_bits) << 6)
    return (filter_bits[bit >> 6] >> (bit & 63)) & 1 == 1


class _Stripes:
    """Counters of (lang, prefix, next), added up as they come.  Stripes of first words (keys) whose
    hashes begin with the same ``bits`` share a row."""

    def __init__(self, m: int, bits: int = 6, most: int = HELD):
        self.m, self.bits, self.most, self.parts, self.held = m, bits, most, [], 0

    def add(self, columns: list[np.ndarray]) -> None:
        """Columns: hash of the key, lang, p1 .. p{m}, next, count."""
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held > self.most:
            self.merge()

    def merge(self) -> None:
        """Equal entries become one.  Rows sort by language and key, then by the bits of the next word that make up
        parts; a clash of sort keys leaves an entry in two pieces, which meet later."""
        key, *columns, count = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        *inner, nexts = columns[2:]
        told = reduce(_grown, inner, nexts)
        order = np.lexsort((key & ~U64(0xFFFFFF) | nexts & U64(0xFFFF00) | told & U64(0xFF), columns[0]))
        head = _heads([c[order] for c in columns])
        self.parts = [[key[order[head]], *(c[order[head]] for c in columns), np.add.reduceat(count[order], head)]]
        self.held = len(head)

    def batches(self, langs: list[str], wide: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A row for each bucket of keys, and for each part of a frequent key."""
        if not self.held:
            return
        self.merge()
        (key, lang, *ps, nexts, count), self.parts, self.held = self.parts[0], [], 0
        bucket = (key >> U64(64 - self.bits)).astype(np.int32)
        part = ((nexts & U64(0xFFFFFF)) >> (U64(24) - _bits(wide, key))).astype(np.int32)  # the bits that rows are sorted by
        head = _heads([lang, bucket, part])
        offsets = pa.array(np.append(head, len(lang)).astype(np.int32))
        columns = [pa.array(langs).take(pa.array(lang[head])), pa.array(bucket[head]), pa.array(part[head])]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (*(p.view(np.int64) for p in ps), nexts.view(np.int64), count.astype(np.int32))]
        yield from pa.Table.from_arrays([*columns, *lists], names=["lang", "bucket", "part", *_lists(self.m)]).to_batches(max_chunksize=500)


def _lists(m: int) -> list[str]:
    """The columns of a row of stripes that hold a list, with an element for each entry."""
    return [*(f"p{i}s" for i in range(1, m + 1)), "nexts", "counts"]


def _bits(wide: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    """The bits that tell the parts of each key."""
    names, bits = wide
    if not len(names):
        return np.zeros(len(key), dtype=U64)
    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
    return np.where(names[at] == key, bits[at], U64(0))


def _stripes_of(m: int, shared, bits: int, most: int, sums: bool):
    """Stripes of the prefixes of ``m`` words that may be part of a frequent phrase; without
    ``sums`` only their entries, as the prefix's own count is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, wide = shared.value
        known: dict[str, int] = {}
        stripes = _Stripes(m, bits, most)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                t = _Text(part, known)
                n = len(t.hash)
                if not n:
                    continue
                phrase, fits = _grown(t.seed, t.hash), np.ones(n, dtype=bool)
                key = phrase
                good = _passes(filters[0], phrase)
                for i in range(1, m):  # the phrase that begins here, one word longer
                    fits[: n - i] &= t.same[i - 1 : n - 1]
                    fits[n - i :] = False
                    phrase = np.concatenate([_grown(phrase[: n - i], t.hash[i:]), phrase[n - i :]])
                    good = good & fits & _passes(filters[i], phrase)
                at = np.flatnonzero(good)
                follows = np.zeros(n, dtype=bool)
                follows[: max(n - m, 0)] = t.same[m - 1 : n - 1] & good[1 : n - m + 1]
                if not sums:
                    at = at[follows[at]]
                if not len(at):
                    continue
                nexts = np.where(follows[at], t.hash[np.minimum(at + m, n - 1)], U64(0))
                stripes.add([key[at], t.lang[at], *(t.hash[at + i] for i in range(m)), nexts, np.ones(len(at), dtype=np.int64)])
                if stripes.held > most // 2:
                    yield from stripes.batches(list(known), wide)
        yield from stripes.batches(list(known), wide)

    return run


def _wide(words: DataFrame, quota: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the keys (lang, next, f) that occur more than ``quota`` times, and the bits that tell
    their parts, so that no part of a key is much more.  At most one key for each ``quota`` words of the corpus."""
    rows = words.filter(F.col("f") > quota).toArrow()
    key = _grown(np.array([_seed(x) for x in rows.column("lang").to_pylist()], dtype=U64), rows.column("next").to_numpy().view(U64))
    order = np.argsort(key)
    bits = np.ceil(np.log2(np.maximum(rows.column("f").to_numpy() / quota, 1))).clip(0, 16)
    return key[order], bits[order].astype(U64)


def _adder(m: int, least: int, most: int):
    """Adds up stripes, which come sorted by bucket and part, element by element: the entries of at
    least ``least``, and what is left of each prefix as one with ``next`` 0."""
    lists = _lists(m)
    names = ["lang", *(f"p{i}" for i in range(1, m + 1)), "next", "f"]

    def added(columns: list[np.ndarray]) -> list[np.ndarray]:
        """Equal entries (run of equal rows, p1 .. , next) as one; sorted by them."""
        *ids, count = columns
        order = np.lexsort(ids[::-1])
        head = _heads([c[order] for c in ids])
        return [*(c[order[head]] for c in ids), np.add.reduceat(count[order], head)]

    def told(held: list[np.ndarray], rows: pa.Table) -> Iterator[pa.RecordBatch]:
        run, *inner, nexts, count = held
        often = (count >= least) & (nexts != 0)
        nexts = np.where(often, nexts, 0)
        run, *inner, nexts, count = added([run, *inner, nexts, count])
        of = pa.array(run)
        columns = [rows.column("lang").take(of), *(pa.array(x) for x in inner), pa.array(nexts), pa.array(count)]
        yield from pa.Table.from_arrays(columns, names=names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: pa.Table | None = None  # the keys of the runs that are held
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch.select(["lang", "bucket", "part"])])
            rows = new if rows is None else pa.concat_tables([rows, new]).combine_chunks()
            coded = [rows.column("lang").combine_chunks().dictionary_encode().indices.to_numpy(), *(rows.column(c).to_numpy() for c in ("bucket", "part"))]
            head = _heads(coded)
            number = np.zeros(len(rows), dtype=np.int64)
            number[head] = 1
            number = np.cumsum(number) - 1
            size = np.diff(batch.column(lists[0]).offsets.to_numpy())
            flat = [np.repeat(number[-batch.num_rows :], size), *(batch.column(c).flatten().to_numpy().astype(np.int64) for c in lists)]
            held = [np.concatenate(c) for c in zip(held, flat, strict=True)] if held else flat
            rows = rows.take(pa.array(head))
            if len(held[0]) > most:
                held = added(held)
                done = held[0] < len(rows) - 1  # the last key may go on
                if done.any():
                    yield from told([c[done] for c in held], rows)
                    held = [c[~done] for c in held]
                    held[0] = held[0] * 0
                    rows = rows.slice(len(rows) - 1)
        if rows is not None:
            yield from told(added(held), rows)

    return run


def merged(stripes: DataFrame, m: int, least: int) -> DataFrame:
    """Stripes added up element by element: (lang, p1 .. p{m}, next, f), with the entries below
    ``least`` as one for each prefix and part, ``next`` 0.  One shuffle, by bucket and part."""
    by = ["lang", "bucket", "part"]
    kinds = "".join(f"p{i} long, " for i in range(1, m + 1))
    return stripes.repartition(*by).sortWithinPartitions(*by).mapInArrow(_adder(m, least, HELD), f"lang string, {kinds}next long, f long")


def mined(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """The candidates that nothing subsumes (lang, w, a, l, r, score, k; ``w``: hashes of their
    words) and the words (lang, h, word, f; a row with h 0 for all that are rarer than ``least``)."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = slim.mapInArrow(_vocabulary, "lang string, h long, word string, f long").groupBy("lang", "h", "word").agg(F.sum("f").alias("f"))
    often = F.col("f") >= least
    vocabulary = cut(counted.groupBy("lang", F.when(often, F.col("h")).otherwise(0).alias("h"), F.when(often, F.col("word")).alias("word")).agg(F.sum("f").alias("f")))
    frequent = vocabulary.filter("h <> 0").select("lang", F.col("h").alias("next"), "f")
    filters, phrases, totals = [], [], []
    wide = _wide(frequent, QUOTA)
    n = vocabulary.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    bits = max(6, min(30, (n // BUCKET).bit_length()))
    for m in range(1, longest):
        filters.append(_filter(frequent, m - 1))
        shared = spark.sparkContext.broadcast((list(filters), wide))
        last = m == longest - 1  # prefixes of this size are phrases of the level before, counted there
        lists = ", ".join(f"{c} array<{'int' if c == 'counts' else 'long'}>" for c in _lists(m))
        stripes = slim.mapInArrow(_stripes_of(m, shared, bits, HELD, not last), f"lang string, bucket int, part int, {lists}")
        level = cut(merged(stripes, m, least))
        prefix = [f"p{i}" for i in range(1, m + 1)]
        frequent = level.filter("next <> 0")
        phrases.append(frequent.select("lang", F.array(*prefix, "next").alias("w"), F.col("f").alias("a")))
        if not last:
            totals.append(level.groupBy("lang", F.array(*prefix).alias("w")).agg(F.sum("f").alias("f")))
    before = phrases[-2].withColumnRenamed("a", "f") if longest > 2 else vocabulary.filter("h <> 0").select("lang", F.array("h").alias("w"), "f")
    totals.append(before)
    candidates, total = reduce(DataFrame.unionByName, phrases), cut(reduce(DataFrame.unionByName, totals).filter(F.col("f") >= least))

    # What a phrase of one word more says of the two phrases in it; longer ones are never more frequent.
    size = F.size("w")
    inner = candidates.filter(size > 2).select("lang", F.explode(F.array(F.slice("w", 1, size - 1), F.slice("w", 2, size - 1))).alias("w"), "a")
    best = inner.groupBy("lang", "w").agg(F.max("a").alias("best"))
    free = candidates.join(best, ["lang", "w"], "left").filter(F.coalesce(100 * F.col("best").cast("decimal(20,0)") < percent * F.col("a").cast("decimal(20,0)"), F.lit(True))).drop("best")

    cuts = free.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("head"), F.slice("w", F.col("k") + 1, size - F.col("k")).alias("tail"))
    cuts = cuts.join(total.select("lang", F.col("w").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(total.select("lang", F.col("w").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"cast({FACTOR} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.groupBy("lang", "w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return lowest.select("lang", "w", "a", "c.l", "c.r", "c.score", "c.k"), vocabulary


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language, by
    score, then frequency, then the phrase's bytes."""
    found, vocabulary = mined(docs, least, percent, longest)
    ahead = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    near = cut(found.withColumn("at", F.rank().over(ahead)).filter(F.col("at") <= top).drop("at"))  # ties of the last place stay
    named = near.select("lang", "w", F.posexplode("w").alias("i", "h")).join(vocabulary.select("lang", "h", "word"), ["lang", "h"])
    spelled = named.groupBy("lang", "w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    size = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = near.join(spelled, ["lang", "w"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(size, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB, by counting all phrases of up to four words.
ORACLE_SQL = f"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
runs as materialized (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
grams as (select lang, unnest([w[i:i], case when len(w) > i then w[i:i + 1] end, case when len(w) > i + 1 then w[i:i + 2] end, case when len(w) > i + 2 then w[i:i + 3] end]) as g
  from (select lang, w, unnest(range(1, len(w) + 1)) as i from runs)),
f as materialized (select lang, g, count(*) as f from grams where g is not null group by all),
n as (select lang, sum(f)::bigint as n from f where len(g) = 1 group by lang),
c as materialized (select lang, g, f as a from f where len(g) > 1 and f >= {LEAST}),
inner_of as (select lang, a, unnest([g[1:len(g) - 1], g[2:], case when len(g) = 4 then g[2:3] end, case when len(g) = 4 then g[1:2] end, case when len(g) = 4 then g[3:4] end]) as g from c where len(g) > 2),
best as (select lang, g, max(a) as best from inner_of where g is not null group by all),
free as (select c.* from c left join best b on b.lang = c.lang and b.g = c.g where b.best is null or 100::hugeint * b.best < {PERCENT}::hugeint * c.a),
cuts as (select lang, g, a, unnest(range(1, len(g))) as k from free),
scored as (select x.lang, x.g, x.a, k, p.f as l, q.f as r, ({FACTOR}::hugeint * x.a // (p.f + q.f))::bigint as score from cuts x join f p on p.lang = x.lang and p.g = x.g[1:k] join f q on q.lang = x.lang and q.g = x.g[k + 1:]),
low as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
named as (select *, array_to_string(g, ' ') as phrase from low)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from named join n using (lang) qualify rank <= {TOP}
"""
