"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The document frequency of every word and every pair of adjacent words of the
   test items is counted over all documents.
2. An alignment of ``M`` matches in ``k`` unbroken runs scores at most
   ``2 M - (k - 1)``, and the text then holds ``M`` words and ``M - k`` pairs of the
   item.  So a leak of ``m`` words holds at least ``2 threshold m - 1`` of the item's
   ``2 m - 1`` words and pairs, within ``(3 - 2 threshold) m`` words.
3. Each item skips its most frequent grams, up to half of that number; all others
   are its seeds, also those that no document holds.  Windows of each document that
   hold too few seeds of an item, whatever is skipped, can't be leaks of it.
4. The windows that remain are aligned with the item, word against word.  A pair
   whose score reaches ``threshold`` of the item's perfect score is a leak.

Thus every pair at or above the threshold is found, however it was edited.

Test items travel to the tasks in blocks of bounded size, each block a pass over
the documents, so the test set may be of any size.

Words are runs of letters and digits of the lower-cased text.  Defined results: a null
or empty text, in documents or items, matches nothing; an item of one word has it as
its only seed; repeated rows are reported each; empty tables give no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.textops import IS_ALNUM, Words, shingle_hashes, slices, words

THRESHOLD = 0.45
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of test items that travel to the tasks at once.
BLOCK_WORDS = 2_000_000
#: Counters of (window, item) that a task holds at once.
CELLS = 1 << 23
PAIRS = "doc_id long, item_id long, score double, start_word long, end_word long"


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score of two word sequences, and the end of the aligned part in ``text``."""
    ramp = -GAP * np.arange(len(text) + 1, dtype=np.int64)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + ramp) - ramp  # gaps in the item
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def _items(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Blocks of (item id, word hashes)."""
    block: list[tuple[int, np.ndarray]] = []
    size = 0
    for row in benchmark.select("item_id", "text").filter("text is not null and item_id is not null").toLocalIterator():
        w = words(pa.array([row.text.lower()]), table=IS_ALNUM).hash
        if len(w):
            block.append((row.item_id, w))
            size += len(w)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _hits(known: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Index in ``known`` (sorted) of each gram, -1 where absent."""
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return np.where(known[at] == grams, at, -1)


def _grams(w: np.ndarray) -> np.ndarray:
    """Hashes of the words and of the pairs of adjacent words of one item."""
    return np.concatenate([shingle_hashes(w, 1), shingle_hashes(w, 2)[: len(w) - 1]])


def _places(w: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word number and index in ``known`` of each known word and pair of the rows of ``w``."""
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    one = _hits(known, shingle_hashes(w.hash, 1))
    first = np.flatnonzero((one[:-1] >= 0) & (one[1:] >= 0) & (row[:-1] == row[1:]))
    two = _hits(known, shingle_hashes(w.hash, 2)[first]) if len(first) else first
    at = np.concatenate([np.flatnonzero(one >= 0), first[two >= 0]])
    return row[at], at - w.first[row[at]], np.concatenate([one[one >= 0], two[two >= 0]])


def _document_frequency(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                row, _, gram = _places(words(part.column("text"), table=IS_ALNUM), known)
                pairs = np.unique(row * len(known) + gram)
                total += np.bincount(pairs % len(known), minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "df"])

    counted = docs.select("text").mapInArrow(count, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    df = np.zeros(len(known), dtype=np.int64)
    for row in counted.toLocalIterator():  # one row at most for each gram of the block
        df[row.gram] = row.df
    return df


class _Class(NamedTuple):
    """Items of similar length: windows of two bins of ``size`` words hold any leak of them."""

    size: int
    #: Index in the block, and the number of seeds that a window needs, of each item.
    item: np.ndarray
    need: np.ndarray
    #: Gram g is a seed of the items owner[first[g] : first[g + 1]], so many times in each.
    first: np.ndarray
    owner: np.ndarray
    times: np.ndarray


def _classes(block: list[tuple[int, np.ndarray]], known: np.ndarray, df: np.ndarray, threshold: float) -> list[_Class]:
    by_length: dict[int, list[int]] = {}
    for i, (_, w) in enumerate(block):
        by_length.setdefault((len(w).bit_length() + 1) // 2, []).append(i)
    out = []
    for _, members in sorted(by_length.items()):
        need, rows = [], []
        for k, i in enumerate(members):
            least = max(1, math.ceil(MATCH * threshold * len(block[i][1]) - 1e-9) - 1)
            gram, times = np.unique(np.searchsorted(known, _grams(block[i][1])), return_counts=True)
            order = np.lexsort((gram, -df[gram]))
            skipped = np.cumsum(times[order]) <= least // 2
            need.append(least - int(times[order][skipped].sum()))
            kept = order[~skipped]
            rows.append(np.stack([gram[kept], np.full(len(kept), k), times[kept]]))
        gram, owner, times = np.concatenate(rows, axis=1)
        order = np.lexsort((owner, gram))
        longest = max(len(block[i][1]) for i in members)
        size = max(1, math.ceil((1 + MATCH - MATCH * threshold) * longest))
        out.append(_Class(size, np.array(members), np.array(need), np.searchsorted(gram[order], np.arange(len(known) + 1)), owner[order], times[order]))
    return out


def _candidates(c: _Class, lengths: np.ndarray, row: np.ndarray, word: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, item of the class, bin): windows, from that bin to the next, with the seeds that the item needs."""
    last = np.maximum((lengths - 1) // c.size - 1, 0)  # the last window of each row
    base = np.concatenate([[0], np.cumsum(last + 1)])
    seed = c.first[gram + 1] > c.first[gram]
    row, gram, at = row[seed], gram[seed], word[seed] // c.size
    here, before = at <= last[row], at >= 1
    window = np.concatenate([(base[row] + at)[here], (base[row] + at - 1)[before]])
    grams = len(c.first) - 1
    held = np.unique(window * grams + np.concatenate([gram[here], gram[before]]))
    window, gram = held // grams, held % grams
    step, items = max(1, CELLS // len(c.item)), len(c.item)
    for lo in range(0, int(base[-1]), step):
        a, b = np.searchsorted(window, [lo, lo + step])
        if a == b:
            continue
        ends = np.cumsum(c.first[gram[a:b] + 1] - c.first[gram[a:b]])
        total = np.zeros(min(step, int(base[-1]) - lo) * items, dtype=np.int64)
        x = 0
        while x < b - a:
            y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + CELLS, "right")))
            some = gram[a + x : a + y]
            many = c.first[some + 1] - c.first[some]
            place = np.arange(many.sum()) + np.repeat(c.first[some] - np.cumsum(many) + many, many)
            cell = np.repeat(window[a + x : a + y] - lo, many) * items + c.owner[place]
            total += np.bincount(cell, c.times[place], len(total)).astype(np.int64)
            x = y
        found = np.flatnonzero((total.reshape(-1, items) >= c.need).ravel())
        found_window = found // items + lo
        found_row = np.searchsorted(base, found_window, "right") - 1
        yield from zip(found_row.tolist(), (found % items).tolist(), (found_window - base[found_row]).tolist(), strict=True)


def _finder(block: list[tuple[int, np.ndarray]], known: np.ndarray, classes: list[_Class], threshold: float):
    """Align documents with the items of which a window holds enough seeds."""

    def regions(bins: list[int], size: int) -> Iterator[tuple[int, int]]:
        lo = hi = bins[0]
        for x in bins[1:]:
            if x > hi + 1:
                yield lo * size, (hi + 2) * size
                lo = x
            hi = x
        yield lo * size, (hi + 2) * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part in slices(batch, "text"):
                w = words(part.column("text"), table=IS_ALNUM)
                ids = part.column("doc_id")
                places = _places(w, known)
                for c in classes:
                    of: dict[tuple[int, int], list[int]] = {}
                    for row, item, at in _candidates(c, np.diff(w.first), *places):
                        of.setdefault((row, item), []).append(at)
                    for (row, item), bins in sorted(of.items()):
                        item_id, target = block[c.item[item]]
                        own = w.hash[w.first[row] : w.first[row + 1]]
                        found = [(score, lo, lo + end) for lo, hi in regions(bins, c.size) for score, end in [align(target, own[lo:hi])]]
                        score, lo, end = max(found)
                        share = score / (MATCH * len(target))
                        if share >= threshold:
                            out.append((ids[row].as_py(), item_id, share, max(lo, end - len(target)), end))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "score", "start_word", "end_word"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, score, start_word, end_word) of leaked items."""
    spark = docs.sparkSession
    slim = docs.filter("text is not null").select("doc_id", F.lower("text").alias("text"))
    out = None
    for block in _items(benchmark):
        known = np.unique(np.concatenate([_grams(w) for _, w in block]))
        classes = _classes(block, known, _document_frequency(slim, known), threshold)
        found = slim.mapInArrow(_finder(block, known, classes, threshold), PAIRS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], PAIRS)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The result that query op3 returns: a row for each leaked (document, item)."""
    return leaks(docs, benchmark)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leaked item.  A row whose id is
    null cannot be named by a pair and stays."""
    found = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
