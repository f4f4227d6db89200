"""Exact substring dedup with a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else in the corpus.  Not every suffix is sorted:

1. Anchors.  Every string of ``LENGTH`` bytes (a window) contains one anchor,
   its least ``GRAM``-byte gram by hash, so equal windows have equal anchors at
   equal offsets.  Consecutive windows with one anchor form a unit.
2. Units whose anchor gram occurs once hold no repeated window.  Units with
   equal bytes (by a 128-bit digest) are repeated as a whole.  Both are counted
   without any text.
3. What is left - different units around the same gram - is decided by sorting
   suffixes: the units' texts from the anchor on (and, read backwards, before
   it) are merge-sorted.  Two suffixes are compared through their common
   extension, found by binary search over prefix polynomial hashes, so a
   comparison takes logarithmic time; the bytes verify every extension, and a
   collision falls back to the bytes.  Then neighbours are joined from the
   longest common extension to the right downwards, while sorted lists give
   each suffix its best extension to the left: all windows that a suffix shares
   with any other are found in O(m log^2 m), without looking at pairs.
4. Grams with more than ``HOT`` different units would make one task long; their
   windows are counted one by one, by 128-bit digests, in a plain grouped
   count.

Polynomial hashes decide nothing alone: texts that collide under them can be
written down, since the base is known.

Documents are matched by (doc_id, hash of the text).  Defined results: a null or
empty text has no bytes; texts shorter than ``LENGTH`` lose nothing; a row that
repeats id and text is another place where its strings start; null ids and ties
need no special care; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.session import cut
from engram.llm.textops import U64, prefix_hashes, slices, span_hashes, utf8

LENGTH, GRAM, HOT = 400, 64, 20_000
#: Windows of a document that are looked at together.
BLOCK = 1 << 20
_LOW = U64((1 << 24) - 1)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A digest for the bytes of each span [start, end): rows of two 64-bit numbers."""
    view = memoryview(data)
    found = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(found, dtype=U64).reshape(-1, 2)


def _binary(found: np.ndarray) -> pa.Array:
    """``digests`` as an Arrow column."""
    return pa.Array.from_buffers(pa.binary(16), len(found), [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())


def document_units(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Units of one document, block by block: (gram hash, content digest, first
    window, last window, anchor), positions in the document."""
    width = length - gram + 1
    for base in range(0, len(data) - length + 1, BLOCK):
        part = data[base : base + BLOCK + length - 1]
        prefix = prefix_hashes(part)
        at = np.arange(len(part) - gram + 1)
        grams = span_hashes(prefix, at, at + gram)
        least, span = (grams & ~_LOW) | at.astype(U64), 1  # value first, then the leftmost
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = (least & _LOW).astype(np.int64)
        edge = np.flatnonzero(np.diff(anchor)) + 1
        lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(anchor)]]) - 1
        anchor = anchor[lo]
        content = digests(part, lo, hi + length)  # the bytes determine where the anchor is
        yield grams[anchor], content, lo + base, hi + base, anchor + base


def _pack(lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (lo << 24) | ((hi - lo) << 12) | (anchor - lo)


def _unpack(span: int) -> tuple[int, int, int]:
    lo = span >> 24
    return lo, lo + ((span >> 12) & 4095), lo + (span & 4095)


def _units(together: bool):
    """Rows (gram, content, n, doc, hash, span) of a batch; ``together``: one row for equal units of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                data, offsets = utf8(part.column("text"))
                found, row = [], []
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    for g, c, lo, hi, at in document_units(data[a:b]) if b - a >= LENGTH else ():
                        found.append((g, c, _pack(lo, hi, at)))
                        row.append(np.full(len(g), i))
                if not found:
                    continue
                gram, content, span = (np.concatenate(x) for x in zip(*found, strict=True))
                row, n = np.concatenate(row), np.ones(len(gram), dtype=np.int64)
                if together:
                    order = np.lexsort((content[:, 1], content[:, 0], gram))
                    g, c = gram[order], content[order]
                    heads = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]).any(axis=1)]))
                    n = np.diff(np.append(heads, len(g)))
                    pick = order[heads]
                    gram, content, span, row = gram[pick], content[pick], span[pick], row[pick]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), _binary(content), pa.array(n), part.column("d").take(take), part.column("t").take(take), pa.array(span)], names=["gram", "content", "n", "d", "t", "span"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the units that ``batches`` name."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        spans = [_unpack(s) for s in batch.column("span").to_pylist()]
        texts = [data[offsets[i] + lo : offsets[i] + hi + LENGTH].tobytes() for i, (lo, hi, _) in enumerate(spans)]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.binary())], names=[*names, "bytes"])


class Suffix:
    """A text and the polynomial hashes of all its prefixes."""

    __slots__ = ("hashes", "text")

    def __init__(self, text: bytes):
        self.text = text
        self.hashes = array("Q", prefix_hashes(np.frombuffer(text, dtype=np.uint8)).tobytes())  # eight bytes a prefix


def extension(a: Suffix, b: Suffix) -> int:
    """Length of the common beginning: binary search over the prefix hashes, verified on the bytes."""
    x, y = a.hashes, b.hashes
    lo, hi = 0, min(len(x), len(y)) - 1
    if x[hi] == y[hi]:
        lo = hi
    while lo < hi:
        mid = (lo + hi + 1) >> 1
        if x[mid] == y[mid]:
            lo = mid
        else:
            hi = mid - 1
    if a.text[:lo] == b.text[:lo]:
        return lo
    return next(i for i in range(lo) if a.text[i] != b.text[i])


def compare(a: Suffix, b: Suffix) -> int:
    n = extension(a, b)
    if n == len(a.text) or n == len(b.text):
        return len(a.text) - len(b.text)
    return a.text[n] - b.text[n]


def suffix_order(suffixes: list[Suffix]) -> list[int]:
    """Indices in lexicographic order; the sort is a merge sort."""
    key = cmp_to_key(compare)
    return sorted(range(len(suffixes)), key=lambda i: key(suffixes[i]))


def shared_windows(texts: list[bytes], anchors: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each text the ranges (first, last) of windows, as start offsets, that
    another text has at the same distance from its anchor."""
    m = len(texts)
    right = [Suffix(t[a:]) for t, a in zip(texts, anchors, strict=True)]
    left = [Suffix(t[:a][::-1]) for t, a in zip(texts, anchors, strict=True)]
    found: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    order = suffix_order(right)
    rank = [0] * m
    for r, i in enumerate(suffix_order(left)):
        rank[i] = r
    joins = sorted(((extension(right[i], right[j]), k) for k, (i, j) in enumerate(zip(order[:-1], order[1:], strict=True))), key=lambda x: (-x[0], x[1]))
    of = list(range(m))  # position in ``order`` -> set
    members: list[list[tuple[int, int]]] = [[(rank[i], i)] for i in order]  # sorted by rank of the left side

    def root(k: int) -> int:
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    def meet(i: int, j: int, ahead: int) -> None:
        before = extension(left[i], left[j])
        if before + ahead >= length:
            for u in (i, j):
                a = anchors[u]
                first, last = max(0, a - before), min(len(texts[u]) - length, a - (length - ahead))
                if first <= last:
                    found[u].append((first, last))

    for ahead, k in joins:
        a, b = root(k), root(k + 1)
        small, big = (a, b) if len(members[a]) < len(members[b]) else (b, a)
        into = members[big]
        for item in members[small]:
            at = bisect_left(into, item)
            if at:
                meet(item[1], into[at - 1][1], ahead)
            if at < len(into):
                meet(item[1], into[at][1], ahead)
            into.insert(at, item)
        members[small] = []
        of[small] = big
    return found


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans (d, t, start, end) of the units that occur once; rows come sorted by gram."""
    group: list[tuple] = []
    gram = None
    out: list[tuple] = []

    def close() -> None:
        if len(group) < 2:
            return
        spans = [_unpack(g[3]) for g in group]
        for g, (lo, _, _), ranges in zip(group, spans, shared_windows([g[4] for g in group], [a - lo for lo, _, a in spans]), strict=True):
            if g[0] == 1:
                out.extend((g[1], g[2], lo + first, lo + last + LENGTH) for first, last in ranges)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("gram", "n", "d", "t", "span", "bytes")]
        for name, *unit in zip(*columns, strict=True):
            if name != gram:
                close()
                group, gram = [], name
            group.append(tuple(unit))
        if len(out) > 50_000:
            yield _spans(out)
            out.clear()
    close()
    yield _spans(out)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["d", "t", "start", "end"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of each unit, with its digest."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column("bytes")[i].as_py(), dtype=np.uint8)
            lo, hi, _ = _unpack(batch.column("span")[i].as_py())
            at = np.arange(hi - lo + 1)
            take = pa.array(np.full(len(at), i))
            yield pa.RecordBatch.from_arrays([_binary(digests(data, at, at + LENGTH)), *[batch.column(c).take(take) for c in ("n", "d", "t")], pa.array(lo + at)], names=["window", "n", "d", "t", "start"])


def removed_spans(docs: DataFrame) -> DataFrame:
    """(d, t, start, end) for rows (d: id, t: hash of the text, text): spans in
    bytes that a repeated string covers; spans of a document may overlap."""
    unit = "gram long, content binary, n long, d long, t long, span long"
    # Grouped by gram and content, so that a gram of very many units is many groups.
    distinct = docs.mapInArrow(_units(True), unit).groupBy("gram", "content").agg(F.sum("n").alias("n"), F.min(F.struct("d", "t", "span")).alias("ref"))
    by_gram = distinct.groupBy("gram").agg(F.count("*").alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("single"))
    repeated = cut(distinct.join(by_gram, "gram").filter("n > 1 or (kinds > 1 and single > 0)").select("gram", "content", "n", "ref.*", F.when(F.col("single") > 0, F.col("kinds")).otherwise(0).alias("kinds")))

    # Equal units: each of their places.
    places = docs.mapInArrow(_units(False), unit).select("gram", "content", "d", "t", "span")
    whole = places.join(repeated.filter("n > 1").select("gram", "content"), ["gram", "content"]).select("d", "t", F.shiftright("span", 24).alias("start"), (F.shiftright("span", 24) + F.shiftright("span", 12).bitwiseAND(F.lit(4095)) + LENGTH).alias("end"))

    # Different units around one gram: sort the suffixes.
    open_units = repeated.filter("kinds > 1").select("gram", "n", "d", "t", "span", "kinds")
    same = open_units["d"].eqNullSafe(docs["d"]) & (open_units["t"] == docs["t"])
    texts = docs.join(open_units, same).select(*[open_units[c] for c in open_units.columns], "text").mapInArrow(_cut_out, "gram long, n long, d long, t long, span long, kinds long, bytes binary")
    spans = "d long, t long, start long, end long"
    sorted_spans = texts.filter(F.col("kinds") <= HOT).drop("kinds").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted_groups, spans)
    found = whole.unionByName(sorted_spans)
    if repeated.filter(F.col("kinds") > HOT).isEmpty():
        return found
    windows = cut(texts.filter(F.col("kinds") > HOT).mapInArrow(_windows, "window binary, n long, d long, t long, start long"))
    twice = windows.groupBy("window").agg(F.sum("n").alias("places")).filter("places > 1").drop("places")
    hot = windows.filter("n = 1").join(twice, "window").select("d", "t", "start", (F.col("start") + LENGTH).alias("end"))
    return found.unionByName(hot)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by ``spans``."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_runs(docs: DataFrame, run, schema: str) -> DataFrame:
    """Map ``run`` over (doc_id, text, spans) of every document."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    spans = removed_spans(keyed).groupBy("d", "t").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = keyed.join(spans, keyed["d"].eqNullSafe(spans["d"]) & (keyed["t"] == spans["t"]), "left").select(keyed["d"].alias("doc_id"), "text", "spans")
    return joined.mapInArrow(run, schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[tuple[bytes, list[tuple[int, int]]]]]]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = utf8(part.column("text"))
            spans = [[(s["start"], s["end"]) for s in x or ()] for x in part.column("spans").to_pylist()]
            yield part.column("doc_id"), [(data[a:b].tobytes(), merge(s)) for a, b, s in zip(offsets[:-1], offsets[1:], spans, strict=True)]


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for r in runs for x in r], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """The digest that query op1 returns: one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _each(batches):
            removed = [sum(b - a for a, b in runs) for _, runs in rows]
            columns = [[len(t) for t, _ in rows], removed, [len(r) for _, r in rows]]
            hashes = [hashlib.sha256(_kept(t, r)).hexdigest() for t, r in rows]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in columns], pa.array(hashes, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_runs(docs, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without the repeated bytes; a character cut in the middle goes as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _each(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([_kept(t, r).decode("utf-8", "ignore") for t, r in rows], pa.string())], names=["doc_id", "text"])

    return _with_runs(docs, run, "doc_id long, text string")
