"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (n = 1..3,
words padded with a boundary) over all training documents.  A document's own
list is compared to each profile by the out-of-place distance: the sum of rank
differences, with the profile's length for an n-gram that the profile lacks.

Defined results: ``und`` with score 0 for a null text, a text without letters,
or where nothing could be learned; ties go to the language first by code point;
repeated rows get equal results; a null id is neither held out nor learned from;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.session import cut
from engram.llm.textops import slices

PROFILE = 300
#: Languages whose profiles travel to the tasks at once; more are done in blocks.
BLOCK = 256
UNDETERMINED = "und"
_PIECE = 1 << 20
_BIGRAM, _UNIGRAM = np.uint64(0x1FFFFE) << np.uint64(42), np.uint64(0x1FFFFF) << np.uint64(42)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def letter_stream(text: str) -> np.ndarray:
    """Lower-case letters as code points, with one 0 before, between and after words; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.zeros(0, dtype=np.uint64)
    padded = np.zeros(len(codes) + 2, dtype=np.uint64)
    padded[1:-1] = np.where(letter, codes, 0)
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    return padded[keep]


def ngrams(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a stream, in order, and their counts."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(stream), _PIECE):
        s = stream[max(0, at - 2) : at + _PIECE]
        skip = min(at, 2)  # n-grams that begin and end in the piece before
        one = s[skip:][s[skip:] != 0]
        a, b = s[max(0, skip - 1) : -1], s[max(0, skip - 1) + 1 :]
        two = ((a << np.uint64(21)) | b)[(a != 0) | (b != 0)]
        three = ((s[:-2] << np.uint64(42)) | (s[1:-1] << np.uint64(21)) | s[2:])[s[1:-1] != 0]
        found.append(np.unique(np.concatenate([one | _UNIGRAM, two | _BIGRAM, three]), return_counts=True))
    return found[0] if len(found) == 1 else merged(found)


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The ``k`` most frequent codes, most frequent first; ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:k]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list] = {}
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            by: dict[str, list[str]] = {}
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                stream = letter_stream(" ".join(texts))
                if len(stream):
                    found.setdefault(lang, []).append(ngrams(stream))
                    if len(found[lang]) > 32:
                        found[lang] = [merged(found[lang])]
    for lang, parts in found.items():
        codes, counts = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) with rank from 0, over all rows with a text and a language."""
    rows = docs.filter("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < profile).select("lang", "gram", "rank")


def distances(grams: np.ndarray, known: np.ndarray, ranks: np.ndarray, profile: int) -> np.ndarray:
    """Out-of-place distance of a ranked list to each column of ``ranks`` (rows: ``known``; -1: absent)."""
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    hit = known[at] == grams
    r = ranks[at[hit]]
    apart = np.abs(r - np.flatnonzero(hit)[:, None])
    apart[r < 0] = profile
    return apart.sum(axis=0) + profile * int((~hit).sum())


def _scorer(langs: list[str], known: np.ndarray, ranks: np.ndarray, profile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = [], []
            for text, old, best in zip(batch.column("text").to_pylist(), batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist(), strict=True):
                stream = letter_stream(text) if text else ()
                if len(stream):
                    grams = top(*ngrams(stream), profile)
                    apart = distances(grams, known, ranks, profile)
                    score = 1.0 - float(apart.min()) / (profile * len(grams))
                    if old == UNDETERMINED or score > best:
                        old, best = langs[int(apart.argmin())], max(0.0, score)
                preds.append(old)
                scores.append(best)
            names = batch.schema.names
            columns = {n: batch.column(n) for n in names} | {"lang_pred": pa.array(preds, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def identify(docs: DataFrame, profiles: DataFrame, profile: int = PROFILE, block: int = BLOCK) -> DataFrame:
    """``docs`` (with ``text``) plus ``lang_pred`` and ``score``.

    At most ``block`` languages of ``profile`` rows each are sent to the tasks
    at once; with more languages the documents pass through one map for each
    block and keep the best so far."""
    langs = [r.lang for r in profiles.select("lang").distinct().orderBy("lang").toLocalIterator()]
    out = docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    schema = out.schema
    for at in range(0, len(langs), block):
        part = langs[at : at + block]
        rows = profiles.filter(F.col("lang").isin(part)).collect()
        known = np.unique(np.array([r.gram for r in rows], dtype=np.int64).view(np.uint64))
        ranks = np.full((len(known), len(part)), -1, dtype=np.int32)
        column = {lang: i for i, lang in enumerate(part)}
        for r in rows:
            ranks[np.searchsorted(known, np.int64(r.gram).view(np.uint64)), column[r.lang]] = r.rank
        out = out.mapInArrow(_scorer(part, known, ranks, profile), schema)
    return out


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """The digest that query op5 returns."""
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("text", "lang")
    profiles = cut(learn_profiles(train))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, profiles).drop("text")
