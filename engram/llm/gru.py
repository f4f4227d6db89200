"""LM scoring with a gated recurrent language model, in numpy inside tasks.

Words are counted over all training texts; the most frequent become the
model's vocabulary, everything else its unknown word.  The network is one GRU
layer with a class-factored softmax: classes of ``CLASS`` words by frequency,
P(word) = P(class) P(word | class).  Training is truncated backpropagation over
windows of ``WINDOW`` tokens with the state carried from window to window; long
texts train as several such stretches; tasks train replicas on their own documents, and replicas are averaged by tokens.  The
rounds together pass over every training text once, after a first replica on a
few texts that they all start from.
Scoring carries the state over the whole document, so a text of any length gets
its complete log-likelihood.

P(unknown word w) = P(unknown) (c(w) + 1) / Z, with Z over the training words
outside the vocabulary and one unseen word, so texts keep a proper probability.

Tokens are words (maximal runs of bytes other than ASCII white space, A-Z
lower-cased), identified by 64-bit hashes, then one end.  Defined results: a
null or empty text is its end alone; a null id is a training row; repeated rows
count and score each, and which round learns from a text follows from its id and
text, so equal ids do no harm; without training rows counts are 0 and the model is the
untrained network; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.session import cut
from engram.llm.textops import slices, words

CLASS, CLASSES = 64, 17
#: The unknown word is a class of its own; the end and the words fill the other classes.
UNKNOWN, END = 0, CLASS
VOCABULARY = CLASS * (CLASSES - 1)
EMBEDDING, HIDDEN, WINDOW = 24, 24, 24
LANES, SCORE_LANES = 256, 1024
#: Tokens that a lane trains on at most; state runs through all its windows.
SEGMENT = 1008
#: Frequent words whose counts travel to the tasks; the counts of all other words are joined.
FREQUENT = 1 << 18
#: Texts of the first, single replica; then rounds of all tasks, each over its part of all training texts.
FIRST_TEXTS, ROUNDS = 2_000, 2
#: Groups of replicas that are added up first.
GROUPS = 32
RATE = 0.008
_LN10 = float(np.log(10))

Params = dict[str, np.ndarray]
SHAPES = {
    "e": (CLASSES * CLASS, EMBEDDING), "x": (EMBEDDING, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
    "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "w": (CLASSES, HIDDEN, CLASS), "wb": (CLASSES, CLASS),
}


def start(n_words: int, seed: int = 11) -> Params:
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.1 if len(s) > 1 else 0.0)).astype(np.float32) for k, s in SHAPES.items()}
    used = CLASS + n_words  # after the unknown word's own class
    p["wb"] = np.where(np.arange(CLASSES * CLASS).reshape(CLASSES, CLASS) < used, 0, -1e9).astype(np.float32)
    p["cb"] = np.where(np.arange(CLASSES) * CLASS < used, 0, -1e9).astype(np.float32)
    return p


def pack(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpack(flat: np.ndarray) -> Params:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def run_window(p: Params, ids: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps x HIDDEN x lanes) after each step of ``ids`` (steps x lanes) from ``h``
    (HIDDEN x lanes); ``keep`` gathers the gates and products that the way back needs.

    Lanes are the last axis everywhere, so that each gate is one contiguous block."""
    n = 2 * HIDDEN
    # Every word's input to the gates: a product for the whole vocabulary, then a look-up.
    x = np.ascontiguousarray((p["e"] @ p["x"] + p["b"])[ids].transpose(0, 2, 1))
    u = np.ascontiguousarray(p["u"].T)
    out = np.empty((len(ids), *h.shape), dtype=x.dtype)
    products = np.empty((len(ids), len(u), h.shape[1]), dtype=x.dtype) if keep is not None else None
    for t in range(len(ids)):
        a = np.matmul(u, h, out=products[t]) if keep is not None else u @ h
        gates, c, new = x[t, :n], x[t, n:], out[t]
        gates += a[:n]
        np.negative(gates, out=gates)
        np.minimum(gates, 60, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        c += gates[HIDDEN:] * a[n:]
        np.tanh(c, out=c)
        np.subtract(h, c, out=new)
        new *= gates[:HIDDEN]
        new += c
        h = new
    if keep is not None:
        keep += [x[:, :HIDDEN], x[:, HIDDEN:n], x[:, n:], products[:, n:]]
    return out


def _away(x: np.ndarray, at: np.ndarray, many: int) -> tuple[float, np.ndarray]:
    """Loss of the softmax over the first axis at one row of each column, and its gradient
    divided by ``many``; ``x`` is used up."""
    each = np.arange(len(at))
    x -= x.max(axis=0)
    found = x[at, each]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    x *= 1 / (total * many)
    x[at, each] -= 1 / many
    return float(np.log(total).sum() - found.sum()), x


def by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the targets by class, and (class, from, to) in that order of
    the classes with more than one word."""
    of = (target // CLASS).astype(np.uint8)
    edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=CLASSES))])
    return np.argsort(of, kind="stable"), [(c, int(edges[c]), int(edges[c + 1])) for c in range(1, CLASSES) if edges[c + 1] > edges[c]]


def _of_target(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax over the first axis at one row of each column; ``x`` is used up."""
    x -= x.max(axis=0)
    found = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    return found - np.log(x.sum(axis=0))


def log_probability(p: Params, state: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after each state (HIDDEN x targets)."""
    order, segments = by_class(target)
    state, target = np.take(state, order, axis=1), target[order]
    found = _of_target(p["c"].T @ state + p["cb"][:, None], target // CLASS)
    for c, a, b in segments:
        found[a:b] += _of_target(p["w"][c].T @ state[:, a:b] + p["wb"][c][:, None], target[a:b] % CLASS)
    out = np.empty_like(found)
    out[order] = found
    return out


def gradients(p: Params, ids: np.ndarray, target: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[Params, np.ndarray, float]:
    """Gradients of a window's mean loss, the last state, the loss."""
    keep: list = []
    states = run_window(p, ids, h, keep)
    steps, lanes = ids.shape
    g: Params = {"w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"]), "e": np.zeros_like(p["e"])}

    # The softmax, over the targets in the order of their classes.
    rows = np.flatnonzero(mask.ravel())
    order, segments = by_class(target.ravel()[rows])
    rows = rows[order]
    y = target.ravel()[rows]
    s = np.take(states.transpose(1, 0, 2).reshape(HIDDEN, -1), rows, axis=1)
    loss, off = _away(p["c"].T @ s + p["cb"][:, None], y // CLASS, len(y))
    g["c"], g["cb"] = s @ off.T, off.sum(axis=1)
    back = p["c"] @ off
    for c, a, b in segments:
        more, off = _away(p["w"][c].T @ s[:, a:b] + p["wb"][c][:, None], y[a:b] % CLASS, len(y))
        loss += more
        g["w"][c], g["wb"][c] = s[:, a:b] @ off.T, off.sum(axis=1)
        back[:, a:b] += p["w"][c] @ off

    # Back through the window.
    place = np.full(steps * lanes, len(rows))
    place[rows] = np.arange(len(rows))
    to_state = np.take(np.concatenate([back, np.zeros((HIDDEN, 1), dtype=back.dtype)], axis=1), place, axis=1)  # 0 where nothing is predicted
    to_state = np.ascontiguousarray(to_state.reshape(HIDDEN, steps, lanes).transpose(1, 0, 2))
    z, r, c, a = keep
    before = np.concatenate([h[None], states[:-1]])
    of_c = (1 - z) * (1 - c * c)
    of_z = (before - c) * z * (1 - z)
    of_r = a * r * (1 - r)
    to_x = np.empty((steps, 3 * HIDDEN, lanes), dtype=states.dtype)
    to_a = np.empty_like(to_x)
    later = np.zeros_like(h)
    n = 2 * HIDDEN
    for t in range(steps - 1, -1, -1):
        later += to_state[t]
        x, u = to_x[t], to_a[t]
        np.multiply(later, of_z[t], out=x[:HIDDEN])
        np.multiply(later, of_c[t], out=x[n:])
        np.multiply(x[n:], of_r[t], out=x[HIDDEN:n])
        u[:n] = x[:n]
        np.multiply(x[n:], r[t], out=u[n:])
        later *= z[t]
        later += p["u"] @ u
    g["u"] = np.matmul(before, to_a.transpose(0, 2, 1)).sum(axis=0)
    to_x = to_x.transpose(1, 0, 2).reshape(3 * HIDDEN, -1)
    g["b"] = to_x.sum(axis=1)
    flat = ids.ravel()
    order = np.argsort(flat, kind="stable")
    heads = np.flatnonzero(np.diff(flat[order], prepend=-1))
    seen = flat[order[heads]]
    to_e = np.add.reduceat(np.take(to_x.T @ p["x"].T, order, axis=0), heads, axis=0)
    g["x"] = np.take(p["e"], flat, axis=0).T @ to_x.T
    g["e"][seen] = to_e
    return {k: g[k] for k in SHAPES}, states[-1], float(loss)


def lane_windows(tokens: np.ndarray, first: np.ndarray, lanes: int, places: int = 0) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Documents side by side, longest first: (rows, windows), each window with
    its inputs, targets and mask (steps x lanes still running).  Windows are of WINDOW
    steps, or longer ones where fewer lanes than would fill ``places`` still run."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    before = np.concatenate([[END], tokens[:-1]])  # a text follows the end of another
    for at in range(0, len(order), lanes):
        rows = order[at : at + lanes]

        def windows(rows: np.ndarray = rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            begin, size = first[rows], length[rows]
            s = 0
            while s < int(size[0]):
                alive = int(np.searchsorted(-size, -s, side="left"))
                step = np.arange(s, min(s + max(WINDOW, places // alive), int(size[0])))[:, None]
                at = begin[:alive] + np.minimum(step, size[:alive] - 1)
                yield before[at], tokens[at], step < size[:alive]
                s += len(step)

        yield rows, windows()


def segments_of(first: np.ndarray, most: int) -> np.ndarray:
    """Edges of documents and, in long ones, of segments of ``most`` tokens."""
    many = -(-np.diff(first) // most)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.append(np.repeat(first[:-1], many) + nth * most, first[-1])


def train_replica(p: Params, tokens: np.ndarray, first: np.ndarray, adam: dict) -> None:
    """One pass of truncated backpropagation over the documents, in place.  A long
    document is several lanes, so that no window runs for a few long ones alone."""
    for _, windows in lane_windows(tokens, segments_of(first, SEGMENT), LANES):
        h = np.zeros((HIDDEN, LANES), dtype=np.float32)
        for source, target, mask in windows:
            g, h, _ = gradients(p, source, target, mask, h[:, : source.shape[1]])
            adam["t"] = t = adam.get("t", 0) + 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            for k, v in g.items():
                m, s = adam.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
                v *= scale
                m *= np.float32(0.9)
                m += np.float32(0.1) * v
                v *= v
                v *= np.float32(0.01)
                s *= np.float32(0.99)
                s += v
                step = np.sqrt(s, out=v)
                step *= np.float32((1 - 0.9**t) / np.sqrt(1 - 0.99**t))
                step += np.float32(1e-8)
                np.divide(m, step, out=step)
                step *= np.float32(RATE)
                p[k] -= np.where(p[k] > -1e8, step, 0) if k in ("wb", "cb") else step


def score_documents(p: Params, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log probability of each whole document."""
    out = np.zeros(len(first) - 1)
    for rows, windows in lane_windows(tokens, first, SCORE_LANES, SCORE_LANES * WINDOW):
        h = np.zeros((HIDDEN, len(rows)), dtype=np.float32)
        for source, target, mask in windows:
            states = run_window(p, source, h[:, : source.shape[1]])
            h = states[-1]
            at = np.flatnonzero(mask.ravel())
            lp = log_probability(p, np.take(states.transpose(1, 0, 2).reshape(HIDDEN, -1), at, axis=1), target.ravel()[at])
            out[rows] += np.bincount(at % source.shape[1], weights=lp, minlength=len(rows))
    return out


def _end(hashes: np.ndarray, first: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of documents with ``end`` after each."""
    return np.insert(hashes, first[1:], end), first + np.arange(len(first))


class Vocabulary:
    """Frequent words by hash: their counts, and ids in the network for the first of them."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        rank = np.arange(len(hashes))
        self.hashes, self.counts = hashes[order], counts[order]
        self.ids = np.where(rank < VOCABULARY - 1, END + 1 + rank, UNKNOWN)[order].astype(np.int32)
        self.n_words = min(len(hashes), VOCABULARY - 1) + 1

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word, -1 where it isn't among the frequent."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = words(column)
        at = self.look_up(w.hash)
        return _end(np.where(at >= 0, self.ids[at] if len(self.ids) else 0, UNKNOWN).astype(np.int32), w.first, END)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        return names, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    found, size = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            found.append(np.unique(words(part.column("text")).hash, return_counts=True))
            size += len(found[-1][0])
            if size > 4_000_000:  # what a task holds stays bounded
                h, n = merged(found)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
                found, size = [], 0
    if found:
        h, n = merged(found)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def _documents(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    tokens, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for batch in batches:
        for part in slices(batch, "text"):
            t, first = vocabulary.encode(part.column("text"))
            tokens.append(t)
            lengths.append(np.diff(first))
    return np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def _replicas(flat: np.ndarray, vocabulary: Vocabulary, chunks: int):
    """One replica for each task: trained batch after batch, given as chunks of (parameters x tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, adam, n = unpack(flat), {}, 0
        for batch in batches:
            tokens, first = _documents(iter([batch]), vocabulary)
            if len(tokens):
                train_replica(p, tokens, first, adam)
                n += len(tokens)
        if n:
            parts = np.array_split(pack(p).astype(np.float64) * n, chunks)
            replica = TaskContext.get().partitionId() % GROUPS
            yield _sums({k: [n, x] for k, x in enumerate(parts)}, replica)

    return run


def _sums(total: dict[int, list], replica: int = 0) -> pa.RecordBatch:
    columns = [pa.array(list(total), pa.int32()), pa.array([replica] * len(total), pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1].tolist() for v in total.values()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "replica", "n", "part"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks that come to a task."""
    total: dict[int, list] = {}
    for batch in batches:
        for chunk, n, part in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist(), batch.column("part"), strict=True):
            value = part.values.to_numpy()
            if chunk in total:
                total[chunk][0] += n
                total[chunk][1] = total[chunk][1] + value
            else:
                total[chunk] = [n, value]
    if total:
        yield _sums(total)


_SUMS = "chunk int, replica int, n long, part array<double>"


def train_round(flat: np.ndarray, texts: DataFrame, vocabulary: Vocabulary, chunks: int = 16) -> np.ndarray:
    """The average of the tasks' replicas, weighted by their tokens."""
    replicas = texts.mapInArrow(_replicas(flat, vocabulary, chunks), _SUMS)
    # Added up in two steps, so that no task's load grows with the number of replicas by more than a root of it.
    groups = replicas.repartition("chunk", "replica").mapInArrow(_add, _SUMS)
    sums = groups.repartition("chunk").mapInArrow(_add, _SUMS).orderBy("chunk").collect()  # as long as the network, whatever the corpus
    return np.concatenate([np.array(r.part) / r.n for r in sums]).astype(np.float32) if sums else flat


def frequent_words(counts: DataFrame, most: int | None = None) -> Vocabulary:
    """The words of ``counts`` (h, n) from the least count on that leaves at most ``most`` (FREQUENT) of them.

    Words are counted by their own count first, in steps of a sixteenth of an octave (a
    thousand rows at most), so that no word is sorted but the few that travel."""
    most = FREQUENT if most is None else most
    step = F.floor(F.log2("n") * 16).cast("int")
    levels = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.col("step").desc()).collect()
    words, least = 0, None
    for level in levels:
        words += level.words
        if words > most:
            break
        least = level.step
    top = counts.filter(step >= (1 << 30 if least is None else least)).toArrow().sort_by([("n", "descending"), ("h", "ascending")])
    return Vocabulary(top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy())


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


def lm_score(docs: DataFrame) -> DataFrame:
    """The digest that query op10 returns."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.filter("not held_out").select("doc_id", "text")
    part = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(ROUNDS))

    counts = cut(texts.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    n_texts = texts.count()
    said = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = said.n + n_texts, said.v + (n_texts > 0)
    vocabulary = frequent_words(counts)
    named = vocabulary.ids != UNKNOWN
    rest = float(said.n + said.v - vocabulary.counts[named].sum() - named.sum() + 1)

    flat = pack(start(vocabulary.n_words))
    # About FIRST_TEXTS rows, drawn by hash, train the replica that the rounds start from; a text that
    # repeats very often is drawn as a whole or not at all, so the draw has a bound of its own.
    drawn = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FIRST_TEXTS / max(1, n_texts)))
    first = texts.filter(drawn).select("text").limit(2 * FIRST_TEXTS)
    flat = train_round(flat, first, vocabulary)
    for k in range(ROUNDS):
        flat = train_round(flat, texts.filter(part == k).select("text"), vocabulary)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unpack(flat)
        for batch in batches:
            tokens, logs, unknown, rare_words, rare_counts, known, n_unknown = [], [], [], [], [], [], []
            for piece in slices(batch, "text"):
                w = words(piece.column("text"))
                at = vocabulary.look_up(w.hash)
                row = np.repeat(np.arange(piece.num_rows), np.diff(w.first))
                ids = np.where(at >= 0, vocabulary.ids[at] if len(vocabulary.ids) else 0, UNKNOWN).astype(np.int32)
                log = np.where(at >= 0, np.log10((vocabulary.counts[at] if len(at) and len(vocabulary.counts) else 0) + 1.0), 0.0)
                tokens.append(_end(ids, w.first, END))
                logs.append(np.bincount(row, weights=log, minlength=piece.num_rows))
                unknown.append(np.bincount(row, weights=log * (ids == UNKNOWN), minlength=piece.num_rows))
                known.append(np.bincount(row[at >= 0], minlength=piece.num_rows))
                n_unknown.append(np.bincount(row[ids == UNKNOWN], minlength=piece.num_rows))
                rare = at < 0
                keys, many = np.unique(np.rec.fromarrays([row[rare], w.hash[rare]], names="r,h"), return_counts=True)
                edges = np.searchsorted(keys["r"], np.arange(piece.num_rows + 1)).astype(np.int32)
                rare_words.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(keys["h"]).view(np.int64))))
                rare_counts.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(many.astype(np.int32))))
            if not tokens:
                continue
            lengths = np.concatenate([np.diff(f) for _, f in tokens])
            lm = score_documents(p, np.concatenate([t for t, _ in tokens]), np.concatenate([[0], np.cumsum(lengths)]))
            columns = [batch.column("doc_id"), batch.column("held_out"), *[pa.array(np.concatenate(x)) for x in ([lengths], known, logs, unknown, n_unknown)], pa.array(lm / _LN10), pa.concat_arrays(rare_words), pa.concat_arrays(rare_counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "known", "logs", "unknown", "n_unknown", "lm", "rare", "rare_n"])

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, held_out boolean, n_tokens long, known long, logs double, unknown double, n_unknown long, lm double, rare array<long>, rare_n array<int>"
    scored = cut(rows.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()))
    # The counts of all other words come by a join; what it finds is summed for each row again.
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.rare_n").alias("m"))
    found = rare.join(counts, "h").groupBy("row").agg(F.sum("m").alias("rare_known"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("rare_log"))
    out = scored.join(found, "row", "left").fillna(0, ["rare_known", "rare_log"])
    ends = float(n_texts)
    base = F.col("logs") + F.col("rare_log") + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("rare_known") + F.lit(int(n_texts > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("lm") + F.col("unknown") + F.col("rare_log") - F.col("n_unknown") * float(np.log10(max(rest, 1.0)))).alias("score"),
    )
