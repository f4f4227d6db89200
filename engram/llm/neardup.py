"""MinHash near-duplicates with an LSH forest.

1. Each text becomes its set of distinct word shingles, a fingerprint of that
   set, and a MinHash signature.  Equal sets are one node from here on.
2. The forest: trees of sorted orders, each beginning with hash functions of its
   own.  A bucket is the rows that share an order's first ``depth`` values, so its
   neighbours have a longest common prefix of at least that depth.  The first
   level's depth follows from the threshold: a pair at the threshold shares a
   bucket in some tree but for a chance of ``MISS``.  In a bucket of up to ``CROWD``
   rows all that agree well enough to be a link are candidates.  A crowded bucket
   whose rows agree with its hub, but for ``CROWD`` of them, is taken whole.  The
   rows of all other crowded buckets go on to the next level, two and a half times
   as deep, with as many trees as keep the chance at ``MISS``.  So the depth
   adapts to each region, and a pair at the threshold is missed with a chance of
   at most ``MISS`` a level.  Buckets still crowded at the last level are taken
   whole: their rows are confirmed on full sets, exactly.
3. Candidates are joined into regions.  A region is confirmed on the full sets:
   everything is compared with the region's hub, and what the hub does not link
   with all that shares one of its rarest shingles, since a link needs one.  That
   finds every component of the exact link graph of the region without listing its
   pairs.  Small regions take one task.  Larger ones are first split by their rare
   shingles, so a page that a whole family shares joins nothing; parts that stay
   large are confirmed in blocks: all members against the hub, then those it leaves
   over, block by block, against all members.

A link is ``100 * intersection >= percent * union`` of the sets.

Defined results: a text without words, or null, has the empty set and is linked
with nothing; fewer words than a shingle needs make one shingle; a null id is no
node, so such a row forms no class of its own (component null unless its text
equals another's); rows that repeat an id are of one class, whatever
their texts, and each of these texts has its links; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.components import components
from engram.llm.session import cut
from engram.llm.textops import mix, shingle_hashes, slices, words

TREES, HASHES = 16, 64
#: Rows of a bucket that are compared with each other.
CROWD = 16
#: Chance that a pair at the threshold shares no bucket of a level.
MISS = 2e-5
LEVELS = 2
#: Parts that a crowded bucket is dealt into.
SALTS = 16
#: Shingles and rows of a region that one task confirms.
REGION_SHINGLES, REGION_ROWS = 4_000_000, 4_000
#: Slots in which the shingles of larger regions are counted, to tell rare from frequent.
SLOTS = 1 << 18
_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64))


def least_depth(percent: int, trees: int = TREES, miss: float = MISS) -> int:
    """The deepest prefix at which a pair at the threshold is missed by all trees with a chance of at most ``miss``."""
    t = percent / 100
    return max([d for d in range(1, 9) if (1 - t**d) ** trees <= miss], default=1)


def orders(percent: int, level: int) -> np.ndarray:
    """The hash functions (trees x depth) that the orders of a level begin with."""
    depth = int(least_depth(percent) * (1 + 1.5 * level))
    if level == 0:  # no function in two trees
        return (np.arange(TREES)[:, None] * (HASHES // TREES) + np.arange(depth)) % HASHES
    trees = int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** depth))))
    rng = np.random.default_rng(level)
    return np.stack([rng.permutation(HASHES)[:depth] for _ in range(trees)])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, 32 bits each."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[at : at + 4096, None] * _A + _B).min(axis=0))
    return (out >> np.uint64(32)).astype(">u4")


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        one, two = mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int((two ^ np.uint64(len(shingles))).view(np.int64))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each row."""
    w = words(column)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        yield np.unique(shingle_hashes(w.hash[a:b], n))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) of ``docs``: with the hash of its text a row is known even where ids repeat."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def _sketcher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                one, two, size, sigs = [], [], [], []
                for s in shingle_sets(part.column("text"), n):
                    size.append(len(s))
                    f, g = fingerprint(s) if len(s) else (None, None)
                    one.append(f), two.append(g), sigs.append(signature(s).tobytes() if len(s) else None)
                columns = [part.column("doc_id"), part.column("text_key"), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(size, pa.int64()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "f1", "f2", "n_shingles", "sig"])

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").astype(np.uint32).reshape(-1, HASHES)


def _shorts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, HASHES)


def with_short(nodes: DataFrame) -> DataFrame:
    """``nodes`` plus ``short``: a byte of each value of the signature, enough to tell whether two agree."""
    last = [F.substring("sig", 4 * i + 4, 1) for i in range(HASHES)]
    return nodes.withColumn("short", F.concat(*last))


def salted(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` (rep, key) joined with ``few``, which has one row for each key; a key
    may hold a third of all rows, so it is dealt into parts and ``few`` goes to each."""
    parts = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(parts, [key, "salt"]).drop("salt")


def prefix_keys(sigs: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each signature and tree (rows x trees) a hash of the first values of the tree's order."""
    key = np.broadcast_to(mix(np.arange(1, len(order) + 1, dtype=np.uint64) * np.uint64(1 + order.shape[1])), (len(sigs), len(order))).copy()
    for at in order.T:
        key = mix(key * np.uint64(31) ^ sigs[:, at].astype(np.uint64))
    return key.view(np.int64)


def _prefixes(order: np.ndarray):
    """A row (rep, bucket) for each row and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = prefix_keys(_signatures(batch.column("sig")), order)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), len(order))), pa.array(keys.ravel())], names=["rep", "bucket"])

    return run


def _neighbours(agree: int):
    """Candidate pairs of rows (bucket, rep, short) in sorted order, all rows of a bucket against each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, reps, sigs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HASHES), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = len(keys)
            keys = np.concatenate([keys, batch.column("bucket").to_numpy()])
            reps = np.concatenate([reps, batch.column("rep").to_numpy()])
            sigs = np.concatenate([sigs, _shorts(batch.column("short"))])
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for off in range(1, min(CROWD, len(keys))):
                near = np.flatnonzero(keys[off:] == keys[:-off])
                if not len(near):
                    break
                near = near[near + off >= new]  # earlier pairs were met with the batch before
                near = near[(sigs[near] == sigs[near + off]).sum(axis=1) >= agree]
                a.append(reps[near + off])
                b.append(reps[near])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            keys, reps, sigs = keys[-CROWD:], reps[-CROWD:], sigs[-CROWD:]

    return run


def _agreement(agree: int):
    """Whether each row (rep, bucket, hub, short, hub_short) agrees with the hub of its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_shorts(batch.column("short")) == _shorts(batch.column("hub_short"))).sum(axis=1) >= agree
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rep", "bucket", "hub")], pa.array(same)], names=["rep", "bucket", "hub", "agrees"])

    return run


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (rep, sig) that may be links, from the levels of the forest."""
    agree = int(HASHES * (percent / 100 - 0.3))
    rows, short, found = nodes.select("rep", "sig"), with_short(nodes).select("rep", "short"), []
    for level in range(LEVELS):
        keyed = rows.mapInArrow(_prefixes(orders(percent, level)), "rep long, bucket long")
        buckets = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).filter("n > 1")
        shared = cut(keyed.join(buckets, "bucket"))
        small = shared.filter(F.col("n") <= CROWD).select("rep", "bucket").join(short, "rep")
        found.append(small.repartition("bucket").sortWithinPartitions("bucket", "short", "rep").select("bucket", "rep", "short").mapInArrow(_neighbours(agree), "a long, b long"))
        crowded = shared.filter(F.col("n") > CROWD)
        if crowded.isEmpty():
            break
        hubs = crowded.select("bucket", F.col("hub").alias("rep")).distinct().join(short, "rep").select("bucket", F.col("short").alias("hub_short"))
        judged = cut(salted(crowded.join(short, "rep"), hubs, "bucket").select("rep", "bucket", "hub", "short", "hub_short").mapInArrow(_agreement(agree), "rep long, bucket long, hub long, agrees boolean"))
        last = level == LEVELS - 1
        closed = judged.groupBy("bucket").agg(F.count(F.when(~F.col("agrees"), 1)).alias("left")).filter(F.lit(last) | (F.col("left") <= CROWD)).select("bucket")
        found.append(judged.join(closed, "bucket", "left_semi").select(F.col("rep").alias("a"), F.col("hub").alias("b")))
        if last:
            break
        rows = cut(rows.join(judged.join(closed, "bucket", "left_anti").select("rep").distinct(), "rep", "left_semi"))
    return reduce(DataFrame.unionByName, found)


def least_shared(size, percent: int):
    """Shingles that a set of ``size`` shares at least with whatever it is linked with."""
    return (percent * size + 99) // 100


def ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, .. of each range, one range after the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())


def linked_to(sets: list[np.ndarray], percent: int, queries: np.ndarray | None = None, same: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of a representative of its component in the exact link graph.

    With ``queries`` only these are compared with all, and ``same`` are known to
    be of one component; else every component is found, from a hub outwards.
    Sets are compared if they share one of their rarest shingles: of a set of n
    those but for the ``least_shared - 1`` most frequent, without which no link is."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(m), sizes)
    _, ident, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    root = np.arange(m)
    if same is not None and len(same):
        root[same] = same[0]

    place = np.empty(len(times), dtype=np.int64)  # rank by rarity of each different shingle
    place[np.argsort(times, kind="stable")] = np.arange(len(times))
    by_rarity = np.lexsort((place[ident], owner))
    rare = by_rarity[np.arange(len(owner)) - first[owner] <= (sizes - least_shared(sizes, percent))[owner]]
    kept = np.bincount(owner[rare], minlength=m)
    at = np.concatenate([[0], np.cumsum(kept)])  # the rare shingles of set i: rare[at[i] : at[i + 1]]
    names = ident[rare]
    of = owner[rare][np.argsort(names, kind="stable")]
    edge = np.concatenate([[0], np.cumsum(np.bincount(names, minlength=len(times)))])
    mine = np.zeros(len(times), dtype=bool)

    def partners(i: int) -> np.ndarray:
        own = names[at[i] : at[i + 1]]
        near = np.unique(of[ranges(edge[own], edge[own + 1] - edge[own])])
        mine[ident[first[i] : first[i] + sizes[i]]] = True
        shared = np.add.reduceat(mine[ident[ranges(first[near], sizes[near])]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
        mine[ident[first[i] : first[i] + sizes[i]]] = False
        return near[100 * shared >= percent * (sizes[near] + sizes[i] - shared)]

    if queries is None:
        weight = np.bincount(owner, weights=times[ident], minlength=m) / sizes
        hub = int(weight.argmax())
        root[partners(hub)] = hub
        queries = np.flatnonzero(root != hub)
    for i in queries:
        found = np.unique(root[partners(int(i))])  # holds i's own root
        if len(found) > 1:
            root[np.isin(root, found)] = found[0]
    return root


def _sets(table: pa.Table, n: int) -> list[np.ndarray]:
    return [s for batch in table.to_batches() for part in slices(batch, "text", 1 << 20) for s in shingle_sets(part.column("text"), n)]


def _confirmer(n: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep = table.column("rep").to_numpy()
        return pa.table({"a": pa.array(rep), "b": pa.array(rep[linked_to(_sets(table, n), percent)])})

    return run


def _hub_links(n: int, percent: int):
    """Whether each member of a block is linked with the hub."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets, is_hub = _sets(table, n), table.column("is_hub").to_numpy(zero_copy_only=False)
        hub = sets[int(is_hub.argmax())]
        rep = table.column("rep").to_numpy()[~is_hub]
        linked = []
        for s in (s for s, h in zip(sets, is_hub, strict=True) if not h):
            shared = len(np.intersect1d(s, hub, assume_unique=True))
            linked.append(100 * shared >= percent * (len(s) + len(hub) - shared))
        return pa.table({"rep": pa.array(rep, pa.int64()), "linked": pa.array(linked, pa.bool_())})

    return run


def _block_links(n: int, percent: int):
    """Links of a block of rows the hub left over with a block of all members."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, asks = table.column("rep").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        root = linked_to(_sets(table, n), percent, np.flatnonzero(asks), np.flatnonzero(table.column("linked").to_numpy(zero_copy_only=False)))
        return pa.table({"a": pa.array(rep), "b": pa.array(rep[root])})

    return run


def _slots(n: int):
    """How often the shingles of a task fall into each of ``SLOTS`` slots: (slot, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = list(shingle_sets(part.column("text"), n))
                if found:
                    times += np.bincount((np.concatenate(found) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(times[slot])], names=["slot", "times"])

    return run


def _rarest(n: int, percent: int, times: np.ndarray):
    """(rep, shared) for each of the rarest shingles of each row that every link must meet; ``shared``
    hashes region and shingle.  Rarity by ``times`` of slots orders all shingles alike in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                region, key, many = part.column("region").to_numpy().view(np.uint64), [], []
                for r, s in zip(mix(region), shingle_sets(part.column("text"), n), strict=True):
                    order = np.lexsort((s, times[(s % np.uint64(SLOTS)).astype(np.int64)]))
                    key.append(mix(s[order[: len(s) - least_shared(len(s), percent) + 1]] ^ r))
                    many.append(len(key[-1]))
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("rep").to_numpy(), many)), pa.array(np.concatenate(key).view(np.int64))], names=["rep", "shared"])

    return run


def split_regions(wide: DataFrame, slim: DataFrame, n: int, percent: int) -> DataFrame:
    """(rep, region): the rows of ``wide`` (region, rep, doc_id, text_key) in regions that share rare shingles.

    A link needs a shingle in common among the rarest ``size - least_shared + 1`` of
    both sets, whatever order tells which are rare.  So no link is lost, a page that
    a whole family shares joins nothing, and rows left out here are linked with nothing.
    The order counts shingles in ``SLOTS`` slots, all that the driver gets."""
    texts = cut(slim.join(wide.select("region", "rep", "doc_id", "text_key"), ["doc_id", "text_key"]).select("region", "rep", "text").dropDuplicates(["region", "rep"]))
    counted = texts.select("text").mapInArrow(_slots(n), "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toPandas()
    times = np.zeros(SLOTS, dtype=np.int64)
    times[counted["slot"].to_numpy()] = counted["times"].to_numpy()
    rare = texts.mapInArrow(_rarest(n, percent, times), "rep long, shared long")
    met = rare.groupBy("shared").agg(F.count("*").alias("rows"), F.min("rep").alias("b")).filter("rows > 1").drop("rows")
    pairs = salted(rare, met, "shared").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    return components(pairs).select(F.col("node").alias("rep"), F.col("component").alias("region"))


def _confirm_large(large: DataFrame, slim: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) of the regions of ``large`` (region, rep, doc_id, text_key, n, sig), in blocks; ``slim``: (doc_id, text_key, text)."""
    # The hub shares its prefixes with the most members.
    prefixes = large.select("rep", "sig").mapInArrow(_prefixes(orders(percent, 0)), "rep long, bucket long").join(large.select("rep", "region"), "rep").select("region", "rep", F.col("bucket").alias("key"))
    weight = prefixes.join(prefixes.groupBy("region", "key").agg(F.count("*").alias("w")), ["region", "key"]).groupBy("region", "rep").agg(F.sum("w").alias("w"))
    plan = weight.groupBy("region").agg(F.max_by("rep", F.struct("w", -F.col("rep"))).alias("hub"))
    blocks = lambda rows, shingles: F.ceil(F.greatest(2 * rows / REGION_ROWS, 2 * shingles / REGION_SHINGLES)).cast("int")
    plan = cut(plan.join(large.groupBy("region").agg(blocks(F.count("*"), F.sum("n")).alias("nb")), "region"))
    named = salted(large, plan, "region").select("region", "rep", "doc_id", "text_key", "n", "hub", "nb")
    rows = cut(slim.join(named, ["doc_id", "text_key"]).select("region", "rep", "n", "hub", "nb", "text").dropDuplicates(["region", "rep"]))
    block = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")

    members = rows.select("region", "rep", "text", block.alias("block"), F.lit(False).alias("is_hub"))
    hubs = rows.filter("rep = hub").select("region", "rep", "text", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.lit(True).alias("is_hub"))
    near = cut(members.unionByName(hubs).groupBy("region", "block").applyInArrow(_hub_links(n, percent), "rep long, linked boolean"))

    rows = rows.join(near, "rep")
    left = rows.filter("not linked").groupBy("region").agg(blocks(F.count("*"), F.sum("n")).alias("nr"))
    rows = salted(rows, left, "region")  # regions that the hub links whole are done
    ask = F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("nr")).cast("int")
    asking = rows.filter("not linked").select("region", "rep", "text", "linked", ask.alias("ask"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.lit(True).alias("asks"), block.alias("own"))
    all_rows = rows.select("region", "rep", "text", "linked", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("ask"), block.alias("block"), F.lit(False).alias("asks"), ask.alias("own"))
    both = asking.drop("own").unionByName(all_rows.filter("linked or own <> ask").drop("own"))
    pairs = both.groupBy("region", "ask", "block").applyInArrow(_block_links(n, percent), "a long, b long")
    return pairs.unionByName(near.filter("linked").join(named.select("rep", "hub"), "rep").select(F.col("rep").alias("a"), F.col("hub").alias("b")))


def _classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, text_key, f1, f2, n_shingles, class, component_id) of each row of ``docs``: a number
    for its class, and the class's smallest id; both null without words or id."""
    slim = keyed(docs)
    sketch = cut(slim.mapInArrow(_sketcher(n), "doc_id long, text_key long, f1 long, f2 long, n_shingles long, sig binary"))
    named = sketch.filter("doc_id is not null and f1 is not null")
    # A node is a set, known by its fingerprint; its text is that of the row of the smallest (id, hash).
    nodes = named.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    nodes = cut(nodes.select(F.col("f1").alias("rep"), "f2", "row.doc_id", "row.text_key", "sig", "n"))
    regions = components(candidates(nodes, percent)).select(F.col("node").alias("rep"), F.col("component").alias("region"))

    # Confirmation on whole sets, made anew from the texts of one row of each node.
    sized = cut(regions.join(nodes.select("rep", "doc_id", "text_key", "n"), "rep"))
    fits = ((F.sum("n") <= REGION_SHINGLES) & (F.count("*") <= REGION_ROWS)).alias("fits")
    wide = salted(sized, sized.groupBy("region").agg(fits).filter("not fits"), "region").drop("fits")
    if not wide.isEmpty():
        finer = split_regions(wide, slim, n, percent)
        sized = cut(sized.join(wide.select("rep"), "rep", "left_anti").unionByName(wide.drop("region").join(finer, "rep").select(sized.columns)))
    size = sized.groupBy("region").agg(fits)
    parted = salted(sized, size.filter("not fits"), "region")
    large = parted.join(nodes.select("rep", "sig"), "rep").select("region", "rep", "doc_id", "text_key", "n", "sig")
    whole = sized.join(parted.select("rep"), "rep", "left_anti").select("region", "rep", "doc_id", "text_key")
    texts = slim.join(whole, ["doc_id", "text_key"]).select("region", "rep", "text").dropDuplicates(["region", "rep"])
    links = texts.groupBy("region").applyInArrow(_confirmer(n, percent), "a long, b long")
    # Rows that share an id belong together, whatever their texts.
    sets_of = named.groupBy("doc_id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).filter("low <> high")
    twins = cut(named.join(sets_of, "doc_id").filter("f1 <> low").select(F.col("f1").alias("a"), F.col("low").alias("b")).distinct())
    more = [x for x in (None if large.isEmpty() else _confirm_large(large, slim, n, percent), None if twins.isEmpty() else twins) if x is not None]
    if more:
        found = components(reduce(DataFrame.unionByName, more, links))
    else:
        links = cut(links)
        found = links.select(F.col("a").alias("node"), F.col("b").alias("root")).join(links.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("component")), "root").select("node", "component")
    placed = cut(nodes.select("rep", "f2", "doc_id").join(found, F.col("rep") == F.col("node"), "left").select("rep", "f2", "doc_id", F.coalesce("component", "rep").alias("class")))
    least = placed.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    of_set = placed.join(least, "class").select(F.col("rep").alias("f1"), "f2", "class", "component_id")
    return sketch.drop("sig").join(of_set, ["f1", "f2"], "left")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): for each row of ``docs`` its
    class in the graph of links, named by the smallest id, and whether it is the
    row that stays."""
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = _classes(docs, n, percent).select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_dup_groups(docs: DataFrame) -> DataFrame:
    """The digest that query op8 returns: shingles of 3 words, links from 85 percent."""
    return near_duplicates(docs, 3, 85)


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest id (of rows that
    repeat this id, the one whose set has the smallest fingerprint; of rows that
    agree in id and text, any one).  Rows without words or without an id stay."""
    first = F.min(F.struct("doc_id", "f1", "f2", "text_key")).alias("row")
    kept = _classes(docs, n, percent).filter("class is not null and doc_id is not null").groupBy("class").agg(first).select(F.col("row.doc_id").alias("_near_id"), F.col("row.text_key").alias("_near_key"))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    named = docs.filter(has_words & F.col("doc_id").isNotNull())
    stay = named.join(kept, (named["doc_id"] == kept["_near_id"]) & (key == kept["_near_key"])).dropDuplicates(["_near_id", "_near_key"]).drop("_near_id", "_near_key")
    return stay.unionByName(docs.filter(~has_words | F.col("doc_id").isNull()))


#: The same as ``near_dup_groups`` by joining all shingles, for small tables.
ORACLE_SQL = """
with recursive tokens as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents
), sets as materialized (
  select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' '))) end as shingles from tokens
), members as materialized (
  select doc_id, len(shingles) as n, unnest(shingles) as shingle from sets
), links as materialized (
  select a.doc_id as x, b.doc_id as y from members a join members b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach as (
  select doc_id as x, doc_id as y from documents
  union
  select r.x, l.y from reach r join links l on l.x = r.y
), least as (
  select x, min(y) as component_id from reach group by x
)
select s.doc_id, len(s.shingles)::bigint as n_shingles, l.component_id, s.doc_id = l.component_id as kept from sets s join least l on l.x = s.doc_id
"""
