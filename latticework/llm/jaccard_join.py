"""Operator 1: n-gram Jaccard join in a metric space.

1 - Jaccard is a metric on shingle sets, and a link is a distance of at most ``EPS = 1 - 3/4``.  The join is exact:

1. *Classes.*  Documents with equal sets are at distance 0; one class stands for them.
2. *Regions.*  In high dimensions almost every pair of documents is at distance 1, so windows about pivots
   that are documents would replicate everything everywhere.  The first level's pivots are therefore the
   one-shingle sets, ranked in one order for all (shingles known to be frequent last, else by hash); a set
   lies in the Voronoi region of the best-ranked pivot that is not at distance 1 from it.  If d(x, y) <= EPS,
   their common part z has d(x, z) <= d(x, y) and d(y, z) <= d(x, y), so z lies in both balls.  A point of
   the ball about x that is part of x has lost at most EPS * |x| shingles: its region is that of one of the
   first ``|x| - ceil(3|x|/4) + 1`` shingles of x.  Replicating x to those regions - its window - makes every
   linked pair meet in the region of z.
3. *Recursion.*  Inside regions the pivots are documents: in the first round the one of the least name, and regions
   that have it in common become one; then rounds take turns.  Pivots of the region's largest component cost no more
   than the documents outside it and tie most of these to it; pivots of the smallest components then meet all of the
   region, and leave it.  Either kind becomes MORE times as many.  A pivot is compared with all of its region
   except those of its component and those that their sizes and the ranks of the region's shingle in them (were it
   the first that both have), the triangle
   inequality about the pivot of the round before, or a sketch rule out.  A comparison gives bounds [lo, hi] of
   the distance: the distance itself where sets were intersected, else the sketch's lower bound and 1.  Links
   merge components, pivots leave the region, being done, and documents in it are dealt to the Voronoi cell of
   their nearest pivot.  A document y enters the window of another cell with pivot p and radius r unless
   lo(y, p) > r + EPS; pairs are compared only where one of them is at home.  Documents without a near pivot
   form a cell of their own.  The cells are the next regions wherever they hold at most twice the region's
   documents together; else (all distances alike) the region stays whole, less its pivots.  Regions recurse
   until each holds one component.

The sketch of a set is the parity of its shingles by some bits of their hash (2 to 4 counters of one bit a
shingle).  Two sketches differ in at most as many bits as the sets differ in shingles, and halves of a sketch
fold into one of half the length, so sketches of different lengths compare.

Links inside one component that nothing needs are not listed, so a group of k copies costs about k
verifications, not k^2.  Hot regions are never gathered: their rows are dealt over several tasks by a salt,
pivots come from a partial top-k, and a region's documents meet them in a join whose large partitions adaptive
execution splits.

Sets are held as 64-bit shingle hashes (two different shingles of one pair of documents agree with a chance
of about 2^-64 for each pair of shingles), and a class is named by a 64-bit sum of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, cut, discard, mix, shingle_hashes, slices, table, word_hashes

#: Words of a shingle; a link has KEEP_NUM * |union| <= KEEP_DEN * |intersection|.
SHINGLE, KEEP_NUM, KEEP_DEN = 5, 3, 4
EPS = 1 - KEEP_NUM / KEEP_DEN
#: Shingles that a task sees in so many of its documents are reported as frequent; the most frequent of them
#: (a bounded table, which only ranks the pivots and never drops one) are broadcast.  Shingles of a task that
#: are held for counting.  Pivots of a region in the second
#: and third round, and how many times as many two rounds later.  How many times a region's documents its
#: cells may hold together.
FREQUENT_IN_TASK, FREQUENT_TABLE, COUNT_SHINGLES, PIVOTS, MORE, SPREAD = 3, 1 << 17, 2 << 20, 32, 16, 2
#: Parts into which frequent regions are dealt; ids of texts to read again that may be broadcast, beyond which
#: they are joined by a shuffle; rows of an Arrow batch.
SALTS, BROADCAST_IDS, ARROW_ROWS = 64, 100_000, 1500


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a slice."""
    buf, offs = bytes_of(batch.column("text"))
    words, first = word_hashes(buf, offs)
    for k in range(batch.num_rows):
        yield k, np.unique(shingle_hashes(words[first[k] : first[k + 1]], SHINGLE))


def _class(hashes: np.ndarray) -> int:
    """A 64-bit name of a set of hashes (signed)."""
    if len(hashes) == 0:
        return 0
    with np.errstate(over="ignore"):
        name = mix(hashes).sum() + mix(hashes ^ np.uint64(0x5555555555555555)).sum() * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([name], np.uint64)).view(np.int64)[0]) or 1


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set's counters: 64-bit words, 2 to 4 bits a shingle and a power of two of them."""
    bits = max(64, 1 << int(2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def _scan(docs: DataFrame) -> DataFrame:
    """kind 0: a document (a = doc_id, b = class, n = set size, key = its row's key; the sketch comes with the first of
    a class in a task); kind 1: a frequent shingle (a = hash, n = documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def frequent() -> pa.RecordBatch:
            nonlocal size
            every, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            hot = n >= FREQUENT_IN_TASK
            held.clear()
            seen.clear()
            size = 0
            none = np.zeros(hot.sum(), np.int64)
            return _batch(none + 1, every[hot].view(np.int64), none, n[hot], none)

        for b in slices(batches):
            ids, names, sizes, sketches = b.column("doc_id"), [], [], []
            for _, s in _sets(b):
                name = _class(s)
                names.append(name)
                sizes.append(len(s))
                sketches.append(None if name in seen else sketch(s))
                if name not in seen:
                    seen.add(name)
                    held.append(s)
                    size += len(s)
            yield _batch(np.zeros(len(names), np.int64), ids, np.array(names, np.int64), np.array(sizes, np.int64), b.column("key"), sketches)
            if size > COUNT_SHINGLES:
                yield frequent()
        yield frequent()

    return docs.mapInArrow(run, "kind long, a long, b long, n long, key long, sketch array<long>")


def _batch(kind, a, b, n, key, sketches: list | None = None) -> pa.RecordBatch:
    last = pa.array(sketches if sketches is not None else [None] * len(n), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*(pa.array(c) if isinstance(c, np.ndarray) else c for c in (kind, a, b, n, key)), last], ["kind", "a", "b", "n", "key", "sketch"])


def _postings(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Each class in the regions of its window: token, class, n, pos (the token's rank in the class), and a salt
    that deals frequent regions over several tasks.  ``frequent``: sorted hashes; ``counts``: documents known to hold them."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen_in = sent.value
        done: set[int] = set()
        for b in slices(batches):
            tokens, classes, sizes, salts, places = [], [], [], [], []
            for _, s in _sets(b):
                name, n = _class(s), len(s)
                if n == 0 or name in done:
                    continue
                done.add(name)
                at = np.searchsorted(hot, s)
                at[at == len(hot)] = 0
                rank = np.where(hot[at] == s, seen_in[at], 0) if len(hot) else np.zeros(n, np.int64)
                window = n - (-(-KEEP_NUM * n // KEEP_DEN)) + 1
                first = np.argsort(rank, kind="stable")[:window]
                tokens.append(s[first])
                classes.append(np.full(window, name, np.int64))
                sizes.append(np.full(window, n, np.int32))
                places.append(np.arange(window, dtype=np.int32))
                salts.append(np.where(rank[first] > 0, 1 + abs(name) % SALTS, 0).astype(np.int32))
            if len(done) > 1 << 18:
                done.clear()
            if tokens:
                parts = [np.concatenate(tokens).view(np.int64), np.concatenate(classes), np.concatenate(sizes), np.concatenate(salts), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["token", "class", "n", "salt", "pos"])

    return docs.mapInArrow(run, "token long, class long, n int, salt int, pos int")


_STARS = "region long, x long, n int, pos int, p long, pn int, ppos int, open boolean"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and class to the stars of the regions: each class but the first one, which is the
    pivot p, and whether the region holds more than the two.  Rows of frequent tokens, whose regions are dealt over
    several tasks, pass without a pivot.  Only one row is carried from a batch to the next."""
    kinds = [("token", np.int64), ("class", np.int64), ("n", np.int32), ("salt", np.int32), ("pos", np.int32)]
    carry = [np.zeros(0, t) for _, t in kinds]
    pivot, rank = (0, 0, 0), 0  # of the carried row's region; the carried row's place in it
    for b in _ended(batches):
        cols = [np.concatenate([c, b.column(k).to_numpy()]) for c, (k, _) in zip(carry, kinds, strict=True)] if b is not None else carry
        token, name = cols[0], cols[1]
        if len(token) == 0:
            continue
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (name[1:] != name[:-1])])  # a class comes from several tasks
        token, name, n, salt, pos = (c[new] for c in cols)
        head = np.concatenate([[rank == 0], token[1:] != token[:-1]])
        at = np.maximum.accumulate(np.where(head, np.arange(len(token)), -1))  # -1: the carried region's pivot
        p, pn, ppos = (np.where(at < 0, q, c[at]) for q, c in zip(pivot, (name, n, pos), strict=True))
        place = np.arange(len(token)) - np.where(at < 0, -rank, at)
        more = np.concatenate([token[1:] == token[:-1], [False]]) | (place >= 2)
        end = len(token) if b is None else len(token) - 1
        go = np.flatnonzero((salt[:end] > 0) | (place[:end] > 0))
        for k in range(0, len(go), 1 << 16):
            i = go[k : k + (1 << 16)]
            hot = salt[i] > 0
            cut_ = [pa.array(c[i]) for c in (token, name, n, pos)] + [pa.array(c[i], mask=hot) for c in (p.astype(np.int64), pn.astype(np.int32), ppos.astype(np.int32), more)]
            yield pa.RecordBatch.from_arrays(cut_, ["region", "x", "n", "pos", "p", "pn", "ppos", "open"])
        carry = [c[-1:] for c in (token, name, n, salt, pos)]
        pivot, rank = (p[-1], pn[-1], ppos[-1]), int(place[-1])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of the ends of undirected edges (a, b); distributed
    minimum labels with pointer jumping, each round written to the shared folder."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("c"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("c"), F.col("component").alias("above"))
        new = cut(low.join(up, "c", "left").select("node", F.least("c", F.coalesce("above", "c")).alias("component"), "was"), "labels")
        discard(labels)
        labels = new.select("node", "component")
        if new.where("component < was").isEmpty():
            discard(both)
            return labels


def merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels of ``components`` after more edges: only the components that these join are worked on."""
    ends = lambda c: F.coalesce(F.col(f"{c}l"), F.col(c)).alias(c)
    for c in "ab":
        edges = edges.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}l")), c, "left")
    joined = components(edges.select(ends("a"), ends("b")).where("a <> b"))
    old = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = joined.join(labels.select("node"), "node", "left_anti").select("node", "component")
    out = cut(old.union(new), "labels")
    discard(labels, joined)
    return out


def _fits(n: str, pos: str, m: str, mpos: str) -> Column:
    """Whether sets of n and m shingles that meet in the region of their first common shingle, at these ranks, can
    be linked: they have no more in common than either has from there on, and need 3/7 of n + m."""
    return F.least(F.col(n) - F.col(pos), F.col(m) - F.col(mpos)) * (KEEP_NUM + KEEP_DEN) >= (F.col(n) + F.col(m)) * KEEP_NUM


def _apart(lo: str, hi: str, plo: str, phi: str) -> Column:
    """Whether the triangle inequality about a third point keeps two documents apart, from the bounds of their
    distances to it."""
    return F.greatest(F.col(lo) - F.col(phi), F.col(plo) - F.col(hi)) > EPS + 1e-9


def _meet(left: DataFrame, pivots: DataFrame) -> DataFrame:
    """region, x, p: the pivots that the documents of their region must be compared with."""
    return left.join(pivots, "region").where(
        (F.col("x") != F.col("p")) & (F.col("home") | F.col("phome")) & (F.col("component") != F.col("pc")) & _fits("n", "pos", "pn", "ppos") & ~_apart("lo", "hi", "plo", "phi")
    ).select("region", "x", "p")


def _deal(left: DataFrame, met: DataFrame, known: DataFrame) -> DataFrame:
    """The regions of the next round: the Voronoi cells of the pivots with their windows, where these hold no more
    than SPREAD times the region's documents, else the regions as they are.

    A document whose distance to some pivot of its region is known is at home in the cell of the nearest one; r is
    the greatest such distance in a cell.  If x is at home in it and d(x, y) <= EPS, d(y, p) <= r + EPS, so y is in
    the window unless its lower bound says otherwise.  Documents that no pivot is near form the cell of none, where
    those that are not at home in the region come too."""
    bounds = known.select("a", "b", "lo", "hi")
    dist = cut(met.withColumn("a", F.least("x", "p")).withColumn("b", F.greatest("x", "p")).join(bounds, ["a", "b"]).select("region", "x", "p", "lo", "hi"), "distances")
    homes = dist.where("hi < 1").groupBy("region", "x").agg(F.min(F.struct("hi", "p")).alias("h")).select("region", "x", F.col("h.p").alias("hp"), F.col("h.hi").alias("hd"))
    left = cut(left.join(homes, ["region", "x"], "left"), "homes")
    cells = left.where("hp is not null and home").groupBy("region", F.col("hp").alias("p")).agg(F.max("hd").alias("r"))
    far = dist.join(cells, ["region", "p"]).where(F.col("lo") > F.col("r") + EPS + 1e-9).select("region", "x", "p")
    size = left.groupBy("region").agg(F.count(F.lit(1)).alias("s"), F.count(F.when(F.col("hp").isNull() | ~F.col("home"), 1)).alias("u"))
    split = size.join(cells.groupBy("region").agg(F.count(F.lit(1)).alias("c")), "region").join(far.groupBy("region").agg(F.count(F.lit(1)).alias("f")), "region")
    split = cut(split.where(F.col("s") * F.col("c") - F.col("f") + F.col("u") <= SPREAD * F.col("s")).select("region"), "split")
    cols = ["region", "x", "n", "pos", "home", "lo", "hi"]
    if split.isEmpty():
        return left.select(*cols)
    parts = left.join(split, "region").drop("lo", "hi")
    near = parts.join(cells.join(split, "region").select("region", "p"), "region").join(far, ["region", "x", "p"], "left_anti").join(dist, ["region", "x", "p"], "left")
    near = near.select(F.xxhash64("region", "p").alias("region"), "x", "n", "pos", (F.col("home") & F.col("hp").eqNullSafe(F.col("p"))).alias("home"), F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))
    none = parts.where("hp is null or not home").select(F.xxhash64("region", F.lit("none")).alias("region"), "x", "n", "pos", (F.col("home") & F.col("hp").isNull()).alias("home"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return left.join(split, "region", "left_anti").select(*cols).union(near).union(none)


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows without an id, or that repeat one, apart by their texts."""
    return F.xxhash64(doc_id.cast("long"), text)


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), component (a
    name of what is linked, null for a text without shingles) and key (``row_key`` of its id and text).

    Null, empty and blank texts have no shingles and are alone; very long texts are taken whole, one at a time.
    Rows that repeat a doc_id each give a row.  Rows without an id link like others: they are reported with their
    component's smallest id, null where there is none.  An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    scanned = cut(_scan(rows), "scan", ARROW_ROWS)
    members = scanned.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("class"), F.col("n").alias("n_shingles"), "key", "sketch")
    # A class's text is read again by the smallest of its rows' keys.
    grouped = members.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.max("n_shingles").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"))
    classes = cut(grouped, "classes")
    members = members.drop("sketch")

    top = scanned.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(FREQUENT_TABLE).toPandas().sort_values("a")
    hot = top["a"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    posts = _postings(rows, hot[order], top["n"].to_numpy(np.int64)[order])
    # The first round: the star of each region, its pivot against all others.
    stars = cut(posts.repartition("token", "salt").sortWithinPartitions("token", "class").mapInArrow(_stars, _STARS), "stars", ARROW_ROWS)
    dealt = stars.where("p is null").drop("p", "pn", "ppos", "open")
    heads = dealt.groupBy("region").agg(F.min(F.struct("x", "n", "pos")).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1")
    heads = heads.select("region", F.col("p.x").alias("p"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"), (F.col("m") > 2).alias("open"))
    # (At most FREQUENT_TABLE regions are dealt over several tasks.)
    regions = stars.where("p is not null").unionByName(dealt.join(F.broadcast(heads), "region").where("x <> p"))
    pairs = regions.where(_fits("n", "pos", "pn", "ppos")).select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).distinct()
    known = _verify(rows, classes, pairs)
    labels = components(known.where("linked"))

    bounds = known.select(F.col("a").alias("p"), F.col("b").alias("x"), "lo", "hi").union(known.select(F.col("b").alias("p"), F.col("a").alias("x"), "lo", "hi"))
    # Regions of one pivot become one; a document's least rank in them bounds what it can have in common there.
    joined = regions.where("open").groupBy("p", "x").agg(F.max("n").alias("n"), F.min("pos").alias("pos")).join(bounds, ["p", "x"], "left")
    left = joined.select(F.col("p").alias("region"), "x", "n", "pos", F.lit(True).alias("home"), F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))
    hubs, others, spread = PIVOTS, 2 * PIVOTS, True
    while True:
        named = left.join(labels.withColumnRenamed("node", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))
        apart = cut(named.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("home").alias("any")).where("least < most and any").select("region"), "apart")
        left = cut(named.join(apart, "region"), "open")
        if left.isEmpty():
            break
        sizes = cut(left.groupBy("region", "component").agg(F.count(F.lit(1)).alias("of")), "sizes")
        k, size = (hubs, F.desc("of")) if spread else (others, F.asc("of"))
        by = Window.partitionBy("region").orderBy(size, "component", F.xxhash64("x"), "x")
        pivots = left.join(sizes, ["region", "component"]).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        pivots = cut(pivots.select("region", F.col("x").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("ppos"), F.col("home").alias("phome"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.col("component").alias("pc")), "pivots")
        met = cut(_meet(left, pivots), "met")
        pairs = met.select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        more = _verify(rows, classes, pairs)
        known = known.union(more)
        if not more.where("linked").isEmpty():
            labels = merge(labels, more.where("linked"))
        rest = left.join(pivots.select("region", F.col("p").alias("x")), ["region", "x"], "left_anti").drop("component")
        opened, left = left, _deal(rest, met, known)
        discard(opened, pivots, met, sizes)
        hubs, others, spread = (hubs * MORE, others, False) if spread else (hubs, others * MORE, True)

    named = classes.select("class", "rep").join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "rep", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = cut(named.join(least, "component").select("class", "component", "component_id"), "named")
    discard(classes, labels, known, stars)
    out = members.join(found, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component", "key")


def _fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """x, s: the shingle hashes of the classes (class, key) wanted, from the rows of these keys.
    (Rows that share a key may give a class twice, or another one: neither changes what is verified.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [s.view(np.int64) for _, s in _sets(b)]
            offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            names = np.array([_class(s.view(np.uint64)) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(sets)))], ["x", "s"])

    chosen = wanted.select("key").distinct()
    if chosen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    return cut(rows.join(chosen, "key", "left_semi").mapInArrow(run, "x long, s array<long>"), "sets", ARROW_ROWS)


def _folded(own: str, other: str) -> Column:
    """A sketch in the length of another one, at most half as long."""
    half = (F.size(own) / 2).cast("int")
    both = F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(own) > F.size(other), both).otherwise(F.col(own))


def _verify(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, lo, hi, linked of each pair of classes: where the sketches allow a link, the distance from the whole
    sets twice; else the bounds that the sketches give.  (Sets that can be linked differ in size by a third at most,
    so one fold makes their sketches equal in length.)"""
    pairs = cut(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    few = ends.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # a round on few documents need not deal out every class
    sketched = classes.join(F.broadcast(ends), "class", "left_semi") if few else classes
    one = sketched.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    two = sketched.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    bits = F.aggregate(F.zip_with(_folded("ka", "kb"), _folded("kb", "ka"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    apart = pairs.join(one, "a").join(two, "b").select("a", "b", bits.alias("h"), (F.col("na") + F.col("nb")).alias("t"))
    # h <= |difference| of the sets, so the distance is 2h / (t + h) at least.
    sifted = cut(apart.select("a", "b", "h", "t", (F.col("h") * (KEEP_DEN + KEEP_NUM) <= F.col("t") * (KEEP_DEN - KEEP_NUM)).alias("open")), "sifted")
    discard(pairs)
    near = sifted.where("open").select("a", "b")
    shut = sifted.where("not open").select("a", "b", (2 * F.col("h") / (F.col("t") + F.col("h"))).alias("lo"), F.lit(1.0).alias("hi"), F.lit(False).alias("linked"))
    if near.isEmpty():
        return shut
    ends = near.select(F.col("a").alias("class")).union(near.select("b")).distinct()
    sets = _fetch(rows, ends.join(classes.select("class", "key"), "class"))
    one, two = sets.select(F.col("x").alias("a"), F.col("s").alias("sa")), sets.select(F.col("x").alias("b"), F.col("s").alias("sb"))
    counted = near.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    union = F.col("t") - F.col("i")
    distance = 1 - F.col("i") / union
    done = cut(counted.select("a", "b", distance.alias("lo"), distance.alias("hi"), (F.col("i") * KEEP_DEN >= union * KEEP_NUM).alias("linked")), "verified")
    discard(sets)
    return done.union(shut)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda z: z <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[k : k + least(len(ws), 5) - 1], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM w UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id
"""
