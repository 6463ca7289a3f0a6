"""All-vs-all sequence search (GR22): a k-mer prefilter and banded local alignment.

Sequences: id, s (array<long>, one number per residue).  Pairs are never made from all sequences:

1. *Posting join.*  Each different sequence posts the ``KMERS`` of its k-mers with the least hashes (at their first
   place).  Sequences that share a posted k-mer are candidates; a k-mer that more than ``GROUP`` sequences post is dealt
   into subgroups of about that size, by another hash for every k-mer, and tied together by its longest sequence.  So a
   k-mer held by n sequences makes n * GROUP / 2 + n rows at most, and sequences that are much alike meet under some of
   their other k-mers.
2. *Diagonals.*  Hits of a pair are counted by the diagonal (difference of places) they lie on; the strongest stays.
3. *Alignment.*  Local alignment with linear gaps in a band about that diagonal, for an Arrow batch of pairs at once:
   identity (equal residues over columns) and how much of either sequence is covered.

Equal sequences are aligned once, by their smallest ids; ``members`` lists who shares a sequence.

The residues are written once, and once more their sketches (digest, posted k-mers with places), from which all but the
alignments is made.  A pair costs as many rows of its band as meet the other sequence, not the longer one's length; the
rows and the way back go over all pairs of a block at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _checkpoint

#: Residues of a k-mer, k-mers a sequence posts, sequences of a subgroup, least hits on a diagonal's neighbourhood.
K, KMERS, GROUP, HITS = 3, 24, 32, 2
#: Scores of equal and different residues and of a gap's residue; the band reaches so far to either side.
SAME, OTHER, GAP, BAND = 2, -1, -1, 24
#: Cells of the traceback and pairs that are held at once.
CELLS, PAIRS = 64 << 20, 512


def words(text: Column) -> Column:
    """A text's words, lower-cased, as residues."""
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def members(seqs: DataFrame) -> DataFrame:
    """id, rep: the smallest id with the same sequence.  Null and empty sequences are left out."""
    return _members(_sketches(seqs))


def _members(sketches: DataFrame) -> DataFrame:
    named = sketches.select("id", "digest")
    return named.join(named.groupBy("digest").agg(F.min("id").alias("rep")), "digest").select("id", "rep")


def _hashed(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``F.xxhash64`` of longs, continued from a hash (the one of an array is that of its items in turn)."""
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    p = [np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    h = (seed + (p[4] + np.uint64(8))) ^ (turn(x * p[1], 31) * p[0])
    h = turn(h, 27) * p[0] + p[3]
    for n, by in ((33, p[1]), (29, p[2])):
        h = (h ^ (h >> np.uint64(n))) * by
    return h ^ (h >> np.uint64(32))


def _kmers(s: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k residues from each place."""
    h = np.full(max(len(s) - k + 1, 0), 42, np.uint64)
    for i in range(k):
        h = _hashed(s[i : i + len(h)].view(np.uint64), h)
    return h.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = batch.column("s")
        at, values = s.offsets.to_numpy(), s.values.to_numpy(zero_copy_only=False).astype(np.int64)
        every, rows = _kmers(values[at[0] : at[-1]], K), []
        for i, j in zip(at[:-1], at[1:], strict=True):
            own = every[i - at[0] : j - at[0] - K + 1] if j - i >= K else _kmers(values[i:j], j - i)
            h, first = np.unique(own, return_index=True)
            rows.append((j - i, hashlib.sha256(values[i:j].tobytes()).digest(), h[:KMERS], first[:KMERS]))
        n, digest, h, first = zip(*rows, strict=True) if rows else ([],) * 4
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (h, first))], ["id", "n", "digest", "h", "at"])


def _sketches(seqs: DataFrame) -> DataFrame:
    """id, n (residues), digest (of all), h, at (posted k-mers and their places) of sequences that are not empty."""
    kind = seqs.schema["id"].dataType.simpleString()
    return seqs.where(F.size("s") > 0).select("id", "s").mapInArrow(_sketched, f"id {kind}, n long, digest binary, h array<long>, at array<long>")


def candidates(sketches: DataFrame) -> DataFrame:
    """a < b, diagonal (place in a less place in b), hits."""
    posts = sketches.select("id", "n", F.explode(F.arrays_zip("h", "at")).alias("p")).select("id", "n", "p.h", "p.at")
    groups = posts.groupBy("h").agg(F.count(F.lit(1)).alias("of"), F.max(F.struct("n", (-F.col("id")).alias("id"), "at")).alias("c")).where("of > 1")
    held = posts.join(groups.select("h", "of", (-F.col("c.id")).alias("center"), F.col("c.at").alias("center_at")), "h")
    dealt = held.withColumn("part", F.pmod(F.xxhash64("id", "h"), F.ceil(F.col("of") / GROUP)))
    one, two = (dealt.select("h", "part", F.col("id").alias(c), F.col("at").alias(f"{c}t")) for c in "ab")
    met = one.join(two, ["h", "part"]).where("a < b").select("a", "b", (F.col("at") - F.col("bt")).alias("d"))
    tied = held.where((F.col("of") > GROUP) & (F.col("id") != F.col("center"))).select(
        F.least("id", "center").alias("a"), F.greatest("id", "center").alias("b"), F.when(F.col("id") < F.col("center"), F.col("at") - F.col("center_at")).otherwise(F.col("center_at") - F.col("at")).alias("d")
    )
    return _strongest(met.union(tied), posts)


def _strongest(hits: DataFrame, posts: DataFrame) -> DataFrame:
    near = hits.groupBy("a", "b", F.floor(F.col("d") / BAND).alias("near")).agg(F.count(F.lit(1)).alias("hits"), F.min("d").alias("low"), F.max("d").alias("high"))
    best = near.groupBy("a", "b").agg(F.sum("hits").alias("all"), F.max_by(F.struct("hits", "low", "high"), F.struct("hits", -F.abs("low"))).alias("m"))
    short = posts.where(F.col("n") < 4 * K).select(F.col("id").alias("a"), F.lit(True).alias("short")).distinct()
    kept = best.join(short, "a", "left").where((F.col("all") >= HITS) | F.col("short"))
    return kept.select("a", "b", F.floor((F.col("m.low") + F.col("m.high")) / 2).alias("diagonal"), F.col("all").alias("hits"))


def align(a: list[np.ndarray], b: list[np.ndarray], diagonal: np.ndarray, band: int = BAND) -> np.ndarray:
    """Local alignments of many pairs: columns score, equal, columns, a from, a to, b from, b to.

    Cell (i, w) of pair p is residue i of a against residue i - diagonal - band + w of b.  Pairs lie along the last axis,
    and each b is shifted by its diagonal, so that a row's band is a slice; rows whose band misses b are left out.
    """
    pairs, width = len(a), 2 * band + 1
    out = np.zeros((pairs, 7), np.int64)
    if not pairs:
        return out
    low, size = reach(np.array([len(x) for x in a]), np.array([len(x) for x in b]), np.asarray(diagonal), band)
    rows = int(size.max())
    left, right, inside = np.zeros((rows, pairs), np.int64), np.zeros((rows + width, pairs), np.int64), np.zeros((rows + width, pairs), np.int32)
    shift = low - diagonal - band  # place in b of row 0's first cell
    for p in range(pairs):
        left[: size[p], p] = a[p][low[p] : low[p] + size[p]]
        here = b[p][max(shift[p], 0) : max(shift[p] + rows + width, 0)]
        to = max(-shift[p], 0)
        right[to : to + len(here), p] = here[: rows + width - to]
        inside[to : to + len(here), p] = 1
    back = np.zeros((rows, width, pairs), np.uint8)  # 0 end, 1 diagonal, 2 gap in b (from above), 3 gap in a (from the left)
    tops = np.zeros((rows, pairs), np.int64)  # of a row: best score and, of equal ones, the first cell
    first = np.arange(width - 1, -1, -1, dtype=np.int32)[:, None]
    above, spare, shortest = np.zeros((width, pairs), np.int32), np.zeros((width, pairs), np.int32), int(size.min())
    for i in range(rows):
        equal = right[i : i + width] == left[i]
        if i >= shortest:
            equal &= i < size
        diag = np.multiply(equal, SAME - OTHER, dtype=np.int32)
        diag += above
        diag += OTHER
        cell = np.maximum(diag, 0)
        np.maximum(cell[:-1], above[1:] + GAP, out=cell[:-1])
        cell *= inside[i : i + width]
        now, step = cell.copy(), 1
        while step < width:  # the best along the row, gaps paid
            np.maximum(now[step:], np.add(now[:-step], GAP * step, out=spare[:-step]), out=now[step:])
            step *= 2
        now *= inside[i : i + width]
        move = np.maximum(2 - (now == diag).view(np.uint8), 3 * (now > cell).view(np.uint8))
        np.multiply(move, now > 0, out=back[i])
        tops[i] = (now * width + first).max(axis=0)
        above = now
    every, i = np.arange(pairs), (tops // width).argmax(axis=0)
    best, w = tops[i, every] // width, width - 1 - tops[i, every] % width
    out[:, 0] = best
    live = every[best > 0]
    out[live, 4], out[live, 6] = (i + low + 1)[live], (i + shift + w + 1)[live]
    while len(live):
        at, cell = i[live], w[live]
        move = back[at, cell, live]
        if (on := (move > 0) & (at >= 0)).sum() < len(live):
            live, at, cell, move = live[on], at[on], cell[on], move[on]
        out[live, 2] += 1
        down = move == 1
        p, at_p, cell_p = live[down], at[down], cell[down]
        out[p, 1] += left[at_p, p] == right[at_p + cell_p, p]
        out[p, 3], out[p, 5] = at_p + low[p], at_p + shift[p] + cell_p
        i[live] -= move < 3
        w[live] += (move == 2).astype(np.int64) - (move == 3)
        live = live[(i[live] >= 0) & (w[live] >= 0) & (w[live] < width)]
    return out


def reach(na: np.ndarray, nb: np.ndarray, diagonal: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """First row of a, and number of rows, whose band meets b (one row where none does)."""
    low = np.clip(diagonal - band, 0, na - 1)
    return low, np.maximum(np.minimum(na, nb + diagonal + band) - low, 1)


_FOUND = "a long, b long, identity double, query_coverage double, target_coverage double, columns long"


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        diagonals = batch.column("diagonal").to_numpy()
        _, size = reach(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), diagonals)
        order = np.argsort(size, kind="stable")  # pairs of as many rows go together
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < PAIRS and size[order[to]] * (to + 1 - at) * (2 * BAND + 1) <= CELLS:
                to += 1
            rows = batch.take(pa.array(order[at:to]))
            a, b = ([x.values.to_numpy(zero_copy_only=False) for x in rows.column(c)] for c in ("sa", "sb"))
            found = align(a, b, diagonals[order[at:to]])
            span = lambda lo, hi, own: (found[:, hi] - found[:, lo]) / np.array([len(x) for x in own])  # noqa: E731,B023
            identity = found[:, 1] / np.maximum(found[:, 2], 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column("a"), rows.column("b"), *(pa.array(x) for x in (identity, span(3, 4, a), span(5, 6, b), found[:, 2]))], ["a", "b", "identity", "query_coverage", "target_coverage", "columns"]
            )
            at = to


def search(seqs: DataFrame) -> DataFrame:
    """a < b, identity, query_coverage (of a), target_coverage (of b), columns: candidates among different sequences,
    each named by its smallest id.  Ids are unique and not null.  Null and empty sequences match nothing."""
    held = _checkpoint(seqs.select("id", "s").dropDuplicates(["id"]))  # a text is cut into residues once
    sketches = _checkpoint(_sketches(held))
    reps = sketches.join(_members(sketches).select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    own = lambda c: held.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"))
    pairs = candidates(reps).select("a", "b", "diagonal").join(own("a"), "a").join(own("b"), "b")
    return pairs.select("a", "b", "diagonal", F.size("sa").alias("na"), F.size("sb").alias("nb"), "sa", "sb").mapInArrow(_aligned, _FOUND)


def similar(found: DataFrame, identity: float, coverage: float) -> DataFrame:
    """GR1 on search results: pairs with this identity, and this much of both sequences covered."""
    both = F.least("query_coverage", "target_coverage")
    return found.where((F.col("identity") >= identity) & (both >= coverage)).select("a", "b", "identity", both.alias("coverage"))
