"""Operator 13: a Merkle manifest of a data set, with a witness for every row.

Rows are leaves.  The leaves of one ``tree`` value (a language) stand in order; every two consecutive nodes become
their hash, a last one without a sibling is hashed alone, until one node, the subroot, remains.  The subroots, in the
order of the trees, become the root in the same way.  ``H`` is the lower-case hex SHA-256 of its inputs, concatenated.

Witnesses grow by *appends* (``Appender``).  A leaf starts as an open subtree with an empty witness.  When the sibling
of an open subtree is complete, both close into their parent, and the witnesses that are attached to either are
extended by the other's digest.  Appends are aligned: 2^K consecutive positions are one block, an append sequence of its
own, so Spark runs the blocks of all trees at once, whatever tree holds most rows.  The roots of blocks are appended in
the same way, block by block, and so on until every tree has one node.  On the way back each block takes the witness
of its root, as far as it has grown, and hands it on to its members.  No task holds more than blocks of 2^K members; the
rounds are log(rows) / K.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, table

#: 2^K nodes are one block.
K = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_WITNESS = pa.list_(pa.struct([("digest", pa.string()), ("left", pa.bool_())]))


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row: of each field its UTF-8 byte count, a colon and the value; ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Appender:
    """Appends of one block: open subtrees, largest first, and the witness of every member so far.

    A witness lists siblings from the leaf upwards as (digest, whether it stands left); the digest is empty where a
    node has no sibling and is hashed alone.
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, str, int]] = []  # level, digest, first member
        self.witnesses: list[list[tuple[str, bool]]] = []

    def append(self, digest: str) -> None:
        self.witnesses.append([])
        self._settle((0, digest, len(self.witnesses) - 1))

    def _settle(self, node: tuple[int, str, int]) -> None:
        while self.open and self.open[-1][0] == node[0]:
            level, left, first = self.open.pop()
            for w in self.witnesses[first : node[2]]:
                w.append((node[1], False))
            for w in self.witnesses[node[2] :]:
                w.append((left, True))
            node = (level + 1, H(left, node[1]), first)
        self.open.append(node)

    def close(self, levels: int) -> str:
        """No sibling comes any more: raise what is open to one node, on ``levels`` at least; its digest."""
        while len(self.open) > 1 or self.open[-1][0] < levels:
            level, digest, first = self.open.pop()
            for w in self.witnesses[first:]:
                w.append(("", False))
            self._settle((level + 1, H(digest), first))
        return self.open[0][1]


def _appended(digests: Iterable[str], size: int, k: int) -> tuple[Appender, str]:
    block = Appender()
    for d in digests:
        block.append(d)
    return block, block.close(k if size > 1 << k else 0)


def _positions(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with pos and size, their written table): the place of each row in its tree, and how many the tree has.

    One sort by ranges, in which a tree of any size is dealt over many tasks, also where rows repeat (by ``spread``);
    then the counts per range and tree, of which one tree has as many as there are tasks.
    """
    keys = ["tree", *order, "spread"]
    written = cut(rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("spread"), "ordered")
    placed = written.withColumn("part", F.shiftright("at", 33))
    whole = Window.partitionBy("tree")
    starts = placed.groupBy("tree", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n")).select(
        "tree", "part", "low", F.sum("n").over(whole).alias("size"),
        F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    return placed.join(starts, ["tree", "part"]).withColumn("pos", F.col("at") - F.col("low") + F.col("before")).drop("at", "part", "low", "before"), written


def _blocks(nodes: DataFrame) -> DataFrame:
    """tree, block, size, members: at most 2^K members a block, in order."""
    payload = [c for c in nodes.columns if c not in ("tree", "size", "pos")]
    return nodes.groupBy("tree", F.shiftright("pos", K).alias("block"), "size").agg(F.sort_array(F.collect_list(F.struct("pos", *payload))).alias("members"))


def _roots(k: int):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_appended((m["digest"].hex() for m in row), n, k)[1] for row, n in zip(_lists(batch, "members"), batch.column("size").to_pylist(), strict=True)]
            roots = pa.array([bytes.fromhex(d) for d in digests], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), batch.column("size"), roots], ["tree", "pos", "size", "digest"])

    return run


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[list]:
    for k in range(batch.num_rows):
        yield batch.column(name)[k].as_py()


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each round, tree and digest of the one node that remains)."""
    rounds: list[DataFrame] = []
    while True:
        rounds.append(cut(_blocks(nodes), "blocks"))
        up = rounds[-1].select("tree", "block", "size", F.transform("members", lambda m: F.struct(m["digest"].alias("digest"))).alias("members"))
        nodes = cut(up.mapInArrow(_roots(K), "tree string, pos long, size long, digest binary").withColumn("size", F.shiftright(F.col("size") - 1, K) + 1), "roots")
        if (nodes.agg(F.max("size")).first()[0] or 1) == 1:
            return rounds, nodes.select("tree", "digest")


def _grown(payload: list[str], levels: int):  # noqa: ANN202
    """Members of blocks with their witnesses: what grows inside the block, then the witness of the block's root."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("tree", "block", "size")}
            for k, members in enumerate(_lists(batch, "members")):
                above = [(s["digest"], s["left"]) for s in batch.column("above")[k].as_py() or []]
                block, _ = _appended((m["digest"].hex() for m in members), columns["size"][k], levels)
                grown = [[{"digest": d, "left": left} for d, left in w + above] for w in block.witnesses]
                at = batch.schema.field("members").type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array([columns["tree"][k]] * len(members), pa.string()), *[pa.array([m[p] for m in members], at.field(p).type) for p in payload], pa.array(grown, _WITNESS)], ["tree", *payload, "witness"]
                )

    return run


def _descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The members of the first round's blocks, with whole witnesses.  top: tree and the witness of its one node."""
    above = top.select("tree", F.lit(0).cast("long").alias("block"), "above")
    for k in reversed(range(len(rounds))):
        payload = [f.name for f in rounds[k].schema["members"].dataType.elementType.fields]
        kinds = {f.name: f.dataType.simpleString() for f in rounds[k].schema["members"].dataType.elementType.fields}
        schema = ", ".join(["tree string", *[f"`{p}` {kinds[p]}" for p in payload], "witness array<struct<digest:string,left:boolean>>"])
        members = rounds[k].join(above, ["tree", "block"]).select("tree", "block", "size", "members", "above").mapInArrow(_grown(payload, K), schema)
        above = members.select("tree", F.col("pos").alias("block"), F.col("witness").alias("above")) if k else members
    return above


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, leaf, lambda acc, s: F.sha2(F.when(s["left"], F.concat(s["digest"], acc)).otherwise(F.concat(acc, s["digest"])), 256))


def merkle_manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, tree: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, tree, leaf, claim, subroot, root, witness.

    Trees stand by name (null first, bytewise), rows of a tree by ``key`` (null first), rows that repeat a key by leaf;
    rows that are alike in everything are leaves of their own, each with its own witness.  ``claim`` is the leaf of the
    row with the fields in ``claimed`` put in place of its own, to be folded against the root.  A null tree and an empty
    name are two trees.  A null field counts as ``-``, an empty text as ``0:``; texts are hashed whole.  An empty table
    gives no rows; further columns are not looked at.
    """
    own = {f: F.col(f) for f in fields}
    name = F.col(tree).cast("string")
    rows = docs.select(
        F.col(key).alias("key"), F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("tree"), F.unhex(leaf_digest(*own.values())).alias("digest"),
        F.unhex(leaf_digest(*(own | (claimed or {})).values())).alias("claim"),
    )
    rows = rows.withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim")))
    placed, ordered = _positions(rows, "key", "digest")
    rounds, subroots = _climb(placed)
    discard(ordered)
    tops, ordered = _positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name")
    upper, root = _climb(tops)
    discard(ordered)
    above = _descend(upper, root.select("tree", F.array().cast("array<struct<digest:string,left:boolean>>").alias("above")))
    whole = root.first()
    above = above.select(F.col("name").alias("tree"), F.col("witness").alias("above"), F.lower(F.hex("digest")).alias("subroot"), F.lit(whole and whole.digest.hex()).cast("string").alias("root"))
    above = cut(above, "trees")
    discard(*upper, root)
    leaf = F.lower(F.hex("digest"))
    return (
        _descend(rounds, above.select("tree", "above"))
        .join(above.select("tree", "subroot", "root"), "tree")
        .select(F.col("key").alias("doc_id"), F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("tree"), leaf.alias("leaf"), F.coalesce(F.lower(F.hex("claim")), leaf).alias("claim"), "subroot", "root", "witness")
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the unsigned crc32 of the decimal doc_id, the row that is verified has one more in n_chars."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.col("n_chars").cast("decimal(38,0)")
    rows = merkle_manifest(table(spark, sf_dir, "documents"), {"n_chars": F.when(hit, n_chars + 1).otherwise(n_chars)})
    folded = rows.withColumn("folded_root", fold(F.col("claim"), F.col("witness")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.transform("witness", lambda s: s["digest"]), ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


_FIELD = "coalesce(strlen(cast({0} AS VARCHAR)) || ':' || cast({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS) + ")"
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(cast(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"""
OP13_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, lang, {_LEAF} AS leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
        CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN {_LEAF.replace('n_chars', '(n_chars + 1)')} END AS claim
    FROM documents),
up AS (
    SELECT lang, 0 AS level, pos, leaf AS h, n FROM d
    UNION ALL
    SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subs AS (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
    SELECT 0 AS level, pos, subroot AS h, n FROM subs
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
walk AS (
    SELECT doc_id, lang, 0 AS level, false AS above, pos, n, coalesce(claim, leaf) AS f, CAST('' AS VARCHAR) AS sib FROM d
    UNION ALL
    SELECT w.doc_id, w.lang, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END, w.above OR w.n = 1, CASE WHEN w.n > 1 THEN w.pos // 2 ELSE s.pos END,
        CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE s.n END,
        CASE WHEN w.n = 1 THEN w.f WHEN w.pos % 2 = 0 THEN sha256(w.f || coalesce(u.h, t.h, '')) ELSE sha256(coalesce(u.h, t.h, '') || w.f) END,
        w.sib || CASE WHEN w.n = 1 THEN '' ELSE coalesce(u.h, t.h, '') END
    FROM walk w JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang
    LEFT JOIN up u ON NOT w.above AND w.n > 1 AND u.lang IS NOT DISTINCT FROM w.lang AND u.level = w.level AND u.pos = xor(w.pos, 1)
    LEFT JOIN top t ON w.above AND w.n > 1 AND t.level = w.level AND t.pos = xor(w.pos, 1)
    WHERE w.n > 1 OR NOT w.above),
ends AS (SELECT * FROM walk WHERE above AND n = 1)
SELECT d.doc_id, d.leaf, s.subroot, r.h AS root, sha256(e.sib) AS proof_sha256, e.f AS folded_root, e.f = r.h AS verified
FROM d JOIN subs s ON s.lang IS NOT DISTINCT FROM d.lang JOIN ends e ON e.doc_id IS NOT DISTINCT FROM d.doc_id AND e.lang IS NOT DISTINCT FROM d.lang
JOIN (SELECT h FROM top WHERE n = 1) r ON true
"""
