"""Operator 12: personal data, with a skip-chain conditional random field over each document.

*Base spans* are the four patterns below, leftmost and without overlap within a kind.  Each scan moves forward only, so
its time follows the text.  *Mentions* are looser: numbers in groups, addresses with an obfuscated or unfinished host.
The field has one node for each base span and each mention outside the base spans, in the order of the text:

* unary potentials by shape (separators and digits) and previous word, from the counts of all documents;
* chain potentials between neighbours, from the counts of label pairs in all documents;
* skip potentials between distant nodes that repeat, or resemble, one another (``_keys``): equal digits, one number
  within the other, one differing digit, one address in another spelling, the same network.

Base spans are observed: their labels are fixed and they stay.  Loopy sum-product messages settle the others; a mention
whose belief in a kind is at least ``BELIEF`` becomes a span.  Messages run over parts of the skip graph that hold a
base span: in a document without any, or for a mention that resembles none, there is nothing to be consistent with, and
nothing is added.  Equal keys are joined from one occurrence to the next, never all with all.

The counts are sums of a few hundred patterns (``_pattern``; previous words fall into WORDS buckets), added by Spark;
documents themselves are read once, and only spans, mentions and keys are written.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "other")
BELIEF, ROUNDS, WORDS = 0.9, 60, 64
#: Bounds of log-potentials, and the log-odds of one label for two nodes that repeat, or only resemble, one another.
UNARY, CHAIN, REPEATED, SIMILAR = 3.0, 1.0, 8.0, 4.0

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])*")
_LOOSE_AT = re.compile(r"@| ?[(\[{]at[)\]}] ?", re.IGNORECASE)
_LOOSE_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]+)*", re.IGNORECASE)
_PIECE = re.compile(r"[^ ]+")
_WORD = re.compile(r"(\S+)\s*\Z")


def _left(text: str, low: int, at: int) -> int:
    """Where the run of address characters that ends at ``at`` begins, not before ``low``."""
    piece = text[low:at]
    return low + len(piece.rstrip(_LOCAL))


def _emails(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    low, at = 0, text.find("@")
    while at >= 0:
        start, host = _left(text, low, at), None
        if start < at and (host := _HOST.match(text, at + 1)):
            out.append((start, host.end()))
        low = host.end() if host else at + 1
        at = text.find("@", low)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for chain in _DOTTED.finditer(text):
        parts = list(_DIGITS.finditer(text, *chain.span()))
        for k in range(0, len(parts) - 3, 4):
            values = [m[0].lstrip("0") or "0" for m in parts[k : k + 4]]
            if all(len(v) <= 3 and int(v) <= 255 for v in values):
                out.append((parts[k].start(), parts[k + 3].end()))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if len(m[0]) <= 37 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; code points, end exclusive."""
    found = [(_emails(text) if "@" in text else []), _ips(text), _cards(text), (_phones(text) if "+" in text else [])]
    return sorted((a, k, b) for k, spans in enumerate(found) for a, b in spans)


def _mentions(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Loose numbers (7 to 21 digits, or four dotted groups) and addresses, leftmost, outside the base spans and each other."""
    found = []
    for m in _NUMBER.finditer(text):
        pieces = [m.span()] if len(m[0]) <= 63 and len(_digits(m[0])) <= 21 else [p.span() for p in _PIECE.finditer(text, *m.span())]
        found += [(a, b) for a, b in pieces if 7 <= b - a <= 63 and (7 <= len(_digits(text[a:b])) <= 21 or _network(text[a:b]))]
    low = 0
    for at in _LOOSE_AT.finditer(text):
        start = _left(text, low, at.start())
        host = _LOOSE_HOST.match(text, at.end())
        if start < at.start() and host:
            found.append((start, host.end()))
        low = at.end()
    out, k, end = [], 0, 0
    spans = sorted((a, b) for a, _, b in taken)
    for a, b in sorted(found):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if a >= end and not (k < len(spans) and spans[k][0] < b):
            out.append((a, b))
            end = b
    return out


def _pattern(text: str, start: int, end: int) -> int:
    """Shape and previous word: what the unary potentials see.  Nothing of it decides a base pattern."""
    span = text[start:end]
    word = _WORD.search(text, max(0, start - 40), start)
    cue = zlib.crc32(word[1].lower().encode()) % WORDS if word else WORDS
    address = "@" in span or bool(_LOOSE_AT.search(span))
    shape = 0 if address else 1 + min(12, len(_digits(span)) - 4 >> 1) * 4 + (2 if "." in span else 0) + (1 if re.search("[ ()-]", span) else 0)
    return shape * (WORDS + 1) + cue


def _network(span: str) -> str:
    """The first three of four dotted groups, else nothing."""
    groups = span.split(".")
    return ".".join(g.lstrip("0") for g in groups[:3]) if len(groups) == 4 and all(g.isdigit() and len(g) <= 3 for g in groups) else ""


def _keys(span: str) -> list[str]:
    """What a node shares with those that repeat or resemble it."""
    at = _LOOSE_AT.search(span)
    if at:
        host = re.split(r"\.| ?[(\[{]dot[)\]}] ?", span[at.end() :].lower())
        return [f"e{span[: at.start()].lower()}@{host[0]}"]
    if network := _network(span):
        return [f"n{span}", f"i{network}"]
    d = _digits(span)
    out = [f"n{d}"]
    if len(d) >= 9:
        out.append(f"s{d[-9:]}")  # a number with or without the country's
    if len(d) >= 12:
        half = len(d) // 2  # one differing digit leaves a half alike
        out += [f"a{len(d)}:{d[:half]}", f"z{len(d)}:{d[half:]}"]
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_NODE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("pattern", pa.int32()), ("keys", pa.list_(pa.string()))])
_SPANS = "array<struct<start:long,kind:int,end:long>>"
_NODES = "array<struct<start:long,end:long,label:int,pattern:int,keys:array<string>>>"
OTHER = len(KINDS)


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Nodes by start: base spans with their kinds as labels, mentions with the label ``other``."""
    rows = [(a, b, k) for a, k, b in base] + [(a, b, OTHER) for a, b in _mentions(text, base)]
    return [{"start": a, "end": b, "label": k, "pattern": _pattern(text, a, b), "keys": _keys(text[a:b])} for a, b, k in sorted(rows)]


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        spans, nodes = [], []
        for scalar in part.column("text"):
            text = scalar.as_py() or ""
            base = base_spans(text)
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
            nodes.append(nodes_of(text, base))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(_SPAN)), pa.array(nodes, pa.list_(_NODE))], ["doc_id", "base", "nodes"])


def potentials(patterns: dict[tuple[int, int], int], pairs: dict[tuple[int, int], int]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """(log-potentials of the labels by pattern, log-potentials of neighbouring labels), from counts with one added.

    The chain potential of two labels is the logarithm of how much more often they follow each other than by chance.
    Both are bounded (``UNARY``, ``CHAIN``): in the counts every mention is ``other``, for want of a better name.
    """
    counts: dict[int, np.ndarray] = defaultdict(lambda: np.ones(len(LABELS)))
    for (pattern, label), n in patterns.items():
        counts[pattern][label] += n
    unary = {p: np.maximum(np.log(c / c.max()), -UNARY) for p, c in counts.items()}
    joint = np.ones((len(LABELS), len(LABELS)))
    for (a, b), n in pairs.items():
        joint[a, b] += n
    joint /= joint.sum()
    return unary, np.clip(np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True)), -CHAIN, CHAIN)


def edges_of(nodes: list[dict]) -> tuple[list[tuple[int, int]], dict[tuple[int, int], float]]:
    """(chain edges, skip edges with log-odds): neighbours, and nodes with a key in common, one occurrence to the next."""
    last: dict[str, int] = {}
    skip: dict[tuple[int, int], float] = {}
    for k, n in enumerate(nodes):
        for key in n["keys"]:
            if key in last and last[key] != k and _alike(key, nodes[last[key]], n):
                pair = (last[key], k)
                skip[pair] = max(skip.get(pair, 0.0), REPEATED if key[0] in "ens" else SIMILAR)
            last[key] = k
    return [(k, k + 1) for k in range(len(nodes) - 1)], skip


def _alike(key: str, a: dict, b: dict) -> bool:
    """Halves in common make two numbers similar only where one digit differs."""
    return key[0] not in "az" or sum(p != q for p, q in zip(a["keys"][0], b["keys"][0], strict=True)) <= 1


def beliefs(unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Marginals by sum-product messages, exact on a tree; each message moves half of its way a round."""
    at = unary.copy()
    if edges:
        source, target = np.array([(a, b) for a, b, _ in edges] + [(b, a) for a, b, _ in edges]).T
        weight = np.stack([p for *_, p in edges] + [p.T for *_, p in edges])
        back = np.roll(np.arange(len(source)), len(edges))
        message = np.zeros((len(source), unary.shape[1]))
        for _ in range(rounds):
            x = (at[source] - message[back])[:, :, None] + weight
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message = (new + message) / 2
            at = unary.copy()
            np.add.at(at, target, message)
            if moved < 1e-9:
                break
    at = np.exp(at - at.max(axis=1, keepdims=True))
    return at / at.sum(axis=1, keepdims=True)


_CLAMP = -50.0


def settle(nodes: list[dict], unary: dict[int, np.ndarray], chain: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the mentions that become spans."""
    if all(n["label"] == OTHER for n in nodes) or all(n["label"] != OTHER for n in nodes):
        return []
    steps, skips = edges_of(nodes)
    part = list(range(len(nodes)))

    def root(k: int) -> int:
        while part[k] != k:
            part[k] = part[part[k]]
            k = part[k]
        return k

    for a, b in skips:
        part[root(a)] = root(b)
    held = {root(k) for k, n in enumerate(nodes) if n["label"] != OTHER}
    live = [k for k in range(len(nodes)) if root(k) in held]
    if all(nodes[k]["label"] != OTHER for k in live):
        return []
    index = {k: i for i, k in enumerate(live)}
    own = np.stack([unary.get(nodes[k]["pattern"], np.zeros(len(LABELS))) for k in live])
    for i, k in enumerate(live):
        if nodes[k]["label"] != OTHER:  # observed
            own[i] = np.where(np.arange(len(LABELS)) == nodes[k]["label"], 0, _CLAMP)
    links = [(index[a], index[b], chain) for a, b in steps if a in index and b in index]
    belief = beliefs(own, links + [(index[a], index[b], odds * np.eye(len(LABELS))) for (a, b), odds in skips.items() if a in index])
    out = []
    for i, k in enumerate(live):
        if nodes[k]["label"] == OTHER and (kind := int(belief[i].argmax())) != OTHER and belief[i, kind] >= BELIEF:
            out.append((nodes[k]["start"], kind, nodes[k]["end"]))
    return out


def _settled(unary: dict[int, np.ndarray], chain: np.ndarray) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = [[{"start": a, "kind": k, "end": b} for a, k, b in settle(s.as_py(), unary, chain)] for s in batch.column("nodes")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(added, pa.list_(_SPAN))], ["doc_id", "base", "added"])

    return run


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, base and added, arrays of (start, kind, end); kind counts along ``KINDS``.

    A null text counts as empty and has no spans; so has a text without personal data.  Rows that repeat an id or a text,
    or have no id, are each scanned and returned; they count once each in the potentials.  Very long texts are scanned
    whole, in time that follows their length.  An empty table gives no rows.  Further columns are not looked at.  The
    potentials are some hundred numbers, whatever the documents.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = cut(rows.mapInArrow(_scan, f"doc_id {kind}, base {_SPANS}, nodes {_NODES}"), "mentions")
    node = scanned.select(F.explode("nodes").alias("n"))
    patterns = {(r.pattern, r.label): r.n for r in node.groupBy("n.pattern", "n.label").agg(F.count(F.lit(1)).alias("n")).collect()}
    label = F.transform("nodes", lambda n: n["label"])
    pair = scanned.select(F.explode(F.arrays_zip(label.alias("a"), F.slice(label, 2, 1 << 30).alias("b"))).alias("p")).where("p.b is not null")
    pairs = {(r.a, r.b): r.n for r in pair.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).collect()}
    return scanned.mapInArrow(_settled(*potentials(patterns, pairs)), f"doc_id {kind}, base {_SPANS}, added {_SPANS}")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.concat("base", "added")).alias("spans"))
