"""A Merkle manifest of documents: a tree over each source's rows, and one over the sources' roots.

The nodes not yet used form a sparse forest, a set keyed by tree, level and index. Two forests merge by union, and wherever all
siblings of a run are there (their number is known, since the tree's size is), their parent takes their place; the order of merges
does not matter. Every partition folds its rows, which follow each other in the order of their trees, to the few nodes at its edges, and a tree of merges
leaves the root. The nodes that merges made and those at the partitions' edges are kept: with them each partition recomputes all proofs of its rows alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ARITY = 3
#: Rows of a partition, about.
ROWS = 100_000
#: The tree over the sources' roots; the others are numbered by their source's rank.
TOP = -1
_NODE = np.dtype([("tree", "<i8"), ("n", "<i8"), ("level", "<i4"), ("index", "<i8"), ("digest", "V32"), ("made", "?")])


def digest_of(parts: list[bytes]) -> bytes:
    """SHA-256 of digests as hex text, as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf(text: Column, doc_id: Column, source: Column, lang: Column, n_chars: Column) -> Column:
    """A row's hash (binary): each field as its UTF-8 length, a colon and itself, or a dash for null."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    fields = [told(c) for c in (doc_id.cast("string"), source, lang, n_chars.cast("string"), text)]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


# --- the forest ---------------------------------------------------------------------------------


def climb(lo: int, nodes: list, n: int, arity: int = ARITY) -> list[tuple[int, list]]:
    """Of each level of a tree of n leaves the nodes that follow from neighbouring leaves alone: the first one's index, and all."""
    out = [(lo, nodes)]
    while n > 1:
        hi, up = lo + len(nodes), -(-n // arity)
        first = -(-lo // arity)
        last = max(first, up if hi == n else hi // arity)
        nodes = [digest_of(nodes[r * arity - lo : r * arity + arity - lo]) for r in range(first, last)]
        lo, n = first, up
        out.append((lo, nodes))
    return out


def edges(levels: list[tuple[int, list]], arity: int = ARITY) -> Iterator[tuple[int, int, bytes]]:
    """Level, index and digest of the nodes that have no parent in these levels."""
    for level, (lo, nodes) in enumerate(levels):
        up = levels[level + 1] if level + 1 < len(levels) else (0, [])
        covered = range(up[0] * arity, (up[0] + len(up[1])) * arity) if up[1] else ()
        if not covered:
            yield from ((level, lo + i, x) for i, x in enumerate(nodes))
        else:
            yield from ((level, i, nodes[i - lo]) for i in range(lo, min(covered[0], lo + len(nodes))))
            yield from ((level, i, nodes[i - lo]) for i in range(max(lo, covered[-1] + 1), lo + len(nodes)))


class Forest:
    """Unresolved nodes by (tree, level, index), and the trees' sizes; ``made`` are the nodes that this task or round added."""

    def __init__(self, arity: int = ARITY):
        self.arity, self.nodes, self.sizes, self.made = arity, {}, {}, []

    def add(self, tree: int, n: int, level: int, index: int, digest: bytes) -> None:
        self.nodes[tree, level, index] = digest
        self.sizes[tree] = n

    def settle(self, top: int) -> None:
        """Puts parents in place of all runs that are whole; a tree's root is a leaf of the tree over all ``top`` trees."""
        work = list({(t, level, i // self.arity) for t, level, i in self.nodes})
        while work:
            tree, level, run = work.pop()
            n = self.sizes[tree]
            for _ in range(level):
                n = -(-n // self.arity)
            own = [(tree, level, i) for i in range(run * self.arity, min(run * self.arity + self.arity, n))]
            if not all(k in self.nodes for k in own) or n == 1 and tree == TOP:
                continue
            if n == 1:
                key, digest, size = (TOP, 0, tree), self.nodes.pop(own[0]), top
            else:
                key, digest, size = (tree, level + 1, run), digest_of([self.nodes.pop(k) for k in own]), self.sizes[tree]
            self.add(key[0], size, *key[1:], digest)
            self.made.append((*key, digest))
            work.append((key[0], key[1], key[2] // self.arity))

    def merge(self, blob: bytes) -> Forest:
        for r in np.frombuffer(blob, _NODE):
            if not r["made"]:
                self.add(int(r["tree"]), int(r["n"]), int(r["level"]), int(r["index"]), r["digest"].tobytes().hex().encode())
        return self

    def dump(self) -> bytes:
        rows = [(t, self.sizes[t], level, i, bytes.fromhex(d.decode()), False) for (t, level, i), d in self.nodes.items()]
        rows += [(t, self.sizes.get(t, 0), level, i, bytes.fromhex(d.decode()), True) for t, level, i, d in self.made]
        return np.array(rows, _NODE).tobytes()


# --- places -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """A partition's place: the rank of its first source, the leaves of that source before it, its sources, the leaves that it has of
    its first and of its last source, and the leaves of these in all."""

    rank: int
    start: int
    sources: int
    first: int
    last: int
    n_first: int
    n_last: int

    def tree(self, k: int, own: int) -> tuple[int, int]:
        """Index of the first leaf here of the k-th source, and that source's leaves in all; it has ``own`` here."""
        return self.start if k == 0 else 0, self.n_first if k == 0 else self.n_last if k == self.sources - 1 else own

    def roots(self) -> tuple[int, int]:
        """Ranks of the sources that are here with all their leaves."""
        lo = self.rank + (self.first < self.n_first)
        hi = self.rank + self.sources - (self.last < self.n_last)
        return (lo, hi) if lo < hi else (lo, lo)


def spans(a: int, b: int, n: int, arity: int = ARITY) -> Iterator[tuple[int, int]]:
    """Of each level with siblings the first and the end of the nodes in the runs above the leaves from a to b - 1."""
    b -= 1
    while n > 1:
        yield a // arity * arity, min(n, b // arity * arity + arity)
        a, b, n = a // arity, b // arity, -(-n // arity)


def wanted(p: Part, top: int, arity: int = ARITY) -> Iterator[tuple[int, int, int]]:
    """The nodes that a partition's proofs take from elsewhere."""
    out = set()

    def tree(key: int, a: int, b: int, lo: int, hi: int, n: int) -> None:
        """Of the nodes over leaves a to b - 1 those that do not follow from the leaves lo to hi - 1."""
        for level, (s, e) in enumerate(spans(a, b, n, arity)):
            out.update((key, level, i) for i in range(s, e) if not lo <= i < hi)
            up = -(-n // arity)
            lo, hi, n = -(-lo // arity), (up if hi == n else hi // arity) if hi > lo else 0, up

    tree(p.rank, p.start, p.start + p.first, p.start, p.start + p.first, p.n_first)
    if p.sources > 1:
        tree(p.rank + p.sources - 1, 0, p.last, 0, p.last, p.n_last)
    tree(TOP, p.rank, p.rank + p.sources, *p.roots(), top)
    lo, hi = p.roots()
    out.update((TOP, 0, r) for r in (p.rank, p.rank + p.sources - 1) if not lo <= r < hi)
    yield from out


# --- the manifest -------------------------------------------------------------------------------

_PLACED = "part int, k int, pos long, own long, source string, doc_id long, leaf binary, seen binary"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their sources with the number of their source in the partition (k), their place in it and its rows here (own)."""
    part, k, held, last = TaskContext.get().partitionId(), 0, [], None

    def out():
        rows = pa.Table.from_batches(held).combine_chunks()
        n = rows.num_rows
        same = lambda x, t: pa.array(np.full(n, x), t)
        columns = [same(part, pa.int32()), same(k, pa.int32()), pa.array(np.arange(n)), same(n, pa.int64()), *(rows[c] for c in ("source", "doc_id", "leaf", "seen"))]
        yield from pa.table(columns, [c.split()[0] for c in _PLACED.split(", ")]).to_batches(max_chunksize=10_000)

    for b in batches:
        if not b.num_rows:
            continue
        names = b.column(0).to_pylist()
        cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, len(names)], strict=True):
            if held and names[lo] != last:
                yield from out()
                k, held = k + 1, []
            held.append(b.slice(lo, hi - lo))
            last = names[lo]
    if held:
        yield from out()


def _hexes(column: pa.Array) -> list[bytes | None]:
    return [None if x is None else x.hex().encode() for x in column.to_pylist()]


@dataclass(frozen=True)
class Manifest:
    """``root`` (hex; None for an empty table), the placed rows, and the nodes (tree, level, index, digest) above the partitions' edges."""

    root: str | None
    sources: int
    arity: int
    placed: DataFrame
    nodes: DataFrame
    parts: DataFrame

    def proofs(self) -> DataFrame:
        """Of each row doc_id, leaf, subroot (its source's), root, its place (source's rank, index), and the siblings level by level, from
        the leaf's via the subroot to the root, each left to right (``at`` is the place between them)."""
        return self._each(_siblings, "doc_id long, leaf string, subroot string, root string, source_rank long, index long, siblings array<struct<at:int,run:array<string>>>")

    def verified(self) -> DataFrame:
        """Of each row doc_id, leaf, subroot, root, the hash of its siblings, the root that the row as it was seen folds to with them, and
        whether that is the root."""
        return self._each(_folds, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    def _each(self, form: Callable, schema: str) -> DataFrame:
        spark, root, top, arity = self.placed.sparkSession, self.root, self.sources, self.arity
        if root is None:
            return spark.createDataFrame([], schema)

        def want(batches):
            for b in batches:
                for r in b.to_pylist():
                    keys = sorted(wanted(Part(**{c: r[c] for c in _FIELDS}), top, arity))
                    if keys:
                        t, level, i = zip(*keys, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(keys), pa.int32()), pa.array(t, pa.int64()), pa.array(level, pa.int32()), pa.array(i, pa.int64())], ["part", "tree", "level", "index"])

        keys = ["tree", "level", "index"]
        got = self.parts.mapInArrow(want, "part int, tree long, level int, index long").join(self.nodes, keys)
        # A partition's place comes first, then the nodes it takes from elsewhere (few), then its rows in order.
        none = lambda t: F.lit(None).cast(t)
        place = F.array(*[F.col(c).cast("long") for c in _FIELDS])
        head = self.parts.select("part", F.lit(0).alias("what"), none("int").alias("k"), none("long").alias("pos"), none("long").alias("doc_id"), none("binary").alias("leaf"), none("binary").alias("seen"), place.alias("told"))
        near = got.select("part", F.lit(1).alias("what"), none("int"), none("long"), none("long"), F.col("digest"), none("binary"), F.array("tree", F.col("level").cast("long"), "index"))
        rows = self.placed.select("part", F.lit(2).alias("what"), "k", "pos", "doc_id", "leaf", "seen", none("array<long>"))
        every = head.union(near).union(rows).repartitionByRange(max(1, self.parts.count()), "part").sortWithinPartitions("part", "what", "k", "pos")
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            held = None
            for b in batches:
                parts, what = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = np.flatnonzero(np.diff(parts) | np.diff(what)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)], strict=True):
                    if lo == hi:
                        continue
                    s = b.slice(lo, hi - lo)
                    if what[lo] == 0:
                        if held:
                            yield from _told(held, top, arity, root, form, schema, names)
                        held = (Part(*s.column(7).to_pylist()[0]), {}, [])
                    elif what[lo] == 1:
                        held[1].update(zip(map(tuple, s.column(7).to_pylist()), _hexes(s.column(5)), strict=True))
                    else:
                        held[2].append(s.select(["k", "pos", "doc_id", "leaf", "seen"]))
            if held:
                yield from _told(held, top, arity, root, form, schema, names)

        return every.mapInArrow(run, schema)


def _told(held: tuple, top: int, arity: int, root: str, form: Callable, schema: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The proofs of a partition's rows: all nodes above them are computed from the rows or taken from elsewhere."""
    p, got, batches = held
    rows = pa.Table.from_batches(batches).combine_chunks()
    k = rows["k"].to_numpy()
    cuts = np.flatnonzero(np.diff(k)) + 1
    leaves, seen, ids = _hexes(rows["leaf"]), _hexes(rows["seen"]), rows["doc_id"].to_pylist()

    def above(tree: int, a: int, b: int, n: int, levels: list) -> list[tuple[int, list]]:
        out = []
        for level, (s, e) in enumerate(spans(a, b, n, arity)):
            lo, own = levels[level]
            out.append((s, [own[i - lo] if lo <= i < lo + len(own) else got[tree, level, i] for i in range(s, e)]))
        return out

    trees, roots = [], {}
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
        start, n = p.tree(int(k[lo]), hi - lo)
        rank = p.rank + int(k[lo])
        levels = climb(start, leaves[lo:hi], n, arity)
        roots[rank] = levels[-1][1][0] if hi - lo == n else got[TOP, 0, rank]
        trees.append((rank, lo, hi, start, above(rank, start, start + hi - lo, n, levels)))
    first, end = p.roots()
    over = above(TOP, p.rank, p.rank + p.sources, top, climb(first, [roots[r] for r in range(first, end)], top, arity))
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<struct<at:int,run:array<string>>>": pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]
    out = []
    for rank, lo, hi, start, own in trees:
        for told in form(ids[lo:hi], leaves[lo:hi], seen[lo:hi], start, own, rank, over, arity, root, roots[rank].decode()):
            out.append(told)
            if len(out) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _run(level: tuple[int, list], i: int, arity: int) -> tuple[list, int]:
    """The run of a node, and its place in it."""
    at = i % arity
    lo = i - at - level[0]
    return level[1][lo : lo + arity], at


def _siblings(ids, leaves, seen, start, own, rank, over, arity, root, subroot) -> Iterator[tuple]:
    def path(levels: list, i: int) -> list[dict]:
        out = []
        for level in levels:
            run, at = _run(level, i, arity)
            out.append({"at": at, "run": [x.decode() for j, x in enumerate(run) if j != at]})
            i //= arity
        return out

    high = path(over, rank)
    for j, (key, x) in enumerate(zip(ids, leaves, strict=True)):
        yield key, x.decode(), subroot, root, rank, start + j, path(own, start + j) + high


def fold(digest: bytes, levels: list[tuple[int, list]], i: int, arity: int = ARITY) -> bytes:
    """The root that follows from a node and the siblings above it."""
    for level in levels:
        run, at = _run(level, i, arity)
        digest = digest_of([*run[:at], digest, *run[at + 1 :]])
        i //= arity
    return digest


def _folds(ids, leaves, seen, start, own, rank, over, arity, root, subroot) -> Iterator[tuple]:
    last: list[tuple[int, bytes]] = [(-1, b"")] * (len(own) + 1)  # of each level the node met last, and all siblings from there on
    beside = lambda level, i: b"".join(x for j, x in enumerate(_run(level, i, arity)[0]) if j != i % arity)
    high, at = b"", rank
    for level in over:
        high += beside(level, at)
        at //= arity

    def onward(d: int, i: int) -> bytes:
        if d == len(own):
            return high
        if last[d][0] != i:
            last[d] = (i, beside(own[d], i) + onward(d + 1, i // arity))
        return last[d][1]

    for j, (key, x, y) in enumerate(zip(ids, leaves, seen, strict=True)):
        folded = fold(fold(y, own, start + j, arity), over, rank, arity).decode()
        yield key, x.decode(), subroot, root, hashlib.sha256(onward(0, start + j)).hexdigest(), folded, folded == root


_FIELDS = ("rank", "start", "sources", "first", "last", "n_first", "n_last")


def _parts(placed: DataFrame) -> list[dict]:
    """Each partition's place, from a row per partition: which sources go on from one to the next tells the rest."""
    per = placed.filter("pos = 0").groupBy("part").agg(F.max("k").alias("k"), F.max_by("own", F.negative("k")).alias("first"), F.max_by("own", "k").alias("last"), F.max_by("source", F.negative("k")).alias("a"), F.max_by("source", "k").alias("b"))
    rows, rank, before, name = [], -1, 0, None
    for r in sorted(per.collect(), key=lambda r: r["part"]):  # a row per partition
        goes_on = rank >= 0 and r["a"] == name
        rank += not goes_on
        rows.append({"part": r["part"], "rank": rank, "start": before if goes_on else 0, "sources": r["k"] + 1, "first": r["first"], "last": r["last"]})
        before = (before if goes_on and not r["k"] else 0) + r["last"]
        rank, name = rank + r["k"], r["b"]
    after, last = 0, None  # leaves after a partition's end of its last source
    for r in reversed(rows):
        end = r["rank"] + r["sources"] - 1
        r["n_last"] = (0 if r["sources"] > 1 else r["start"]) + r["last"] + (after if last == end else 0)
        r["n_first"] = r["n_last"] if r["sources"] == 1 else r["start"] + r["first"]
        after = (after if last == r["rank"] and r["sources"] == 1 else 0) + r["first"]
        last = r["rank"]
    return rows


def build(docs: DataFrame, seen: Column | None = None, arity: int = ARITY, rows: int = ROWS) -> Manifest:
    """The manifest of rows (doc_id, source, lang, n_chars, text); ``seen`` is the text as it is found now, if that may differ.

    Nulls hash as such. Leaves of a source stand by doc_id (null first), rows with one id by their hash, so that equal rows
    are interchangeable; sources stand by their UTF-8 bytes, null first. Rows are ranged by all of these and a running number, so that no
    source, id or repeated row fills a task. Texts are read once and hashed whole; only hashes are shuffled. Other columns are ignored.
    """
    spark = docs.sparkSession
    as_is = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own = leaf(F.col("text"), *as_is)
    hashed = common.stored(docs.select("doc_id", "source", own.alias("leaf"), (own if seen is None else leaf(seen, *as_is)).alias("seen")))
    total = hashed.count()
    if not total:
        return Manifest(None, 0, arity, hashed, hashed, hashed)
    order = ["source", "doc_id", "leaf"]
    ranged = hashed.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(max(common.partitions(hashed), -(-total // rows)), *order, "salt").sortWithinPartitions(*order)
    placed = common.stored(ranged.select("source", "doc_id", "leaf", "seen").mapInArrow(_place, _PLACED))
    told = _parts(placed.withColumn("source", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))))
    top = told[-1]["rank"] + told[-1]["sources"]
    known = spark.sparkContext.broadcast({r["part"]: Part(**{c: r[c] for c in _FIELDS}) for r in told})  # seven numbers per partition

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes that this task's rows leave unresolved; it may have several partitions' rows, or some of one's."""
        forest, held, at = Forest(arity), [], None

        def close():
            (part, k), (pos, size) = at, held[0]
            start, n = known.value[part].tree(k, size)
            rank = known.value[part].rank + k
            levels = climb(start + pos, [x for _, x in held[1:]], n, arity)
            for level, i, x in edges(levels, arity):
                forest.add(rank, n, level, i, x)

        for b in batches:
            for part, k, pos, size, x in zip(*(b.column(i).to_pylist() for i in range(4)), _hexes(b.column(4)), strict=True):
                if (part, k) != at or pos != held[-1][0] + 1:
                    if held:
                        close()
                    at, held = (part, k), [(pos, size)]
                held.append((pos, x))
        if held:
            close()
            forest.made = [(*key, x) for key, x in forest.nodes.items()]  # what lies at the partitions' edges
            forest.settle(top)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([forest.dump()], pa.binary())], ["part", "blob"])

    def merged(held: Forest | None, blob: bytes) -> Forest:
        held = (held or Forest(arity)).merge(blob)
        held.settle(top)
        return held

    leaves = placed.select("part", "k", "pos", "own", "leaf")
    rounds = common.reduce_rounds(leaves.mapInArrow(fragments, "part int, blob binary"), merged, Forest.dump, leaves.rdd.getNumPartitions())

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(1).to_pylist():
                a = np.frombuffer(blob, _NODE)
                a = a[a["made"]]
                yield pa.RecordBatch.from_arrays([pa.array(a["tree"]), pa.array(a["level"]), pa.array(a["index"]), pa.array([x.tobytes() for x in a["digest"]], pa.binary())], ["tree", "level", "index", "digest"])

    every = reduce(DataFrame.union, (r.mapInArrow(made, "tree long, level int, index long, digest binary") for r in rounds))
    last = Forest(arity)
    for r in rounds[-1].collect():  # one row with one node
        last = merged(last, r["blob"])
    ((_, root),) = last.nodes.items()
    fields = ", ".join(f"{c} long" for c in _FIELDS)
    parts = spark.createDataFrame([(r["part"], *(int(r[c]) for c in _FIELDS)) for r in told], f"part int, {fields}")
    return Manifest(root.decode(), top, arity, placed.drop("source"), every, parts)
