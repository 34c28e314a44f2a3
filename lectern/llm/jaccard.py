"""N-gram Jaccard self-join by MinHash banding.

Texts with equal word sequences form classes, of which one represents all. Representatives' signatures
are cut into bands, whose numbers and rows are chosen for a target recall; band hashes are shuffled, and a
representative joins the unit of the least id it shares a bucket with. Blocks of bounded size, one for each
unit and one for each two units that meet in a bucket, verify pairs on their full n-gram sets by matrix
products, without ever making a row per pair: a block yields each member's number of links and the edges that
hold its groups together. Groups are components of verified links, so unverified candidates never chain; a
group that lies in several units is then verified once more as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, linededup

THRESHOLD, RECALL, FUNCTIONS = 0.8, 0.9995, 100
#: Shingles and members of a chunk of candidates; a block verifies two chunks against each other.
CHUNK_SHINGLES, CHUNK_MEMBERS = 1 << 19, 256


def _bands(k: int, bands: int, rows: int, sign=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.text_chunks(batches):
            words, starts = common.word_hashes(common.texts_of(chunk))
            hashes, first = common.shingles(words, starts)
            signature = sign(hashes, first) if sign else common.signatures(hashes, first, k)
            n = np.diff(first)
            folded = np.zeros((len(n), bands), np.uint64)
            for j in range(bands):
                for r in range(rows):
                    folded[:, j] = common.mix64(folded[:, j] * np.uint64(0x9E3779B97F4A7C15) + signature[:, j * rows + r] + np.uint64(j + 1))
            raw = words.tobytes()
            keys = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            flat = pa.array(folded.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(n) + 1, bands, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([common.column_of(chunk, "row"), pa.array(keys, pa.binary()), pa.array(n), lists], ["row", "words", "n_shingles", "bands"])

    return run


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the least node of its connected component.

    Alternates large-star and small-star steps, each written to the shared folder, until nothing changes; the
    rounds grow with the logarithm of a component's length, and more than ``limit`` are an error.
    """
    edges = common.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A table of its own: the join then shuffles both sides, and a node with many edges can be split by AQE.
        least = common.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m")))
        large = edges.join(least, "b").select("a", F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = common.stored(large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct().filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())
        # A star forest has one edge from each node, and none from a centre.
        tops = edges.groupBy("a").count().filter("count > 1").limit(1).count()
        if not tops and (now == last or not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()):
            break
        last = now
    else:
        raise RuntimeError(f"components did not come to rest in {limit} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray], step: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of every set with every other one, over slices of their shingles."""
    every = np.unique(np.concatenate([*sets, *others])) if sets and others else np.zeros(0, np.uint64)
    out = np.zeros((len(sets), len(others)), np.float32)
    left, right = ([np.searchsorted(every, s) for s in side] for side in (sets, others))
    for lo in range(0, len(every), step):
        a, b = (np.zeros((len(side), min(step, len(every) - lo)), np.float32) for side in (left, right))
        for m, side in ((a, left), (b, right)):
            for i, s in enumerate(side):
                x, y = np.searchsorted(s, (lo, lo + step))
                m[i, s[x:y] - lo] = 1
        out += a @ b.T
    return out


def _verify(threshold: float):
    """Blocks, sorted by key, of rows (i, j, chunk, rep, copies, text): the pairs of chunk i with chunk j."""

    def block(rows: list[tuple]) -> list[tuple]:
        i, j = rows[0][:2]
        texts = pa.array([r[5] for r in rows])
        hashes, first = common.shingles(*common.word_hashes(texts))
        sets = [np.unique(hashes[first[x] : first[x + 1]]) for x in range(len(rows))]
        a = [x for x, r in enumerate(rows) if r[2] == i]
        b = a if i == j else [x for x, r in enumerate(rows) if r[2] == j]
        if not a or not b:
            return []
        common_ = _overlaps([sets[x] for x in a], [sets[x] for x in b])
        sizes = np.array([len(s) for s in sets], np.float32)
        union = sizes[a][:, None] + sizes[b][None, :] - common_
        linked = common_ >= threshold * union - 1e-4
        if i == j:
            np.fill_diagonal(linked, False)
        reps, copies = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        out: dict[int, list] = {}
        for x, n in zip(reps[a], linked @ copies[b], strict=True):
            out[int(x)] = [int(x), int(n), int(x)]
        if i != j:
            for x, n in zip(reps[b], linked.T @ copies[a], strict=True):
                out[int(x)] = [int(x), int(n), int(x)]
        # Groups inside the block: the least label spreads over links until it rests.
        nodes = np.concatenate([reps[a], reps[b]]) if i != j else reps[a]
        label = nodes.copy()
        full = linked if i == j else np.block([[np.zeros((len(a), len(a)), bool), linked], [linked.T, np.zeros((len(b), len(b)), bool)]])
        while True:
            low = np.where(full, label[None, :], np.iinfo(np.int64).max).min(axis=1)
            new = np.minimum(label, low)
            if (new == label).all():
                break
            label = new
        for x, root in zip(nodes, label, strict=True):
            out[int(x)][2] = int(root)
        return [tuple(v) for v in out.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    done += block(held)
                    held = []
                held.append(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], ["rep", "links", "root"])
                done = []
        if held and (done := block(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], ["rep", "links", "root"])

    return run


def _chunked(members: DataFrame) -> DataFrame:
    """rep, copies, n_shingles, component, chunks and unit of the members: a component's are dealt by a hash to chunks of bounded size,
    and unit is a chunk's number among all."""
    least = CHUNK_SHINGLES // CHUNK_MEMBERS
    large = members.groupBy("component").agg(F.ceil(F.sum(F.greatest("n_shingles", F.lit(least))) / CHUNK_SHINGLES).cast("int").alias("chunks")).filter("chunks > 1")
    sized = members.join(large, "component", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return sized.select("rep", "copies", "n_shingles", "component", "chunks", F.xxhash64("component", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).alias("unit"))


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the classes (rep, copies, n_shingles, bands) that share a bucket: their units (_chunked's columns; a component is the classes with the
    same least neighbour), and the rows (rep, copies, i, j, chunk) of blocks. A class is in its unit's block, and in one more for each other
    unit that it meets in a bucket: the rows grow with the buckets' members, whatever chains they form."""
    buckets = classes.filter("n_shingles > 0").select("rep", F.posexplode("bands").alias("band", "hash"))
    shared = buckets.groupBy("band", "hash").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = common.stored(buckets.join(shared, ["band", "hash"]))
    labels = met.groupBy("rep").agg(F.min("least").alias("component"))
    units = common.stored(_chunked(common.stored(labels.join(classes.select("rep", "copies", "n_shingles"), "rep"))))
    placed = common.stored(met.drop("least").join(units.select("rep", "copies", "unit"), "rep"))
    several = placed.groupBy("band", "hash").agg(F.min("unit").alias("low"), F.max("unit").alias("high")).filter("low <> high").select("band", "hash")
    mixed = common.stored(placed.join(several, ["band", "hash"], "left_semi"))
    # Tables of their own: the join then shuffles both sides, and a bucket with many members can be split by AQE.
    others = common.stored(mixed.select("band", "hash", F.col("unit").alias("other")).distinct())
    # Buckets of the same units are one meeting: the bands of a large group mostly hold the same ones, and each would make the same rows.
    meeting = ["n", "x", "y"]
    meetings = common.stored(others.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("other").alias("x"), F.bit_xor(F.xxhash64("other")).alias("y")))
    there = common.stored(mixed.join(meetings, ["band", "hash"]).select("rep", "copies", "unit", *meeting).distinct())
    held = common.stored(others.join(meetings, ["band", "hash"]).select("other", *meeting).distinct())
    crossing = there.join(held, meeting).filter("unit <> other").select("rep", "copies", "unit", "other").distinct()
    rows = units.select("rep", "copies", "unit", F.col("unit").alias("other")).unionByName(crossing)
    return units, rows.select("rep", "copies", F.least("unit", "other").alias("i"), F.greatest("unit", "other").alias("j"), F.col("unit").alias("chunk"))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, functions: int = FUNCTIONS, sign=None) -> DataFrame:
    """One row per document: ``text_class`` (least doc_id with the same words), ``class_id`` (least doc_id of
    the group that links hold together) and ``n_links``, the number of other documents whose n-gram sets
    (five lower-cased words; fewer words are one n-gram) have a Jaccard similarity at the threshold or above.

    Texts without words (null, empty, blank) are all linked with each other. Rows without an id are left
    out. Rows that share an id count as documents of their own in ``n_links``, whatever their texts. sign: other
    signatures of shingles and texts' first ones than this module's.
    """
    return _grouped(docs, threshold, recall, functions, sign).select("doc_id", "text_class", "class_id", "n_links")


def _grouped(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, functions: int = FUNCTIONS, sign=None) -> DataFrame:
    """join's rows with the digest of their words, the number of their class (rep) and that of their group's first class (root)."""
    bands, rows = common.choose_bands(threshold, recall, functions)
    k = bands * rows
    n = common.partitions(docs)
    usable = common.bounded(docs).filter("doc_id is not null")
    signed = common.stored(usable.select(F.col("doc_id").alias("row"), "text").mapInArrow(_bands(k, bands, rows, sign), "row long, words binary, n_shingles long, bands array<long>"))
    classes = common.stored(signed.groupBy("words").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "n_shingles", "bands")).alias("own")).select("words", "least", "copies", "own.n_shingles", "own.bands"))
    # A class's number: its least id, or if two classes share one, their place in order of id and words.
    mixed = _repeats(classes, "least")
    classes = _numbered(classes) if mixed else classes.withColumn("rep", F.col("least"))
    units, blocks = _candidates(classes)
    # A representative's text: of rows that share its id, one with its words. Only the texts of representatives are shuffled.
    wanted = units.select("rep")
    wanted = common.stored(wanted.join(classes.select("rep", "least", "words"), "rep") if mixed else wanted)
    pick = linededup.id_filter(wanted.select(F.col("least" if mixed else "rep").alias("doc_id")))
    texts = usable.select("doc_id", "text").mapInArrow(pick(True), "doc_id long, text string")
    if mixed:
        told = texts.mapInArrow(_digests, "least long, words binary, text string").join(wanted, ["least", "words"]).select("rep", "text")
    else:
        told = texts.withColumnRenamed("doc_id", "rep").join(wanted, "rep", "left_semi")
    one = common.stored(told.groupBy("rep").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")) if _repeats(usable, "doc_id") else told)

    def verified(blocks: DataFrame) -> DataFrame:
        dealt = blocks.join(one, "rep").select("i", "j", "chunk", "rep", "copies", "text")
        return common.stored(dealt.repartition(n, "i", "j").sortWithinPartitions("i", "j", "rep").mapInArrow(_verify(threshold), "rep long, links long, root long"))

    checked = verified(blocks)
    groups = common.stored(components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep"))
    # Groups of one unit are told by its own block; of the others all pairs are verified, those without a common bucket too.
    held = common.stored(groups.join(units, "rep"))
    wide = held.groupBy("root").agg(F.min("unit").alias("low"), F.max("unit").alias("high")).filter("low <> high").select("root")
    again = common.stored(_chunked(held.join(wide, "root", "left_semi").select("rep", F.col("root").alias("component"), "copies", "n_shingles")))
    others = again.withColumn("other", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.xxhash64("component", c))))
    whole = verified(others.select("rep", "copies", F.least("unit", "other").alias("i"), F.greatest("unit", "other").alias("j"), F.col("unit").alias("chunk")))
    linked = checked.join(again.select("rep"), "rep", "left_anti").unionByName(whole).groupBy("rep").agg(F.sum("links").alias("links"))
    if mixed:  # a group's number is that of its first class; its id is that class's least one
        firsts = classes.select(F.col("rep").alias("root"), F.col("least").alias("class_id"))
        groups = groups.join(firsts, "root").select("rep", "root", "class_id")
    else:
        groups = groups.withColumn("class_id", F.col("root"))
    told = classes.select("words", "rep", "least", "copies").join(linked, "rep", "left").join(groups, "rep", "left")
    told = told.select("words", "rep", F.coalesce("root", "rep").alias("root"), F.col("least").alias("text_class"), F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select(F.col("row").alias("doc_id"), "words").join(told, "words")


def _repeats(df: DataFrame, column: str) -> bool:
    """Whether a value occurs twice."""
    return bool(df.groupBy(column).count().filter("count > 1").limit(1).count())


def _word_digests(chunk: pa.RecordBatch) -> pa.Array:
    words, starts = common.word_hashes(common.texts_of(chunk))
    raw = words.tobytes()
    return pa.array([xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the digest of their words, as classes have it."""
    for chunk in common.text_chunks(batches):
        yield pa.RecordBatch.from_arrays([common.column_of(chunk, "doc_id"), _word_digests(chunk), common.texts_of(chunk)], ["least", "words", "text"])


def _numbered(classes: DataFrame) -> DataFrame:
    """The classes with a number of their own, in order of least id and words: ranges, and places in them."""
    ranged = classes.repartitionByRange("least", "words").withColumn("part", F.spark_partition_id())
    placed = common.stored(ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("least", "words"))))
    before, base = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a row per range
        base.append((r["part"], before))
        before += r["count"]
    return common.stored(placed.join(F.broadcast(classes.sparkSession.createDataFrame(base, "part int, base long")), "part").select(*classes.columns, (F.col("base") + F.col("at")).alias("rep")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, that with the least id (of texts that share it, the first by a digest of their words), with the columns it
    came with. Rows without an id are kept; so are all rows that have the kept one's id and words."""
    name, words = common.free_name(docs), common.free_name(docs, "_words")
    mixed = _repeats(docs.filter("doc_id is not null"), "doc_id")
    keys = [F.col("doc_id").alias(name), *([F.col("words").alias(words)] if mixed else [])]
    lost = common.stored(_grouped(docs, threshold).filter("rep <> root or doc_id <> text_class").select(*keys))
    if not mixed:
        return docs.join(lost, docs["doc_id"] == lost[name], "left_anti")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.text_chunks(batches):
            yield chunk.append_column(f"_{chunk.num_columns}", _word_digests(chunk))

    told = common.mapped(common.bounded(docs), digest, words)
    return told.join(lost, (told["doc_id"] == lost[name]) & (told[words] == lost[words]), "left_anti").drop(words)
