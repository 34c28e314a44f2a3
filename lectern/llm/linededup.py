"""Line dedup with two Bloom filters.

A first pass over the text puts the hash of every long line into two filters: one for hashes
seen once, one for hashes seen twice. Only the digests of lines whose hash the second filter knows are shuffled;
they are counted exactly and the occurrence to keep is chosen. A third filter holds the ids of documents that lose
lines: only their texts are shuffled, to meet the digests; all others are finished where they are read.
A filter has 8 bits for each line (16 for each id) up to MOST bits; a fuller one only lets more lines be confirmed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of a filter at least and at most (64 MB), bits set per hash, and parts in which filters are merged.
LEAST, MOST, PROBES, PARTS = 1 << 20, 1 << 29, 2, 64
WHITE = " \t\n\x0b\x0c\r"


def _keys(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """All lines, each text's first line, the keys of lines long enough, and their places among the lines."""
    lists = pc.split_pattern(texts, "\n")
    lines, starts = lists.values, lists.offsets.to_numpy().astype(np.int64)
    keys = pc.ascii_lower(pc.utf8_trim(lines, WHITE))
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False))
    return lines, starts, keys.take(pa.array(long)), long


def _wide(n: int) -> int:
    """Bits of a filter that holds n entries of 8 bits each: a power of two."""
    return min(MOST, max(LEAST, 1 << (8 * n).bit_length()))


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bits of each hash, a row per probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([((hashes + np.uint64(j) * step * np.uint64(0x9E3779B1)) % np.uint64(bits)).astype(np.int64) for j in range(PROBES)])


def _known(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = _probes(hashes, 8 * len(bloom))
    return np.all(bloom[bits >> 3] >> (bits & 7).astype(np.uint8) & 1, axis=0)


def _line_hashes(least: int):
    """Of a batch the hashes of its long lines' keys; a line counts once per document."""

    def hashes(chunk: pa.RecordBatch) -> np.ndarray:
        _, starts, keys, long = _keys(common.texts_of(chunk), least)
        row = np.searchsorted(starts, long, side="right")
        own = np.stack([common.hash_strings(keys.to_pylist()), row.astype(np.uint64)], 1)
        return np.unique(own, axis=0)[:, 0] if len(long) else np.zeros(0, np.uint64)

    return hashes


def _id_hashes(chunk: pa.RecordBatch) -> np.ndarray:
    return common.mix64(common.column_of(chunk, "doc_id").to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _filters(hashes_of, bits: int, chunks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for chunk in chunks(batches):
            fresh, n = np.unique(hashes_of(chunk), return_counts=True)
            if not len(fresh):
                continue
            at = _probes(fresh, bits)
            again = at[:, _known(once, fresh) | (n > 1)].ravel()
            np.bitwise_or.at(twice, again >> 3, np.left_shift(1, again & 7).astype(np.uint8))
            at = at.ravel()
            np.bitwise_or.at(once, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        size = bits // 8 // PARTS
        for i in range(PARTS):
            o, t = once[i * size : (i + 1) * size], twice[i * size : (i + 1) * size]
            if o.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(o.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(t.tobytes(), 1)], pa.binary())], ["part", "once", "twice"])

    return run


def _merge(bits: int):
    """Merges the filters' parts that reach a task, sorted by part; twice also has what two filters have once."""
    size = bits // 8 // PARTS

    def row(part, once, twice):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["part", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        for b in batches:
            for part, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield row(now, once, twice)
                    now, once, twice = part, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                o, t = np.frombuffer(zlib.decompress(o), np.uint8), np.frombuffer(zlib.decompress(t), np.uint8)
                twice |= t | (once & o)
                once |= o
        if now is not None:
            yield row(now, once, twice)

    return run


def _bloom(df: DataFrame, hashes_of, bits: int, which: str, chunks) -> np.ndarray:
    """The merged filter of the hashes seen once, or twice, at least (bits / 8 bytes, at most MOST / 8)."""
    parts = df.mapInArrow(_filters(hashes_of, bits, chunks), "part int, once binary, twice binary")
    merged = parts.repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(_merge(bits), "part int, once binary, twice binary")
    out, size = np.zeros(bits // 8, np.uint8), bits // 8 // PARTS
    for r in merged.select("part", F.col(which).alias("bits")).collect():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def twice_filter(docs: DataFrame, least: int = 40) -> np.ndarray:
    """The filter of the hashes of long lines that are seen at least twice."""
    text = F.coalesce("text", F.lit(""))
    lines = F.least(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1, F.floor(F.length(text) / max(1, least)))
    n = docs.agg(F.coalesce(F.sum(lines), F.lit(0))).first()[0]
    return _bloom(docs.select("text"), _line_hashes(least), _wide(n), "twice", common.text_chunks)


def id_filter(ids: DataFrame):
    """Of a table of ids (doc_id) a function that makes functions of batches: those let through the rows (doc_id, ...) whose id is
    among them, and a few others, or else the rest."""
    bits = _bloom(ids.select("doc_id"), _id_hashes, _wide(2 * ids.count()), "once", lambda batches: (b for b in batches if b.num_rows))
    hit = ids.sparkSession.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))

    def pick(among: bool):
        def run(batches):
            bloom = np.frombuffer(zlib.decompress(hit.value), np.uint8)
            for chunk in common.text_chunks(batches):
                key = common.column_of(chunk, "doc_id")
                own = _known(bloom, _id_hashes(pa.RecordBatch.from_arrays([pc.fill_null(key, 0)], ["doc_id"]))) & key.is_valid().to_numpy(zero_copy_only=False)
                if (own == among).any():
                    yield chunk.filter(pa.array(own == among))

        return run

    return pick


def _digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=16).digest()


def dropped_keys(docs: DataFrame, least: int = 40, copies: int = 5) -> DataFrame:
    """doc_id and the digests of the keys whose lines it loses: those found in at least ``copies``
    documents, in all but the one with the largest id. A stored table."""
    seen = docs.sparkSession.sparkContext.broadcast(zlib.compress(twice_filter(docs, least).tobytes(), 1))

    def suspects(batches):
        bloom = np.frombuffer(zlib.decompress(seen.value), np.uint8)
        for chunk in common.text_chunks(batches):
            _, starts, keys, long = _keys(common.texts_of(chunk), least)
            if not len(long):
                continue
            strings = keys.to_pylist()
            hit = np.flatnonzero(_known(bloom, common.hash_strings(strings)))
            if not len(hit):
                continue
            row = np.searchsorted(starts, long[hit], side="right") - 1
            ids = common.column_of(chunk, "doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array([_digest(strings[i]) for i in hit.tolist()], pa.binary())], ["doc_id", "key"])

    found = common.stored(docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(suspects, "doc_id long, key binary").distinct())
    # A table of its own: the join then shuffles both sides, and a key that very many documents hold can be split.
    spread = common.stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("kept")).filter(F.col("n") >= copies).drop("n"))
    return common.stored(found.join(spread, "key").filter("doc_id < kept").groupBy("doc_id").agg(F.collect_set("key").alias("keys")))


def _rebuild(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.text_chunks(batches):
            raw, drops = common.column_of(chunk, "text").to_pylist(), common.column_of(chunk, "keys").to_pylist()
            n, lost, kept = [], [], []
            for text, keys in zip(raw, drops, strict=True):
                lines = (text or "").split("\n")
                n.append(len(lines))
                if keys:
                    gone, stay = set(keys), []
                    for line in lines:
                        key = line.strip(WHITE).translate(_LOWER)
                        if len(key) < least or _digest(key) not in gone:
                            stay.append(line)
                    lost.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                else:
                    lost.append(0)
                    kept.append(text or "")
            yield pa.RecordBatch.from_arrays([common.column_of(chunk, "doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return run


_LOWER = {c: c + 32 for c in range(65, 91)}


def dedup(docs: DataFrame, least: int = 40, copies: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row.

    A null or empty text is one empty line; a text whose lines all go is empty. A line repeated in one
    document counts once there, and the kept document keeps all its copies. Rows with a null id keep
    all lines and are not counted; rows with the same id are one document.
    """
    drops = dropped_keys(docs, least, copies)
    pick = id_filter(drops)
    rebuild, schema = _rebuild(least), "doc_id long, n_lines long, n_dropped long, kept string"

    def whole(batches):
        plain = (pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.list_(pa.binary()))], ["doc_id", "text", "keys"]) for b in pick(False)(batches))
        yield from rebuild(plain)

    texts = common.bounded(docs).select("doc_id", "text")
    met = texts.mapInArrow(pick(True), "doc_id long, text string").join(drops, "doc_id", "left").select("doc_id", "text", "keys")
    return texts.mapInArrow(whole, schema).unionByName(met.mapInArrow(rebuild, schema))
