"""Helpers shared by the training-data operators.

Conventions that hold for every operator here:

* only the columns an operator needs are read; extra columns, whatever their names, are ignored
  (stages that return documents keep them);
* a null text counts as the empty text, and an empty table gives an empty result;
* tables between two jobs go to the folder that ``spark.checkpoint.dir`` names, through Spark's own
  writers, so that every executor sees them and the loss of one costs a recomputation only.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes of text that a Python worker handles at a time.
CHUNK_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared one; in local mode a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/lectern-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The frame written as a table in the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of the frame's rows: those of its scan, or the session's if more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def free_name(df: DataFrame, name: str = "_met") -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as it is, points and all."""
    return f"`{name.replace('`', '``')}`"


def hash_key(*names: str):
    """A 64-bit key of a row's identity; null ids hash by what follows them."""
    return F.xxhash64(*names)


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes of text, and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def bounded(df: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """The frame, after its session was told to hand Python workers batches of about ``size`` bytes. Batches
    of 10000 rows of text otherwise take tens of MB on both sides. A smaller setting stays."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)) > size:
        conf.set(key, str(size))
    return df


def mapped(docs: DataFrame, run: Callable, added: str = "") -> DataFrame:
    """mapInArrow with the frame's own columns, whatever their names, and a binary one added behind them if named. The function sees
    doc_id, text, lang and source by their names, and other columns by their places."""
    seen = [c if c in ("doc_id", "text", "lang", "source") else f"_{i}" for i, c in enumerate(docs.columns)]
    fields = [StructField(name, f.dataType) for name, f in zip(seen, docs.schema.fields, strict=True)]
    more = [StructField(f"_{len(seen)}", BinaryType())] if added else []
    return docs.toDF(*seen).mapInArrow(run, StructType([*fields, *more])).toDF(*docs.columns, *([added] if added else []))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and each text's first byte."""
    wide = texts.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = wide.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def reduce_rounds(parts: DataFrame, merge: Callable[[Any, bytes], Any], dump: Callable[[Any], bytes], n: int, fan: int = 32) -> list[DataFrame]:
    """A reduction by a tree: ``parts`` (part int from 0 to n - 1, blob binary) are merged ``fan`` neighbours at a time, in rounds, until
    one is left. ``merge`` takes None or what it gave before, and the next blob; it must not depend on their order. A task holds what it
    merges and one blob. Returns the stored tables: the parts, then those of each round."""
    rounds = [stored(parts.select(F.col("part").cast("int").alias("part"), "blob"))]
    while n > 1:
        n = -(-n // fan)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = held = None
            for b in batches:
                for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if part != at and at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([dump(held)], pa.binary())], ["part", "blob"])
                        held = None
                    at, held = part, merge(held, blob)
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([dump(held)], pa.binary())], ["part", "blob"])

        near = rounds[-1].select(F.floor(F.col("part") / fan).cast("int").alias("part"), "blob")
        rounds.append(stored(near.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, "part int, blob binary")))
    return rounds


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of anything but ASCII white space: all words in order, and each text's first word."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), before[offsets]


def hash_strings(strings: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' lower-cased words, and each text's first word."""
    words, starts = split_words(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    return hash_strings(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64), starts


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, starts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words in a row. A text of one to n-1 words has one shingle, all its words;
    one without words has none. Returns the hashes and each text's first one."""
    counts = np.diff(starts)
    padded = np.where(counts > 0, np.maximum(counts, n), 0)
    begins = np.concatenate(([0], np.cumsum(padded)))
    row = np.zeros(begins[-1], np.uint64)
    if len(words):
        shift = np.repeat(begins[:-1] - starts[:-1], counts)
        row[np.arange(len(words)) + shift] = words
    per_text = np.where(padded > 0, padded - n + 1, 0)
    first = np.concatenate(([0], np.cumsum(per_text)))
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    rolled = np.zeros(len(row) - n + 1, np.uint64)
    for j in range(n):
        rolled += mix64(row[j : j + len(rolled)] + np.uint64(j)) * _ODD[j % len(_ODD)]
    at = np.arange(first[-1]) + np.repeat(begins[:-1] - first[:-1], per_text)
    return mix64(rolled[at]), first


def permutations(k: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of k strongly universal functions from 32 to 32 bits."""
    draw = np.random.default_rng(seed).integers(0, 2**63, (2, k), np.uint64) * np.uint64(2) + np.uint64(1)
    return draw[0], draw[1]


def signatures(hashes: np.ndarray, first: np.ndarray, k: int, step: int = 1 << 15) -> np.ndarray:
    """MinHash: for each text (row) the least value of each of k universal functions over its shingles.
    A text without shingles has the largest value everywhere."""
    a, b = permutations(k)
    out = np.full((len(first) - 1, k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    at = 0
    while at < len(full):
        stop = max(at + 1, int(np.searchsorted(first[full], first[full[at]] + step)))
        own = full[at:stop]
        lo, hi = first[own[0]], first[own[-1] + 1]
        x = hashes[lo:hi] & np.uint64(0xFFFFFFFF)
        cuts = first[own] - lo
        for j in range(k):
            out[own, j] = np.minimum.reduceat((x * a[j] + b[j]) >> np.uint64(32), cuts)
        at = stop
    return out


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows of the fewest functions, at most ``most``, that find a pair at the threshold with
    the given probability; of those the most rows, so that the fewest other pairs become candidates."""
    best = (1, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best
