"""MinHash document fingerprints.

A text's word shingles are hashed, and the least values of many universal hash functions over them,
computed in vectorised numpy, make its signature. Signatures' bands are joined in Spark to find similar
documents, whose Jaccard similarity is then verified on the full shingle sets (``similar``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Functions per signature; each value is kept to 16 bits, 4 hex digits of the fingerprint.
FUNCTIONS = 64


def _sign(hashes: np.ndarray, first: np.ndarray, k: int = FUNCTIONS) -> np.ndarray:
    return (common.signatures(hashes, first, k) >> np.uint32(16)).astype(np.uint16)


def signatures_of(texts: pa.Array, k: int = FUNCTIONS) -> np.ndarray:
    words, starts = common.word_hashes(texts)
    return _sign(*common.shingles(words, starts), k)


def as_hex(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal places, an estimate of the Jaccard similarity of the shingle sets."""
    return (a == b).mean(axis=1)


def fingerprint(docs: DataFrame, k: int = FUNCTIONS) -> DataFrame:
    """doc_id and fingerprint of each row. Texts without words (null, empty, blank) share one fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.text_chunks(batches):
            yield pa.RecordBatch.from_arrays([common.column_of(chunk, "doc_id"), pa.array(as_hex(signatures_of(common.texts_of(chunk), k)))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def similar(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row per document with its class among verified similar documents, and its number of links:
    bands of the fingerprints' signatures are joined and Jaccard is verified on full shingle sets."""
    from . import jaccard

    return jaccard.join(docs, threshold, recall, FUNCTIONS, _sign)


# --- neighbours in order of doc_id -------------------------------------------------------------


def _place() -> tuple[Column, Column]:
    """Where a row stands: by id (null first), then by a hash of the text, which cuts an id with many rows into ranges too."""
    return F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64(F.coalesce("text", F.lit("")))


def _cuts(got: list[int]):
    """Number of a row's range by its id and hash; ``got`` are quantiles of the ids. An id that is r of them gets r ranges."""
    ids, times = np.unique(np.array(got, np.int64), return_counts=True)
    first = 1 + np.cumsum(times) - times

    def number(key: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros(len(key), np.int32)
        at = np.searchsorted(ids, key, side="right") - 1
        r = times[at]
        part = np.minimum(((hashed / 2.0**64 + 0.5) * r).astype(np.int64), r - 1)
        return np.where(at < 0, 0, first[at] + np.where(ids[at] == key, part, r - 1)).astype(np.int32)

    return number


def _ranges(docs: DataFrame, n: int):
    """The function that numbers about n ranges, and the first id and hash of each range with documents."""
    key, hashed = _place()
    rows = docs.select(key.alias("key"), hashed.alias("hash"))
    probs = [i / n for i in range(1, n)]
    got = rows.agg(F.percentile_approx("key", F.array(*map(F.lit, probs)), max(10_000, 10 * n)).alias("b")).first()["b"] if probs else []
    number = _cuts(got or [])

    @F.pandas_udf("int")
    def bucket(key: pd.Series, hashed: pd.Series) -> pd.Series:
        return pd.Series(number(key.to_numpy(), hashed.to_numpy()))

    least = rows.withColumn("bucket", bucket("key", "hash")).groupBy("bucket").agg(F.min(F.struct("key", "hash")).alias("m"))
    return number, {r["bucket"]: (r["m"]["key"], r["m"]["hash"]) for r in least.collect()}


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple], k: int) -> pa.RecordBatch | None:
    """rows: (range, copy?, doc_id, text) in order. Each own row is held against the one after it."""
    pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
    if not pairs:
        return None
    own = signatures_of(pa.array([r[3] for r in rows]), k)
    edited = []
    for i in pairs:
        text, follow = rows[i][3], rows[i + 1][3]
        half = len(text) // 2
        edited.append(text[: len(text) - half] + follow[:half])
    other = signatures_of(pa.array(edited), k)
    here, after = own[pairs], own[[i + 1 for i in pairs]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in pairs], pa.int64()),
            pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array(as_hex(here)),
            pa.array(as_hex(other)),
            pa.array(likeness(here, other)),
            pa.array(likeness(here, after)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def against_next(docs: DataFrame, k: int = FUNCTIONS) -> DataFrame:
    """The fingerprint of every text, of its edited text, and their likeness, in one pass over the text.

    The edited text ends with the beginning of the next document's text, by ascending doc_id, after the
    last the first; a sole document is its own next. Null ids come first; rows with one id are ordered by
    xxhash64 of the text, then by text. Rows are cut into ranges in this order, so that rows of one id, or
    without one, are shared out by their texts; only rows alike in both stay together, and are read as a
    stream. The first row of a range is also sent to the one before, so that no task needs more than its range.
    """
    n = common.partitions(docs)
    number, heads = _ranges(docs, 2 * n)
    order = sorted(heads)
    head = np.array([heads[b] for b in order], np.int64).reshape(-1, 2)
    before = np.array([*order[-1:], *order[:-1]], np.int32)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series, hashed: pd.Series) -> pd.Series:
        x, h = key.to_numpy(), hashed.to_numpy()
        own = number(x, h)
        at = np.searchsorted(order, own)
        leads = (head[at, 0] == x) & (head[at, 1] == h)
        return pd.Series([[b, a] if first else [b] for b, a, first in zip(own.tolist(), before[at].tolist(), leads.tolist(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows.append(row)
                size += len(row[3])
                if size > common.CHUNK_BYTES // 4:
                    if (out := _compare(rows, k)) is not None:
                        yield out
                    rows, size = rows[-1:], len(row[3])
        if (out := _compare(rows, k)) is not None:
            yield out

    # The first place is a row's own range, a second one that of its copy.
    key, hashed = _place()
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), hashed.alias("hash"), F.posexplode(places(key, hashed)).alias("copy", "range"))
    dealt = placed.repartition(n, "range").sortWithinPartitions("range", "copy", "doc_id", "hash", "text")
    return dealt.select("range", "copy", "doc_id", "text").mapInArrow(run, _OUT)
