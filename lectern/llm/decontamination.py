"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so the items' sets cannot be compared with whole documents'.
Items are partitioned by size, and for each size class a document is seen as overlapping windows of twice
that size: an item that occurs in the document then lies within one window, with a Jaccard similarity that
MinHash can find. A window sharing any of the k least values with an item of the class is a candidate,
and every candidate is verified by exact containment of the item's shingles in the document's.

Items are taken in blocks of bounded bytes, which are broadcast, with a pass over the documents for each; documents
are never shuffled. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Functions, bytes of items' texts broadcast at a time, and the words of a shingle.
FUNCTIONS, BLOCK, WORDS = 24, 16 << 20, 5


def _index(items: list, k: int) -> dict:
    """Of a block of items: shingle sets, and for each length of shingle and size class the least values."""
    texts = pa.array([r["text"] or "" for r in items])
    words, starts = common.word_hashes(texts)
    by_length: dict = {}
    for n in range(1, WORDS + 1):
        counts = np.diff(starts)
        own = np.flatnonzero(counts == n if n < WORDS else counts >= n)
        if not len(own):
            continue
        hashes, first = common.shingles(words, starts, n)
        sets = [np.unique(hashes[first[i] : first[i + 1]]) for i in own]
        values = common.signatures(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), k)
        size = np.array([1 << max(0, int(len(s) - 1).bit_length()) for s in sets])
        classes = {}
        for c in np.unique(size):
            at = np.flatnonzero(size == c)
            # For each function the items' least values in order, to look windows' values up in.
            order = np.argsort(values[at], axis=0, kind="stable")
            classes[int(c)] = (np.take_along_axis(values[at], order, axis=0).T.copy(), at[order].T.copy())
        by_length[n] = (sets, [items[i]["item_id"] for i in own], classes)
    return by_length


def _candidates(hashes: np.ndarray, first: np.ndarray, classes: dict, k: int) -> set[tuple[int, int]]:
    """(text, item) for each window with one of an item's least values. Windows are pairs of neighbouring
    runs of ``size`` shingles; a class of twice the size gets its runs' values from pairs of runs."""
    found: set[tuple[int, int]] = set()
    texts = len(first) - 1
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    if not len(full):
        return found
    a, b = common.permutations(k)
    x = hashes & np.uint64(0xFFFFFFFF)
    for j in range(k):
        v = ((x * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32)
        size, runs, begin, owner = 0, None, None, None
        for c in sorted(classes):
            if runs is None:
                per = -(-counts // c)
                owner = np.repeat(np.arange(texts), per)
                begin = np.concatenate(([0], np.cumsum(per)))
                cuts = np.repeat(first[:-1] - begin[:-1] * c, per) + np.arange(begin[-1]) * c
                runs, size = np.minimum.reduceat(v, cuts), c
            while size < c:
                per = -(-np.diff(begin) // 2)
                to = np.concatenate(([0], np.cumsum(per)))
                cuts = np.repeat(begin[:-1] - to[:-1] * 2, per) + np.arange(to[-1]) * 2
                runs, begin, size = np.minimum.reduceat(runs, cuts), to, size * 2
                owner = np.repeat(np.arange(texts), per)
            window = runs.copy()
            same = owner[1:] == owner[:-1]
            window[:-1][same] = np.minimum(runs[:-1][same], runs[1:][same])
            values, at = classes[c]
            lo = np.searchsorted(values[j], window, side="left")
            hi = np.searchsorted(values[j], window, side="right")
            for w in np.flatnonzero(hi > lo):
                found.update((int(owner[w]), int(i)) for i in at[j][lo[w] : hi[w]])
    return found


_OUT = "doc_id long, item_id long, containment double"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = FUNCTIONS) -> DataFrame:
    """doc_id, item_id and containment of every document that holds at least ``threshold`` of an item's
    shingles (five lower-cased words; an item of fewer words is one shingle of them all).

    Items without words (null, blank) and texts without match nothing. Each row of a repeated doc_id or item_id
    counts by itself, and an id pair gets one row, with the greatest containment.
    """
    spark = docs.sparkSession
    parts = None
    items = benchmark.select("item_id", "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK))  # dealt by a hash; a block holds more than its bytes only by one long item
    numbered = common.stored(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")))
    for block in range(blocks):
        held = numbered.filter(F.col("block") == block).collect()
        if not held:
            continue
        shared = spark.sparkContext.broadcast(_index(held, k))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for chunk in common.text_chunks(batches):
                words, starts = common.word_hashes(common.texts_of(chunk))
                ids = common.column_of(chunk, "doc_id").to_pylist()
                rows: list[tuple] = []
                for n, (sets, names, classes) in shared.value.items():
                    # A text of fewer words than the item has none of its shingles.
                    hashes, first = common.shingles(words, starts, n)
                    last, own = None, None
                    for text, item in sorted(_candidates(hashes, first, classes, k)):
                        if text != last:
                            last, own = text, np.unique(hashes[first[text] : first[text + 1]])
                        at = np.minimum(np.searchsorted(own, sets[item]), len(own) - 1)
                        held = (own[at] == sets[item]).mean()
                        if held >= threshold:
                            rows.append((ids[text], names[item], float(held)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sorted(rows, key=str), strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "containment"])

        found = common.bounded(docs).select("doc_id", "text").mapInArrow(run, _OUT)
        parts = found if parts is None else parts.unionByName(found)
    found = spark.createDataFrame([], _OUT) if parts is None else parts
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents that hold no item, with the columns they came with. Null ids are kept."""
    name = common.free_name(docs)
    bad = common.stored(leaks(docs, benchmark, threshold).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(bad, docs["doc_id"] == bad[name], "left_anti")
