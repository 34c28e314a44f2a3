"""Token counts by a map-side lookup in two tiers: pre-tokens never go through a shuffle.

A first pass sums up the pre-tokens of all texts: every task keeps a summary of bounded size (Misra and Gries: an entry's count is too low
by at most the pre-tokens over the capacity), and the summaries, which can be merged in any order, are merged by a tree. The lengths in
tokens of the frequent pre-tokens make a compact hash table that is broadcast: tier one. In the second pass a pre-token that the table
lacks goes to a cache of the worker's, and only if that lacks it, to the tokenizer: tier two. Counts are exact, whatever the table holds.

Pre-tokens are found in numpy, from a class of every code point which the tokenizer's own pre-tokenizer tells. This holds for byte-level
files of one form; texts are encoded whole for any other file.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

#: Entries of the broadcast table and of a summary; the longest pre-token (bytes) that either or a worker's cache keeps, and the cache's entries.
FREQUENT, LONGEST, CACHED = 1 << 15, 64, 200_000
#: Characters that are cut into pre-tokens at a time.
WINDOW = 2 << 20
#: The pre-tokenizer whose pre-tokens are found here, and the endings that it parts from words (fixed values of the file's format).
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
_LETTER, _NUMBER, _OTHER, _WHITE = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point, told by the library: it parts a text where the class changes."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    out = np.full(0x110000, _OTHER, np.uint8)

    def of(c: str) -> int:
        whole = lambda a: len(cut(a + c)) == 1
        return _LETTER if whole("a") else _NUMBER if whole("1") else _OTHER if whole("!") else _WHITE

    out[:0x80] = [of(chr(c)) for c in range(0x80)]
    for lo, hi in ((0x80, 0xD800), (0xE000, 0x110000)):
        for _, (a, b) in cut("".join(map(chr, range(lo, hi)))):
            out[lo + a : lo + b] = of(chr(lo + a))
    return out


def begins(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point of texts that stand one after another; ``first`` has each text's first one and the end.

    A pre-token is a run of one class with the blank before it; an apostrophe that begins one takes an ending with it; of white
    space before anything else the last character stands alone, or is that blank.
    """
    n = len(points)
    kind = classes()[points]
    fresh = np.zeros(n + 3, bool)  # texts begin here, or the end is reached
    fresh[first] = fresh[n:] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= fresh[:n]
    last = np.zeros(n, bool)  # the last white space before something else
    last[:-1] = (kind[:-1] == _WHITE) & (kind[1:] != _WHITE) & ~fresh[1:n]
    lead = last & (points == 32)
    start = change | last
    start[1:] &= ~lead[:-1]
    mark = np.flatnonzero((points == 39) & change)
    mark = mark[(mark == 0) | ~lead[mark - 1]]
    if len(mark):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = np.where(fresh[mark + 1], 0, padded[mark + 1]), np.where(fresh[mark + 1] | fresh[mark + 2], 0, padded[mark + 2])
        for ending in _ENDINGS:
            hit = one == ord(ending[0])
            if len(ending) == 2:
                hit &= two == ord(ending[1])
            at = mark[hit]
            start[at + 1] = False
            after = at + 1 + len(ending)
            start[after[after < n]] = True
    return start


def pre_tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The texts' pre-tokens as bytes, in order, and each text's first one."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    starts = np.flatnonzero(begins(points, first))
    data = whole.encode()
    at = np.append(starts, len(points))
    if len(data) != len(points):
        widths = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))[at]
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    return pieces, np.searchsorted(starts, first)


#: A place where a pre-token surely begins.
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


class Counter:
    """The file's tokenizer: whole texts, or their pre-tokens if the file has the form that is known here (``apart``)."""

    def __init__(self, name: str):
        import public_tokenizers

        path = public_tokenizers.path(name)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.apart, self.special, self.known = False, None, {}
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer, pre_tokenizers

        full, piece = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (full, piece):
            t.no_truncation()
            t.no_padding()
        self.whole = lambda texts: [len(e.ids) for e in full.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path) as f:
            told = json.load(f)
        added = told.get("added_tokens") or []
        pre = {k: v for k, v in (told.get("pre_tokenizer") or {}).items() if k in _PRE_TOKENIZER}
        plain = not any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.apart = plain and told.get("normalizer") is None and pre == _PRE_TOKENIZER and told["model"]["type"] == "BPE" and not told["model"].get("ignore_merges")
        if self.apart:
            piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
            self._pieces = lambda texts: [len(e.ids) for e in piece.encode_batch_fast(texts, add_special_tokens=False)]
            names = sorted((a["content"] for a in added if a["content"]), key=len, reverse=True)
            self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def lengths(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each pre-token: by the worker's cache, else by the tokenizer."""
        if len(self.known) > CACHED:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        told = dict(zip(new, self._pieces([p.decode() for p in new]), strict=True)) if new else {}
        self.known.update((p, n) for p, n in told.items() if len(p) <= LONGEST)
        return [self.known[p] if p in self.known else told[p] for p in pieces]

    def parts(self, texts: list[str]) -> Iterator[tuple[list[int], list[str], np.ndarray]]:
        """Texts without the special tokens' strings, about a window at a time: the texts' numbers, their parts between those
        strings, cut further where a pre-token begins if they are long; at last no parts, and the special tokens of each text."""
        found, rows, held, size = np.zeros(len(texts), np.int64), [], [], 0
        for i, text in enumerate(texts):
            between = self.special.split(text) if self.special and self.special.search(text) else [text]
            found[i] = len(between) - 1
            for part in between:
                at = 0
                while at < len(part):
                    cut = _SAFE.search(part, at + WINDOW) if len(part) - at > WINDOW else None
                    end = cut.start() if cut else len(part)
                    rows.append(i)
                    held.append(part[at:end])
                    size += end - at
                    at = end
                    if size >= WINDOW:
                        yield rows, held, found[:0]
                        rows, held, size = [], [], 0
        yield rows, held, found


@lru_cache(maxsize=1)
def _counter(name: str) -> Counter:
    return Counter(name)


# --- tier one: the frequent pre-tokens ----------------------------------------------------------


class Summary:
    """Counts of frequent items within a capacity. Whatever exceeds it is taken off all alike, so that summaries can be merged."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, {}

    def add(self, items: list[bytes], counts: list[int]) -> None:
        held = self.count
        for x, n in zip(items, counts, strict=True):
            held[x] = held.get(x, 0) + n
        if len(held) > 2 * self.capacity:
            self.cut()

    def cut(self) -> None:
        if len(self.count) > self.capacity:
            floor = np.partition(np.fromiter(self.count.values(), np.int64, len(self.count)), -self.capacity - 1)[-self.capacity - 1]
            self.count = {x: n - int(floor) for x, n in self.count.items() if n > floor}

    def dump(self) -> bytes:
        self.cut()
        rows = sorted(self.count.items())
        batch = pa.record_batch([pa.array([x for x, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["item", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def merge(self, blob: bytes) -> Summary:
        told = pa.ipc.open_stream(blob).read_all()
        self.add(told["item"].to_pylist(), told["n"].to_pylist())
        return self


class Lengths:
    """A hash table with open addressing of pre-tokens' lengths in tokens. Bytes are compared, so equal hashes do no harm."""

    def __init__(self, pieces: list[bytes], lengths: list[int]):
        self.mask = (2 << max(1, len(pieces)).bit_length()) - 1
        self.slot = np.full(self.mask + 1, -1, np.int32)
        self.hash, self.n = common.hash_strings(pieces), np.array(lengths, np.int32)
        self.pieces = pa.array(pieces, pa.binary())
        for i, h in enumerate(self.hash.tolist()):
            at = h & self.mask
            while self.slot[at] >= 0:
                at = (at + 1) & self.mask
            self.slot[at] = i

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The length of each pre-token, -1 where it is not held."""
        out = np.full(len(pieces), -1, np.int32)
        if not len(self.n) or not len(pieces):
            return out
        hashed = common.hash_strings(pieces.to_pylist())
        left, at, held = np.arange(len(pieces)), (hashed & np.uint64(self.mask)).astype(np.int64), np.full(len(pieces), -1, np.int32)
        while len(left):
            entry = self.slot[at]
            hit = (entry >= 0) & (self.hash[entry] == hashed[left])
            held[left[hit]] = entry[hit]
            on = (entry >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & self.mask
        rows = np.flatnonzero(held >= 0)
        same = pc.equal(self.pieces.take(pa.array(held[rows])), pieces.take(pa.array(rows))).to_numpy(zero_copy_only=False)
        out[rows[same]] = self.n[held[rows[same]]]
        return out


def frequent(docs: DataFrame, tokenizer: str, capacity: int = FREQUENT) -> list[bytes]:
    """The pre-tokens of all texts that a summary of this capacity holds in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, summary = _counter(tokenizer), Summary(capacity)
        for chunk in common.text_chunks(batches):
            for _, parts, _ in counter.parts(common.texts_of(chunk).to_pylist()):
                coded = pre_tokens(parts)[0].dictionary_encode()
                short = pc.less_equal(pc.binary_length(coded.dictionary), LONGEST)
                n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                summary.add(coded.dictionary.filter(short).to_pylist(), n[short.to_numpy(zero_copy_only=False)].tolist())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([summary.dump()], pa.binary())], ["part", "blob"])

    texts = common.bounded(docs.select("text"))
    merged = common.reduce_rounds(texts.mapInArrow(run, "part int, blob binary"), lambda held, blob: (held or Summary(capacity)).merge(blob), Summary.dump, texts.rdd.getNumPartitions())[-1]
    found = Summary(capacity)
    for row in merged.collect():  # one row
        found.merge(row["blob"])
    found.cut()
    return sorted(found.count)


# --- the counts ---------------------------------------------------------------------------------


def count(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, capacity: int = FREQUENT) -> DataFrame:
    """Of each row doc_id, n_bytes (UTF-8), n_tokens and whether those exceed the limit.

    Null texts count as empty: no bytes, no tokens. Strings of special tokens in a text are those tokens. Repeated and null
    ids have a row each; an empty table gives none; other columns are ignored. Long texts are cut where a pre-token surely
    begins, so that memory does not grow with them; only one without two words of letters in a row is held whole.
    """
    shared = None
    if _counter(tokenizer).apart:
        pieces = frequent(docs, tokenizer, capacity)
        shared = docs.sparkSession.sparkContext.broadcast(Lengths(pieces, _counter(tokenizer).lengths(pieces)))  # at most ``capacity`` entries

    def tokens_of(texts: list[str]) -> np.ndarray:
        counter = _counter(tokenizer)
        if shared is None:
            return np.array(counter.whole(texts), np.int64)
        total = np.zeros(len(texts), np.int64)
        for rows, parts, special in counter.parts(texts):
            pieces, first = pre_tokens(parts)
            coded = pieces.dictionary_encode()
            n = shared.value.find(coded.dictionary)
            missed = np.flatnonzero(n < 0)
            n[missed] = counter.lengths(coded.dictionary.take(pa.array(missed)).to_pylist())
            sums = np.concatenate(([0], np.cumsum(n[coded.indices.to_numpy(zero_copy_only=False)], dtype=np.int64)))
            np.add.at(total, np.array(rows, np.int64), np.diff(sums[first]))
            if len(special):
                total += special
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.text_chunks(batches):
            texts = common.texts_of(chunk)
            n = tokens_of(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([common.column_of(chunk, "doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.bounded(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
