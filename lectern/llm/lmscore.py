"""Language-model scoring by online logistic context mixing.

A text is its lower-cased words, each closed by a space, and one end symbol. Symbols are written in a prefix
code fitted to the corpus, and every bit of that code is predicted by several contexts, which hold how often the bit was 0
and 1 in training at each node of the code:

* the first symbol of a word (or the text's end) by the text's class, by the word before, and by the class with the last two
  bytes before the border. The latter two are hashed to 4096 contexts each, so these tables have a fixed size and are broadcast;
* all other symbols by the class with the last 1 to 4 bytes of the word, or with the word so far. Such a context
  is a 64-bit key and shares its counts with no other; the tables grow with the distinct contexts.

The stretched probabilities are combined by weights that a gate selects (how many contexts are known, and the place in the
word), learned online by gradient descent over the training words, as often as they occur, with each occurrence left out of its
own counts. A table by gate and probability, counted in the same pass, refines the mix. While a text is scored, the mix adapts
to it: for several rates, a word is predicted with that rate from the words of the text so far, and for several more from the
words' frequencies in training; the text's probability is the mean over the rates, so that those win which fit the text.

The class of a text, the language whose trees (fitted to the training documents) code its words best, is coded first at the
same cost for every class, so the whole remains a probability of the text.

The corpus is read once, into blocks of documents with the block's own list of words. Blocks send their words to parts by the
word's hash, where equal words meet, are counted exactly and get their costs; the parts send their contexts to the parts of the
tables and get back the counts at the nodes that they need. Parts grow in number with the tokens; what a part or block
holds does not. Only the code, the gates' weights and the tables of fixed size are broadcast.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, langid

#: Contexts and gates inside words; contexts and gates at their beginnings, and the values of a hash there.
CONTEXTS, GATES, BEGIN, BEGIN_GATES, HASHED = 5, 18, 3, 4, 4096
END, SPACE = 256, 32
#: Learning rate, bound of a logit, bits between two steps of learning, and places of the refining table.
LEARN, MOST, BATCH, PLACES = 0.02, 11.0, 1 << 14, 45
#: Rates at which a text's own words predict the next one, and at which whole words' frequencies do in the rest.
RATES, WHOLE = (0.0, 0.02, 0.1, 0.3, 0.6), (0.0, 0.5, 0.9)
#: Bytes of text of a block; tokens of the corpus for each part of the words and of the tables; slices in which fixed tables are merged.
BLOCK, PART, SLICES = 9 << 20, 3 << 20, 64
#: Tokens of a block handled at a time, or those of one text; bytes of a word that is hashed with others at once.
SLICE, SHORT = 1 << 18, 32


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


# --- the model ---------------------------------------------------------------------------------


_LOG = np.log(np.arange(1 << 16) + 0.4).astype(np.float32)


class Code:
    """A prefix code of the 257 symbols: of each its nodes and bits, one after another."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, s, s) for s, n in enumerate(counts)]
        heapq.heapify(heap)
        node, children = 257, {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], node, node))
            node += 1
        paths: dict[int, list] = {}
        stack = [(heap[0][2], [])]
        while stack:
            at, path = stack.pop()
            if at < 257:
                paths[at] = path
            else:
                stack += [(child, [*path, (at - 257, bit)]) for bit, child in enumerate(children[at])]
        self.size = np.array([len(paths[s]) for s in range(257)])
        self.at = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        flat = [x for s in range(257) for x in paths[s]]
        self.node, self.bit = np.array([x[0] for x in flat], np.uint64), np.array([x[1] for x in flat], np.int8)

    def nodes(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each node (a column) sees 0 and 1, of contexts (rows) with counts of symbols."""
        to = np.zeros((2, 257, 256))
        symbol = np.repeat(np.arange(257), self.size)
        to[self.bit, symbol, self.node.astype(np.int64)] = 1
        return (counts @ to[0]).astype(np.float32), (counts @ to[1]).astype(np.float32)


def _symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' symbols, each word closed by a space, and the first of each; the empty word is a text's end."""
    closed = pc.binary_join_element_wise(words, " ", "")
    closed = pa.concat_arrays([closed]) if closed.offset else closed
    size = pc.binary_length(closed).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    own = np.frombuffer(closed.buffers()[2], np.uint8, first[-1]).astype(np.int64) if first[-1] else np.zeros(0, np.int64)
    own[first[:-1][size == 1]] = END
    return own, first


def _contexts(s: np.ndarray, first: np.ndarray, classes: np.ndarray) -> Iterator[np.ndarray]:
    """Of every symbol its contexts, one after another, as 64-bit keys of the class, the kind of context and the bytes."""
    n, each = len(s), np.diff(first)
    place = np.arange(n) - np.repeat(first[:-1], each)
    u, own = s.astype(np.uint64), np.repeat(classes.astype(np.uint64) << np.uint64(48), each)
    base = np.uint64(0x9E3779B97F4A7C15)
    held = np.zeros(n, np.uint64)
    for k in range(1, 5):
        before = np.full(n, SPACE, np.uint64)
        before[k:] = np.where(place[k:] >= k, u[:-k], np.uint64(SPACE))
        held |= before << np.uint64(8 * (k - 1))
        yield common.mix64((held + own + np.uint64((k - 1) << 40)) * base)
    power = np.cumprod(np.full(int(place.max()) + 1 if n else 1, base, np.uint64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((u + np.uint64(1)) * power[place], dtype=np.uint64)))
    yield common.mix64((total[:-1] - np.repeat(total[first[:-1]], each) + own + np.uint64(4 << 40)) * base)


class Edges:
    """The distinct edges, pairs of context and symbol, inside a list of words, dealt to the parts of the tables by context."""

    def __init__(self, words: pa.Array, classes: np.ndarray, parts: int):
        s, first = _symbols(words)
        place = np.arange(len(s)) - np.repeat(first[:-1], np.diff(first))
        inner = np.flatnonzero(place > 0)
        self.first = np.concatenate(([0], np.cumsum(np.diff(first) - 1)))
        self.symbol, self.at, contexts, symbols, n = s[inner].astype(np.int16), [], [], [], 0
        self.place = np.minimum(place[inner] - 1, 2).astype(np.int8)
        for h in _contexts(s, first, classes):
            h = h[inner]
            key = common.mix64(h ^ ((s[inner].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)))
            at = pa.array(key).dictionary_encode().indices.to_numpy()
            new = np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1)) if len(at) else np.zeros(0, np.int64)
            contexts.append(h[new])
            symbols.append(self.symbol[new])
            self.at.append(at + np.int32(n))
            n += len(new)
        self.context, self.of = np.concatenate(contexts), np.concatenate(symbols)
        part = ((self.context >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.cuts = np.searchsorted(part[self.order], np.arange(parts + 1))

    def counts(self, often: np.ndarray) -> np.ndarray:
        """How often each edge occurs, if each word occurs as often as given."""
        each = np.repeat(often, np.diff(self.first)).astype(np.float64)
        return sum(np.bincount(at, each, len(self.of)) for at in self.at).astype(np.int64)


class Model:
    """The code, and of a list of words the counts of zeros and ones at each node of its edges."""

    def __init__(self, code: Code, edges: Edges, pairs: tuple[np.ndarray, np.ndarray]):
        self.code, self.edges = code, edges
        sizes = code.size[edges.of[edges.order]]
        self.start = np.empty(len(sizes), np.int64)
        self.start[edges.order] = np.cumsum(sizes) - sizes
        self.zeros, self.ones = pairs

    def bits(self, own: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Of every bit inside the words with these numbers: its place in the counts by context, the bit, the place in the word, and each word's first bit."""
        e = self.edges
        n = np.diff(e.first)[own]
        to = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(to[-1]) + np.repeat(e.first[own] - to[:-1], n)
        s = e.symbol[at]
        size = self.code.size[s]
        starts = np.concatenate(([0], np.cumsum(size)))
        within = np.arange(starts[-1]) - np.repeat(starts[:-1], size)
        slots = [np.repeat(self.start[e.at[k][at]], size) + within for k in range(CONTEXTS)]
        return slots, self.code.bit[np.repeat(self.code.at[s], size) + within], np.repeat(e.place[at], size), starts[to]

    def inputs(self, slots: list[np.ndarray], bit: np.ndarray, place: np.ndarray, left_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Stretched probabilities by context, and gates; if left out, without one occurrence of the bit."""
        one = bit.astype(np.uint16)
        x, gate = np.empty((CONTEXTS, len(bit)), np.float32), place.astype(np.int64)
        for k in range(CONTEXTS):
            zeros, ones = self.zeros.take(slots[k]), self.ones.take(slots[k])
            if left_out:
                zeros -= np.minimum(zeros, 1 - one)
                ones -= np.minimum(ones, one)
            np.subtract(_LOG.take(ones), _LOG.take(zeros), out=x[k])
            gate += (np.maximum(zeros, ones) >= 2) * 3
        return x, gate

    def costs(self, mixer: Mixer, step: int = 4096) -> np.ndarray:
        """Bits that all symbols but the first take of each word."""
        n, out = len(self.edges.first) - 1, []
        for lo in range(0, n, step):
            slots, bit, place, first = self.bits(np.arange(lo, min(n, lo + step)))
            z = mixer.mix(*self.inputs(slots, bit, place, False))
            cost = np.concatenate(([0.0], np.cumsum(_cost(z, bit))))
            out.append(np.diff(cost[first]))
        return np.concatenate(out) if out else np.zeros(0)


def _cost(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Bits that a bit takes at a logit."""
    return np.log1p(np.exp(np.clip(np.where(bit > 0, -z, z), -MOST, MOST).astype(np.float64))) / np.log(2)


class Mixer:
    """Weights by gate, and a table that refines the mix by gate and logit."""

    def __init__(self, weights: np.ndarray, seen: np.ndarray | None = None):
        self.weights = weights.astype(np.float32)
        self.more = None
        if seen is not None:  # of each gate and place: occurrences, ones, and the sum of what was predicted
            n, ones, told = (x.reshape(len(weights), PLACES) for x in seen)
            logit = lambda k: np.log((k + 1) / (n - k + 1))
            self.more = np.clip(logit(ones) - logit(np.minimum(told, n)), -2, 2).astype(np.float32)

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(x.shape[1], np.float32)
        for k in range(len(x)):
            z += self.weights[:, k].copy().take(gate) * x[k]
        if self.more is not None:
            at, part = _places(z)
            flat = self.more.ravel()
            z = z + (1 - part) * flat.take(gate * PLACES + at) + part * flat.take(gate * PLACES + at + 1)
        return z


def _places(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of a logit in the refining table, and how far it is to the next one."""
    y = (np.clip(z, -MOST + 0.01, MOST - 0.01) + MOST) * ((PLACES - 1) / (2 * MOST))
    at = y.astype(np.int64)
    return at, (y - at).astype(np.float32)


class Learner:
    """Learns a mixer's weights online, in steps of equal weight; sums them up over the steps, and what the refining table counts."""

    def __init__(self, gates: int, contexts: int):
        self.weights = np.full((gates, contexts), 1.5 / contexts)
        self.total, self.steps, self.seen = np.zeros_like(self.weights), 0, np.zeros((3, gates * PLACES))

    def step(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, often: np.ndarray) -> None:
        z = Mixer(self.weights).mix(x, gate)
        p = (1 / (1 + np.exp(-np.clip(z, -MOST, MOST)))).astype(np.float64)
        off, gates = (bit - p) * often, len(self.weights)
        at, part = _places(z)
        for place, share in ((at, 1 - part), (at + 1, part)):
            for i, v in enumerate((1.0, bit, p)):
                self.seen[i] += np.bincount(gate * PLACES + place, v * share * often, self.seen.shape[1])
        sums = np.bincount(gate, often, gates) + 64
        for k in range(len(x)):
            self.weights[:, k] += LEARN * 8 * np.bincount(gate, off * x[k], gates) / sums
        self.total += self.weights
        self.steps += 1

    def rows(self, kind: int) -> pa.Table:
        """What is learned as numbers with their places, to be summed up over learners."""
        values = np.concatenate((self.total.ravel(), [self.steps], self.seen.ravel()))
        return pa.table({"kind": pa.array(np.full(len(values), kind, np.int32)), "i": pa.array(np.arange(len(values), dtype=np.int32)), "v": pa.array(values)})


_LEARNED = "kind int, i int, v double"


def _mixer(values: np.ndarray, gates: int, contexts: int) -> Mixer:
    n = gates * contexts
    weights = values[:n] / values[n] if values[n] else np.full(n, 1.5 / contexts)
    return Mixer(weights.round(7).reshape(gates, contexts), values[n + 1 :].reshape(3, -1).round(3))


def dealt(counts: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as often as they occur, dealt to steps of equal weight: word numbers and their weights in order,
    and each step's first. A word of more than an eighth of a step's weight comes in several pieces."""
    own = np.flatnonzero(counts)
    n = counts[own].astype(np.float64)
    pieces = np.ceil(n * 8 * steps / n.sum()).astype(np.int64) if len(own) else np.zeros(0, np.int64)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    own, weight = np.repeat(own, pieces), np.repeat(n / np.maximum(pieces, 1), pieces)
    order = np.argsort(common.mix64((own.astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1)), kind="stable")
    own, weight = own[order], weight[order]
    to = np.cumsum(weight)
    first = np.searchsorted(to, np.arange(steps) * (to[-1] / steps if len(to) else 0), side="right")
    return own, weight, np.append(first, len(own))


def learn(model: Model, counts: np.ndarray) -> Learner:
    """One online pass over the insides of words as often as they occur, each occurrence left out of its counts."""
    own, weight, first = dealt(counts, max(1, int(model.code.size[model.edges.symbol].sum()) // BATCH))
    learner = Learner(GATES, CONTEXTS)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        slots, bit, place, starts = model.bits(own[lo:hi])
        if len(bit):
            learner.step(*model.inputs(slots, bit, place, True), bit, np.repeat(weight[lo:hi], np.diff(starts)))
    return learner


class Begins:
    """The contexts of words' first symbols: classes, then hashed words before, then hashed classes with the two bytes before."""

    def __init__(self, code: Code, counts: np.ndarray):
        self.code, self.classes = code, len(counts) - 2 * HASHED
        self.zeros, self.ones = code.nodes(counts)

    def inputs(self, contexts: np.ndarray, symbols: np.ndarray, left_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the bits of the symbols the stretched probabilities, gates and values, and each symbol's first bit. contexts: a row for each kind."""
        size = self.code.size[symbols]
        first = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(first[-1]) + np.repeat(self.code.at[symbols] - first[:-1], size)
        node, bit = self.code.node[at].astype(np.int64), self.code.bit[at]
        x, gate = np.empty((BEGIN, len(bit)), np.float32), np.zeros(len(bit), np.int64)
        for k in range(BEGIN):
            slot = np.repeat(contexts[k], size) * 256 + node
            zeros, ones = self.zeros.ravel().take(slot), self.ones.ravel().take(slot)
            if left_out:
                zeros, ones = np.maximum(zeros - (bit == 0), 0), np.maximum(ones - (bit == 1), 0)
            x[k] = np.log(ones + np.float32(0.4)) - np.log(zeros + np.float32(0.4))
            if k:
                gate += (zeros + ones >= 8) * k
        return x, gate, bit, first


# --- over the corpus ---------------------------------------------------------------------------


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed."""
    return zlib.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def _text_of(words: pa.Array) -> tuple[bytes, bytes]:
    """Words as their bytes and sizes, compressed."""
    own = pa.concat_arrays([words])
    size = pc.binary_length(own).to_numpy(zero_copy_only=False).astype("<u4")
    raw = own.buffers()[2]
    return zlib.compress(raw.to_pybytes()[: int(size.sum(dtype=np.int64))] if raw else b"", 1), _squeezed(size)


def _words_of(text: bytes, sizes: bytes) -> pa.Array:
    size = _numbers(sizes, "<u4")
    ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(zlib.decompress(text))])


_BLOCK_FIELDS = ("doc_ids", "null_ids", "held", "n_tokens", "codes", "words", "sizes", "classes", "counts")
_BLOCK = "block long, tokens long, " + ", ".join(f"{c} binary" for c in _BLOCK_FIELDS)
_BLOCK_PA = pa.schema([("block", pa.int64()), ("tokens", pa.int64()), *[(c, pa.binary()) for c in _BLOCK_FIELDS]])


def _blocks(shared):
    """Packs documents into blocks: the tokens' numbers in the block's list of (word, class) with training counts."""

    def pack(chunks: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(chunks).combine_chunks()
        texts, model = pc.fill_null(table["text"].combine_chunks(), ""), shared.value
        words, starts = common.split_words(pc.ascii_lower(texts))
        coded = words.dictionary_encode()
        names = pa.concat_arrays([coded.dictionary, pa.array([""])])
        said = coded.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int32)
        kind = np.zeros(len(texts), np.int64)
        if len(model.languages) > 1 and len(words):
            least = np.full(len(texts), np.inf)
            bits = model.bits(coded.dictionary)[0]
            for i in range(bits.shape[1]):
                own = np.diff(np.concatenate(([0.0], np.cumsum(bits[:, i].take(said))))[starts])
                kind[own < least] = i
                least = np.minimum(own, least)
        n = np.diff(starts) + 1
        tokens = np.full(int(n.sum()), len(names) - 1, np.int64)
        keep = np.ones(len(tokens), bool)
        keep[np.cumsum(n) - 1] = False
        tokens[keep] = said
        own, codes = np.unique(np.repeat(kind, n) * len(names) + tokens, return_inverse=True)
        order = np.argsort(-np.bincount(codes), kind="stable")  # small numbers for common words compress better
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own, codes = own[order], rank[codes]
        held = table["held"].to_numpy()
        counts = np.bincount(codes[np.repeat(~held, n)], minlength=len(own))
        ids = table["doc_id"].combine_chunks()
        row = [
            number, len(tokens), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).tobytes(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), held.astype(np.uint8).tobytes(), n.astype("<i8").tobytes(),
            _squeezed(codes.astype("<u4")), *_text_of(names.take(pa.array(own % len(names)))), _squeezed((own // len(names)).astype("<u2")), _squeezed(counts.astype("<u4")),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], _BLOCK_PA.field(i).type) for i, v in enumerate(row)], schema=_BLOCK_PA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for chunk in common.text_chunks(batches, BLOCK // 4):
            held.append(chunk)
            size += pc.sum(pc.binary_length(common.column_of(chunk, "text"))).as_py() or 0
            if size >= BLOCK:
                yield pack(held, number)
                number, held, size = number + 1, [], 0
        if held:
            yield pack(held, number)

    return run


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: short ones are read eight bytes at a time, all words at once."""
    own = pa.concat_arrays([words]) if words.offset else words
    size = pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    raw = np.zeros(int(size.sum()) + 8, np.uint8)
    if len(raw) > 8:
        begin = np.frombuffer(own.buffers()[1], np.int32, 1)[0]
        raw[:-8] = np.frombuffer(own.buffers()[2], np.uint8, len(raw) - 8, begin)
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    out = common.mix64((size.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    for at in range(0, SHORT, 8):
        rows = np.flatnonzero((size > at) & (size <= SHORT))
        rest = np.uint64(64) - np.uint64(8) * np.minimum(size[rows] - at, 8).astype(np.uint64)
        out[rows] = common.mix64((out[rows] ^ (eights[first[rows] + at] << rest)) * np.uint64(0xC2B2AE3D27D4EB4F))
    long = np.flatnonzero(size > SHORT)
    if len(long):
        out[long] = common.hash_strings(own.take(pa.array(long)).to_pylist())
    return out


def _last_two(words: pa.Array) -> np.ndarray:
    """The last two bytes of each word; 0 stands for those that it has not."""
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    raw = np.frombuffer(words.buffers()[2], np.uint8, ends[-1]) if len(ends) and ends[-1] else np.zeros(1, np.uint8)
    size = np.diff(ends, prepend=0)
    byte = lambda k: np.where(size >= k, raw[np.maximum(ends - k, 0)], 0).astype(np.uint64)
    return byte(1) | byte(2) << np.uint64(8)


def _slices(row: dict, n_classes: int) -> Iterator[tuple]:
    """A block's texts, some at a time: the first and the last, their tokens' codes, and for the distinct beginnings among them
    the contexts (a row for each kind) and symbols, how often each occurs in training, and each token's beginning."""
    words, classes = _words_of(row["words"], row["sizes"]), _numbers(row["classes"], "<u2").astype(np.int64)
    s, first = _symbols(words)
    symbol = s[first[:-1]]
    del s, first
    # Of a list's word what the next one's beginning sees; before a text stands an empty word.
    word = (_hashes(words) % np.uint64(HASHED)).astype(np.int64) << 12
    word |= (common.mix64((_last_two(words) + (classes.astype(np.uint64) << np.uint64(20)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(HASHED)).astype(np.int64)
    empty = int(_hashes(pa.array([""]))[0] % HASHED) << 12
    own = classes << 33 | symbol
    every, n = _numbers(row["codes"], "<u4"), np.frombuffer(row["n_tokens"], "<i8")
    held, to = np.frombuffer(row["held"], np.uint8).astype(bool), np.concatenate(([0], np.cumsum(n)))
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(to, to[lo] + SLICE, side="right")) - 1)
        codes = every[to[lo] : to[hi]].astype(np.int64)
        keys = np.empty(len(codes), np.int64)
        keys[1:] = word.take(codes[:-1])
        keys[to[lo:hi] - to[lo]] = empty
        keys <<= 9
        keys |= own.take(codes)
        distinct, at = np.unique(keys, return_inverse=True)
        often = np.bincount(at[np.repeat(~held[lo:hi], n[lo:hi])], minlength=len(distinct))
        contexts = np.stack([distinct >> 33, (distinct >> 21 & (HASHED - 1)) + n_classes, (distinct >> 9 & (HASHED - 1)) + n_classes + HASHED])
        yield lo, hi, codes, contexts, distinct & 511, often, at
        lo = hi


def _fixed_counts(n_classes: int):
    """Counts of all symbols, and of first ones by context, of the blocks of a task, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + n_classes + 2 * HASHED) * 257, np.int64)
        for b in batches:
            for row in b.to_pylist():
                s, first = _symbols(_words_of(row["words"], row["sizes"]))
                total[:257] += np.bincount(s, np.repeat(_numbers(row["counts"], "<u4"), np.diff(first)), 257).astype(np.int64)
                for _, _, _, contexts, symbols, often, _ in _slices(row, n_classes):
                    for k in range(BEGIN):
                        np.add.at(total, 257 + contexts[k] * 257 + symbols, often)
        parts = np.array_split(total, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([_squeezed(x) for x in parts], pa.binary())], ["slice", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the slices that reach a task, sorted by slice."""
    now, total = None, None
    for b in batches:
        for number, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if number != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_squeezed(total)], pa.binary())], ["slice", "counts"])
                now, total = number, 0
            total = total + _numbers(raw, "<i8")
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_squeezed(total)], pa.binary())], ["slice", "counts"])


def fixed(blocks: DataFrame, n_classes: int) -> tuple[Code, Begins]:
    """The code, and the contexts of words' beginnings, over all blocks."""
    sums = blocks.mapInArrow(_fixed_counts(n_classes), "slice int, counts binary").repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(_added, "slice int, counts binary")
    parts = {r["slice"]: _numbers(r["counts"], "<i8") for r in sums.collect()}  # of fixed size
    total = np.concatenate([parts[i] for i in range(SLICES)])
    code = Code(total[:257])
    return code, Begins(code, total[257:].reshape(-1, 257))


def _to_parts(parts: int):
    """Of each block, for each part the words there (with class and training count) in the block's order."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                words = _words_of(row["words"], row["sizes"])
                classes, counts = _numbers(row["classes"], "<u2"), _numbers(row["counts"], "<u4")
                part = ((_hashes(words) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for i in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[i] : cuts[i + 1]]
                    out.append((int(i), row["block"], *_text_of(words.take(pa.array(own))), _squeezed(classes[own]), _squeezed(counts[own])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["part", "block", "words", "sizes", "classes", "counts"])

    return run


_ASK = "part int, block long, words binary, sizes binary, classes binary, counts binary"
_LISTS = "part int, block long, at binary, words binary, sizes binary, classes binary, counts binary, seen binary, n_all long, n_kinds long"


def _listed(asks: pa.Table) -> pa.Table:
    """One part of the words: a row with its distinct (word, class) in order, their training counts and those of the words in all
    classes; and for each block where its words stand among them."""
    lists = [_words_of(t.as_py(), z.as_py()) for t, z in zip(asks["words"], asks["sizes"], strict=True)]
    size = [len(x) for x in lists]
    every = pa.concat_arrays(lists)
    classes = np.concatenate([_numbers(x.as_py(), "<u2") for x in asks["classes"]]).astype(np.int64)
    counts = np.concatenate([_numbers(x.as_py(), "<u4") for x in asks["counts"]]).astype(np.float64)
    coded = every.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word = rank[coded.indices.to_numpy()]
    own, at = np.unique(word << 16 | classes, return_inverse=True)
    n = np.bincount(at, counts, len(own)).astype("<u8")
    of = own >> 16
    seen = np.bincount(of, n.astype(np.float64), len(order)).astype("<u8")
    text = _text_of(coded.dictionary.take(pa.array(order)).take(pa.array(of)))
    part, cuts = asks["part"][0].as_py(), np.cumsum([0, *size])
    rows = [{"part": part, "words": text[0], "sizes": text[1], "classes": _squeezed((own & 0xFFFF).astype("<u2")), "counts": _squeezed(n), "seen": _squeezed(seen[of]), "n_all": int(seen.sum()), "n_kinds": int((seen > 0).sum())}]
    rows += [{"part": part, "block": b, "at": _squeezed(at[lo:hi].astype("<u4"))} for b, lo, hi in zip(asks["block"].to_pylist(), cuts[:-1], cuts[1:], strict=True)]
    types = {"part": pa.int32(), "block": pa.int64(), "n_all": pa.int64(), "n_kinds": pa.int64()}
    return pa.table({c: pa.array([r.get(c) for r in rows], types.get(c, pa.binary())) for c in ("part", "block", "at", "words", "sizes", "classes", "counts", "seen", "n_all", "n_kinds")})


def _to_tables(parts: int):
    """Of each part of the words, for each part of the tables: the contexts and symbols there with their training counts."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                e = Edges(_words_of(row["words"], row["sizes"]), _numbers(row["classes"], "<u2"), parts)
                n, out = e.counts(_numbers(row["counts"], "<u8")), []
                for i in np.flatnonzero(np.diff(e.cuts)):
                    own = e.order[e.cuts[i] : e.cuts[i + 1]]
                    out.append((int(i), row["part"], len(own), e.context[own].astype("<u8").tobytes(), _squeezed(n[own].astype("<u8")), _squeezed(e.of[own].astype("<i2"))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["at", "part", "n", "contexts", "often", "symbols"])

    return run


_TO_TABLES = "at int, part int, n int, contexts binary, often binary, symbols binary"
_FROM_TABLES = "table int, part int, pairs binary"


def _answers(shared):
    """Adds up one part of the tables, and gives each part of the words the counts at its edges' nodes in its order."""

    def run(asks: pa.Table) -> pa.Table:
        code, sizes = shared.value, asks["n"].to_numpy()
        context = np.frombuffer(b"".join(asks["contexts"].to_pylist()), "<u8")
        often = np.concatenate([_numbers(x, "<u8") for x in asks["often"].to_pylist()]).astype(np.float64)
        symbol = np.concatenate([_numbers(x, "<i2") for x in asks["symbols"].to_pylist()]).astype(np.int64)
        to = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        order = np.lexsort((symbol, context))
        c, s = context[order], symbol[order]
        other = np.concatenate(([True], c[1:] != c[:-1]))
        new = other | np.concatenate(([True], s[1:] != s[:-1]))
        edge = np.empty(len(order), np.int64)
        edge[order] = np.cumsum(new) - 1
        n, own, s = np.add.reduceat(often[order], np.flatnonzero(new)), (np.cumsum(other) - 1)[new], s[new]
        size = code.size[s]
        start = np.cumsum(size) - size
        path = np.arange(size.sum()) + np.repeat(code.at[s] - start, size)
        _, node = np.unique(np.repeat(own, size) * 256 + code.node[path].astype(np.int64), return_inverse=True)
        n, bit = np.repeat(n, size), code.bit[path]
        pairs = np.array([np.bincount(node, n * (bit == v)) for v in (0, 1)])
        pairs = np.ceil(pairs / np.maximum(1, pairs.max(axis=0) / 65_000)).astype("<u2")[:, node]
        out = []
        for i in range(len(sizes)):
            at = edge[to[i] : to[i + 1]]
            k = size[at]
            at = np.repeat(start[at] - np.cumsum(k) + k, k) + np.arange(k.sum())
            out.append(_squeezed(np.concatenate((pairs[0][at], pairs[1][at]))))
        return pa.table({"table": asks["at"], "part": asks["part"], "pairs": pa.array(out, pa.binary())})

    return run


def _model(table: pa.Table, row: dict, code: Code, parts: int) -> Model:
    """Of a part of the words and the tables' answers to it."""
    given = table.filter(pc.is_valid(table["table"])).sort_by("table")
    pairs = [_numbers(x, "<u2").reshape(2, -1) for x in given["pairs"].to_pylist()]
    zeros, ones = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.uint16)
    return Model(code, Edges(_words_of(row["words"], row["sizes"]), _numbers(row["classes"], "<u2"), parts), (zeros, ones))


def _own(table: pa.Table) -> dict:
    """The row of a part's words among those that meet there."""
    return table.filter(pc.is_valid(table["words"])).select(["part", "words", "sizes", "classes", "counts", "seen"]).to_pylist()[0]


def _learning(shared, parts: int):
    def run(table: pa.Table) -> pa.Table:
        row = _own(table)
        return learn(_model(table, row, shared.value, parts), _numbers(row["counts"], "<u8")).rows(0)

    return run


def _learning_begins(shared, n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                learner, begins = Learner(BEGIN_GATES, BEGIN), shared.value
                for _, _, _, contexts, symbols, often, _ in _slices(row, n_classes):
                    own, weight, first = dealt(often, max(1, int(begins.code.size[symbols].sum()) // BATCH))
                    for lo, hi in zip(first[:-1], first[1:], strict=True):
                        x, gate, bit, starts = begins.inputs(contexts[:, own[lo:hi]], symbols[own[lo:hi]], True)
                        if len(bit):
                            learner.step(x, gate, bit, np.repeat(weight[lo:hi], np.diff(starts)))
                yield from learner.rows(1).to_batches()

    return run


_COSTS = "block long, part int, seen binary, cost binary"


def _costing(shared, parts: int):
    """The costs of one part's words, and how often they occur in training, as each block needs them."""

    def run(table: pa.Table) -> pa.Table:
        code, mixer = shared.value
        row = _own(table)
        cost, seen = _model(table, row, code, parts).costs(mixer).astype("<f4"), _numbers(row["seen"], "<u8")
        asked = table.filter(pc.is_valid(table["at"])).select(["block", "at"]).to_pylist()
        at = [_numbers(r["at"], "<u4") for r in asked]
        return pa.table({"block": pa.array([r["block"] for r in asked], pa.int64()), "part": pa.array([row["part"]] * len(asked), pa.int32()), "seen": pa.array([_squeezed(seen[a]) for a in at], pa.binary()), "cost": pa.array([_squeezed(cost[a]) for a in at], pa.binary())})

    return run


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def adapted(cost: np.ndarray, share: np.ndarray, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits of each text from its tokens' bits and their shares of all training tokens. For each rate the text's own words so far
    predict the next one with that rate, and the model and the shares with the rest; the text's probability is the mean over the rates."""
    text = np.repeat(np.arange(len(n)), n)
    first = np.concatenate(([0], np.cumsum(n)))
    keys = text * (int(codes.max()) + 1 if len(codes) else 1) + codes
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.diff(keys[order], prepend=-1))
    before = np.empty(len(keys), np.int64)
    before[order] = np.arange(len(keys)) - np.repeat(new, np.diff(np.append(new, len(keys))))
    # A word that the text has not had takes the same from the words so far at every rate: it is added up once for each share of the words' frequencies.
    fresh, again = np.flatnonzero(before == 0), np.flatnonzero(before)
    later = np.bincount(text[fresh], minlength=len(n)) - 1  # fresh words after each text's first

    def summed(at: np.ndarray, own: np.ndarray) -> Callable[[float, float], np.ndarray]:
        own_text, own_cost, own_share = text[at], cost[at], share[at]
        spelled, far = np.exp2(-np.minimum(own_cost, 1000)), np.flatnonzero(own_cost > 1000)

        def bits(r: float, w: float) -> np.ndarray:
            out = -np.log2((1 - r) * ((1 - w) * spelled + w * own_share) + r * own)
            if len(far):  # words too long for floating point: their bits are added as logarithms
                with np.errstate(divide="ignore"):
                    out[far] = -np.logaddexp2(np.log2((1 - r) * (1 - w)) - own_cost[far], np.log2((1 - r) * w * own_share[far] + r * own[far]))
            return np.bincount(own_text, out, len(n))

        return bits

    new, old = summed(fresh, np.zeros(len(fresh))), summed(again, before[again] / (again - first[text[again]]))
    each = []
    for w in WHOLE:
        spelling = new(0.0, w)
        each += [spelling - later * np.log2(1 - r) + old(r, w) for r in RATES]
    least = np.min(each, axis=0)
    return least - np.log2(np.exp2(least - np.array(each)).mean(axis=0))


def _score(shared, parts: int):
    def run(table: pa.Table) -> pa.Table:
        begins, mixer, n_classes, n_all, n_kinds = shared.value
        row = table.filter(pc.is_valid(table["words"])).select(["block", *_BLOCK_FIELDS]).to_pylist()[0]
        words = _words_of(row["words"], row["sizes"])
        part = ((_hashes(words) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        given = table.filter(pc.is_valid(table["part"])).sort_by("part")
        seen, cost = np.zeros(len(words), np.float64), np.zeros(len(words))
        seen[order] = np.concatenate([_numbers(x, "<u8") for x in given["seen"].to_pylist()])
        cost[order] = np.concatenate([_numbers(x, "<f4") for x in given["cost"].to_pylist()])
        n = np.frombuffer(row["n_tokens"], "<i8")
        bits, base, known, size = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        log, share = np.log10((seen + 1) / (n_all + n_kinds + 1)), seen / (n_all + n_kinds + 1)
        wide = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        for lo, hi, codes, contexts, symbols, _, at in _slices(row, n_classes):
            first_cost = np.empty(len(symbols))
            for i in range(0, len(symbols), 1 << 14):
                x, gate, bit, first = begins.inputs(contexts[:, i : i + (1 << 14)], symbols[i : i + (1 << 14)], False)
                total = np.concatenate(([0.0], np.cumsum(_cost(mixer.mix(x, gate), bit))))
                first_cost[i : i + (1 << 14)] = np.diff(total[first])
            first = np.cumsum(n[lo:hi]) - n[lo:hi]
            bits[lo:hi] = adapted(cost.take(codes) + first_cost.take(at), share.take(codes), codes, n[lo:hi]) + np.log2(max(1, n_classes))
            base[lo:hi], known[lo:hi] = np.add.reduceat(log.take(codes), first), np.add.reduceat(seen.take(codes) > 0, first, dtype=np.int64)
            size[lo:hi] = np.add.reduceat(wide.take(codes), first)
        ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["null_ids"], np.uint8).astype(bool))
        held = np.frombuffer(row["held"], np.uint8).astype(bool)
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": n, "n_known": known, "train_tokens": np.full(len(held), n_all), "base_score": base, "score": -bits * np.log10(2), "bits_per_byte": bits / size})

    return run


def _grouped(f):
    """A function of a table that Spark takes as one of a group."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        pa.default_memory_pool().release_unused()
        return out

    return run


def score(docs: DataFrame) -> DataFrame:
    """The log10 probability of every text under the model, and under smoothed word frequencies.

    Learns from documents not held out. A null or empty text is its end alone. A row without an id is not
    held out. With more languages than langid.LANGUAGES all texts are of one class. Repeated rows count as often in training and get equal scores. Without training documents the
    model gives every bit one half. Scores do not depend on how the table is partitioned, but for the order of the
    online learning of words' beginnings by blocks.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", held_out().alias("held"), "text", "lang")
    trees = langid.train(own.filter("not held"), everything=True, strict=False)
    n_classes = max(1, len(trees.languages))
    blocks = common.stored(common.bounded(own).select("doc_id", "held", "text").mapInArrow(_blocks(spark.sparkContext.broadcast(trees)), _BLOCK))
    parts = max(1, -(-(blocks.agg(F.sum("tokens")).first()[0] or 0) // PART))  # parts of words and of tables grow with the tokens
    code, begins = fixed(blocks, n_classes)
    shared = spark.sparkContext.broadcast(code)
    lists = common.stored(blocks.mapInArrow(_to_parts(parts), _ASK).groupBy("part").applyInArrow(_grouped(_listed), _LISTS))
    words = lists.filter("words is not null")
    totals = words.agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_kinds"), F.lit(0))).first()
    told = words.select("part", "words", "sizes", "classes", "counts", "seen")
    given = common.stored(told.mapInArrow(_to_tables(parts), _TO_TABLES).groupBy("at").applyInArrow(_grouped(_answers(shared)), _FROM_TABLES))
    met = told.unionByName(given, allowMissingColumns=True)
    inside = met.groupBy("part").applyInArrow(_grouped(_learning(shared, parts)), _LEARNED)
    first = blocks.mapInArrow(_learning_begins(spark.sparkContext.broadcast(begins), n_classes), _LEARNED)
    values = {0: np.zeros(GATES * CONTEXTS + 1 + 3 * GATES * PLACES), 1: np.zeros(BEGIN_GATES * BEGIN + 1 + 3 * BEGIN_GATES * PLACES)}
    for r in inside.unionByName(first).groupBy("kind", "i").agg(F.sum("v").alias("v")).collect():  # of fixed size
        values[r["kind"]][r["i"]] = r["v"]
    mixers = _mixer(values[0], GATES, CONTEXTS), _mixer(values[1], BEGIN_GATES, BEGIN)
    asked = met.unionByName(lists.filter("block is not null").select("part", "block", "at"), allowMissingColumns=True)
    costs = common.stored(asked.groupBy("part").applyInArrow(_grouped(_costing(spark.sparkContext.broadcast((code, mixers[0])), parts)), _COSTS))
    run = _score(spark.sparkContext.broadcast((begins, mixers[1], n_classes, totals[0], totals[1])), parts)
    return blocks.unionByName(costs, allowMissingColumns=True).groupBy("block").applyInArrow(_grouped(run), _OUT)
