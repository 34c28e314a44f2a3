"""Language identification by prediction by partial matching.

For each language the training texts' bytes make a variable-order context tree of frozen counts: after each
context of up to ORDER bytes, how often each byte followed. A byte that the longest context has not seen is
coded with that context's escape probability and then by the next shorter one. A text's exact code length
under each language's tree decides. The trees are sparse sorted tables over all 256 bytes: a row of code lengths
by language, escapes included, for each string of ORDER + 1 bytes and less that any language has, and a row of
escapes' lengths for each context. They grow with the distinct strings of the samples and with the languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of context, symbols of the test for noise (the commonest bytes of the sample, and one for all rarer ones), and about
#: how many labelled documents per language the trees are fitted to, taken by a hash of the id.
ORDER, SYMBOLS, SAMPLE = 3, 48, 4000
#: Different values of lang at most: the trees and tables are held per language, so that dirty labels raise an error.
LANGUAGES = 2000
UNKNOWN = "und"
#: keep_known's test: a text is noise in no learned language if its best code takes this many bits per byte, and so many in all beyond
#: that, as a short text of odd words is none. A byte that is rare in the samples counts log2(SYMBOLS) = 5.6 bits at most, so
#: that a script not learned is no noise.
NOISE_BITS, EVIDENCE = 7.0, 100.0


def held_out(column="doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, lower case, and each text's first."""
    low = pc.utf8_lower(texts)
    low = low if low.offset == 0 else pa.concat_arrays([low])
    ends = np.cumsum(pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64))
    first = np.concatenate(([0], ends))
    raw = low.buffers()[2]
    begin = int(np.frombuffer(low.buffers()[1], np.int32, 1)[0]) if len(low) else 0
    return (np.frombuffer(raw, np.uint8, first[-1], begin) if first[-1] else np.zeros(0, np.uint8)), first


def _codes(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each byte, in the lowest place, together with the ones before; before a text stand spaces."""
    out = data.astype(np.uint32)
    for k in range(1, ORDER + 1):
        before = np.full(len(data), 32, np.uint32)
        before[k:] = data[:-k]
        for j in range(k):  # near a text's start the bytes before belong to another text
            at = first[:-1] + j
            before[at[at < first[1:]]] = 32
        out |= before << np.uint32(8 * k)
    return out


def _suffix(codes: np.ndarray, k: int) -> np.ndarray:
    return codes & np.uint32((1 << 8 * (k + 1)) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted keys the wanted ones stand, and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _tree(codes: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Of one language, for each order: strings, the code length of their last byte, contexts, the length of their escape."""
    out = []
    for k in range(ORDER + 1):
        strings, at = np.unique(_suffix(codes, k), return_inverse=True)
        c = np.bincount(at, counts)
        contexts, at = np.unique(strings >> np.uint32(8), return_inverse=True)
        n, kinds = np.bincount(at, c), np.bincount(at)
        out.append((strings, np.log2((n + kinds)[at] / c), contexts, np.log2((n + kinds) / kinds)))
    return out


class Model:
    """Languages, and for each order sorted strings with rows of code lengths and sorted contexts with rows of escapes.
    rare: the bytes that are not among the commonest."""

    def __init__(self, languages: list[str], trees: list[list[tuple]], rare: np.ndarray):
        self.languages, self.rare, self.orders = languages, rare, []
        for k in range(ORDER + 1 if trees else 0):
            strings, contexts = (np.unique(np.concatenate([t[k][i] for t in trees])) for i in (0, 2))
            lengths, escapes = (np.zeros((len(x), len(languages)), np.float32) for x in (strings, contexts))
            shorter = self.lengths(_suffix(strings, k - 1), k - 1)
            for i, tree in enumerate(trees):
                own, bits, own_contexts, escape = tree[k]
                at, has = _find(own_contexts, contexts)
                escapes[has, i] = escape[at[has]]
                at, has = _find(own, strings)
                lengths[:, i] = np.where(has, bits[at], escapes[np.searchsorted(contexts, strings >> np.uint32(8)), i] + shorter[:, i])
            self.orders.append((strings, lengths, contexts, escapes))

    def lengths(self, codes: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Code lengths by language of the last byte of strings of k + 1 bytes."""
        if k < 0:
            return np.full((len(codes), len(self.languages)), 8, np.float32)
        strings, lengths, contexts, escapes = self.orders[k]
        if not len(strings):
            return self.lengths(_suffix(codes, k - 1), k - 1)
        at, has = _find(strings, codes)
        out = lengths[at]
        new = np.flatnonzero(~has)
        if len(new):
            out[new] = self.lengths(_suffix(codes[new], k - 1), k - 1)
            at, has = _find(contexts, codes[new] >> np.uint32(8))
            out[new[has]] += escapes[at[has]]
        return out

    def bits(self, texts: pa.Array, noise: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text under each language, and the texts' bytes. noise: a rare byte takes log2(SYMBOLS) at most."""
        data, first = _bytes(texts)
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(np.diff(first))
        step = 1 << 19
        at = 0
        while at < len(full):
            stop = max(at + 1, int(np.searchsorted(first[full], first[full[at]] + step)))
            own = full[at:stop]
            lo, hi = int(first[own[0]]), int(first[own[-1] + 1])
            cuts = np.append(first[own] - lo, hi - lo)
            coded = pa.array(_codes(data[lo:hi], cuts)).dictionary_encode()
            distinct = coded.dictionary.to_numpy()
            table, rows = self.lengths(distinct), coded.indices.to_numpy()
            if noise:
                rare = self.rare[distinct & np.uint32(255)]
                table[rare] = np.minimum(table[rare], np.float32(np.log2(SYMBOLS)))
            for i in range(len(self.languages)):
                out[own, i] = np.add.reduceat(table[:, i].copy().take(rows), cuts[:-1], dtype=np.float64)
            at = stop
        return out, np.diff(first)


def train(docs: DataFrame, sample: int = SAMPLE, everything: bool = False, strict: bool = True) -> Model:
    """Fits the trees to about ``sample`` documents of each language among those not held out, or among all. More languages than LANGUAGES
    raise an error, or if not ``strict`` give a model of none."""
    usable = docs.select("doc_id", "text", "lang").filter((F.lit(everything) | ~F.coalesce(held_out(), F.lit(False))) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counted) > LANGUAGES and not strict:
        return Model([], [], np.zeros(256, bool))
    if len(counted) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    languages = sorted(counted)
    if not languages:
        return Model([], [], np.zeros(256, bool))
    most = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / counted[lang])))])
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("langid")), 11) / F.lit(float(1 << 53))
    fit = common.stored(usable.filter(unit < most[F.col("lang")]).select("lang", "text").repartition(8))

    def grams(batches):
        total: dict = {}
        for chunk in common.text_chunks(batches, 1 << 20):
            names = common.column_of(chunk, "lang").to_numpy(zero_copy_only=False)
            for lang in set(names):
                texts = common.texts_of(chunk).filter(pa.array(names == lang))
                data, first = _bytes(texts)
                codes, counts = np.unique(_codes(data, first), return_counts=True)
                total.setdefault(lang, []).append((codes, counts))
        for lang, parts in total.items():
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([codes.astype("<u4").tobytes()]), pa.array([counts.astype("<i4").tobytes()])], ["lang", "codes", "counts"])

    found: dict = {lang: [] for lang in languages}
    for r in fit.mapInArrow(grams, "lang string, codes binary, counts binary").collect():
        found[r["lang"]].append((np.frombuffer(r["codes"], "<u4"), np.frombuffer(r["counts"], "<i4")))
    trees, n = [], np.zeros(256)
    for lang in languages:
        codes, counts = (np.concatenate([x[i] for x in found[lang]]) if found[lang] else np.zeros(0, t) for i, t in enumerate((np.uint32, np.int32)))
        trees.append(_tree(codes, counts))
        n += np.bincount(codes & np.uint32(255), counts, 256)
    rare = np.ones(256, bool)
    rare[np.argsort(-n, kind="stable")[: SYMBOLS - 1]] = False
    return Model(languages, trees, rare)


_OUT = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """lang_pred, its posterior probability (all languages alike beforehand) and the bits per byte of its code.

    A text that is null or has no letter is ``und`` with score 0, and so is everything if nothing could be
    learned. Ties go to the language first in order. Repeated rows get equal results; a row without an id
    is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in common.text_chunks(batches, 1 << 20):
            texts = common.texts_of(chunk)
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            names, score, rate = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
            if m.languages:
                bits, size = m.bits(texts)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(best)), best]
                with np.errstate(under="ignore"):
                    p = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                names[letters] = np.array(m.languages, object)[best[letters]]
                score[letters], rate[letters] = p[letters], (least / np.maximum(size, 1))[letters]
            yield pa.RecordBatch.from_arrays([common.column_of(chunk, "doc_id"), common.column_of(chunk, "held_out"), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return common.bounded(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(run, _OUT)


def keep_known(docs: DataFrame, model: Model | None = None, noise: float = NOISE_BITS) -> DataFrame:
    """The documents with a language, with the columns they came with: those with no letter go, and those
    of which the best language's code takes ``noise`` bits a byte and EVIDENCE more, or above that. If no row has a language to learn
    from, only texts without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in common.text_chunks(batches, 1 << 20):
            texts = common.texts_of(chunk)
            known = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            if m.languages:
                bits, size = m.bits(texts, noise=True)
                known = known & (bits.min(axis=1) < noise * np.maximum(size, 1) + EVIDENCE)
            yield chunk.filter(pa.array(known))

    return common.mapped(common.bounded(docs), run)
