"""Token ids in compressed files: static range asymmetric numeral system.

One table of symbol frequencies, counted over the whole corpus, serves all blocks. A block holds the
ids of consecutive documents, dealt in turn to interleaved lanes with a coder state each, so that
numpy codes all lanes at once. Blocks are independent; inside one, a checkpoint (lane states and place
in the stream) with a checksum of the ids that follow stands before every segment, so that segments
decode in parallel or alone.

Files are Parquet with a row per block, in ascending order of doc_id within and between files; the
frequency table lies beside them. Spark's writers put both in place, so a lost executor leaves no half file.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = 1
LANES = 1024
#: Bytes of text tokenised at a time.
CHUNK = 8 << 20
#: Tokens between checkpoints, and the tokens at which a block ends.
SEGMENT, BLOCK = 1 << 18, 1 << 20
#: Frequencies add up to 2 to this power; states lie in [2^31, 2^63) and shed 32 bits at a time.
SCALE_BITS = 24
_LOW = np.uint64(1 << 31)


# --- the coder ---------------------------------------------------------------------------------


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies adding up to 2^bits, none 0 where the count is not."""
    freq = np.zeros(len(counts), np.int64)
    seen = counts > 0
    if not seen.any():
        return freq
    freq[seen] = np.maximum(1, counts[seen] * float(1 << bits) / counts.sum()).astype(np.int64)
    over = int(freq.sum() - (1 << bits))
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    for i in order:
        if over <= 0:
            break
        less = min(over, int(freq[i]) // 2)
        freq[i] -= less
        over -= less
    return freq


def encode(ids: np.ndarray, freq: np.ndarray, lanes: int = LANES, segment: int = SEGMENT) -> bytes:
    """A block: header, checkpoints, stream of 32-bit words."""
    f_all = freq.astype(np.uint64)
    start_all = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    segments = []
    for lo in range(0, len(ids), segment):
        part = ids[lo : lo + segment]
        f, c = f_all[part], start_all[part]
        state = np.full(lanes, _LOW, np.uint64)
        words = []
        # The decoder runs forwards, so the encoder runs backwards.
        for at in range((len(part) - 1) // lanes * lanes, -1, -lanes):
            fi, ci = f[at : at + lanes], c[at : at + lanes]
            n = len(fi)
            x = state[:n]
            full = x >= fi << np.uint64(63 - SCALE_BITS)
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
                x = np.where(full, x >> np.uint64(32), x)
            q = x // fi
            state[:n] = (q << np.uint64(SCALE_BITS)) + (x - q * fi) + ci
        stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
        segments.append((len(part), zlib.crc32(part.astype("<u4").tobytes()), state.astype("<u8").tobytes(), stream.tobytes()))
    head = struct.pack("<4sHHI", b"RANS", 1, lanes, len(segments))
    table = b"".join(struct.pack("<III", n, crc, len(stream) // 4) for n, crc, _, stream in segments)
    return head + table + b"".join(state for *_, state, _ in segments) + b"".join(s[3] for s in segments)


def segments_of(block: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """Tokens, checksum, states and stream from each checkpoint to the next."""
    magic, version, lanes, n = struct.unpack_from("<4sHHI", block)
    if magic != b"RANS" or version != 1:
        raise ValueError("not a block of token ids")
    rows = [struct.unpack_from("<III", block, 12 + 12 * i) for i in range(n)]
    at, out = 12 + 12 * n, []
    stream_at = at + 8 * lanes * n
    for i, (tokens, crc, words) in enumerate(rows):
        out.append((tokens, crc, block[at + 8 * lanes * i : at + 8 * lanes * (i + 1)], block[stream_at : stream_at + 4 * words]))
        stream_at += 4 * words
    return out


def slots(freq: np.ndarray) -> np.ndarray:
    """The starts of the symbols' ranges: a value's symbol is the last start not above it."""
    return np.concatenate(([0], np.cumsum(freq))).astype(np.int64)


@lru_cache(maxsize=1)
def _coarse(key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A symbol for each value of the range."""
    freq = np.frombuffer(key, np.int64)
    return np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq), slots(freq)[:-1].astype(np.uint64)


def decode_segment(tokens: int, crc: int, states: bytes, stream: bytes, freq: np.ndarray) -> np.ndarray:
    symbol, start_all = _coarse(freq.tobytes())
    f_all = freq.astype(np.uint64)
    state = np.frombuffer(states, "<u8").astype(np.uint64)
    lanes, words = len(state), np.frombuffer(stream, "<u4").astype(np.uint64)
    out, at, mask = np.empty(tokens, np.uint32), 0, np.uint64((1 << SCALE_BITS) - 1)
    for lo in range(0, tokens, lanes):
        n = min(lanes, tokens - lo)
        x = state[:n]
        value = x & mask
        s = symbol[value]
        out[lo : lo + n] = s
        x = f_all[s] * (x >> np.uint64(SCALE_BITS)) + value - start_all[s]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
        state[:n] = x
    if at != len(words) or zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a segment's checksum does not hold")
    return out


def decode(block: bytes, freq: np.ndarray) -> np.ndarray:
    parts = [decode_segment(*s, freq) for s in segments_of(block)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# --- tokenising --------------------------------------------------------------------------------


#: The normaliser and the pre-tokenizer for which texts may be taken apart (fixed values of the file's format).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordTokenizer:
    """Ids of texts by way of their words.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its
    words in order, and words repeat. Words of plain Latin-1 are cut into the pieces that the
    tokenizer's own pattern would make, and a copy of it without normaliser encodes each piece once;
    words with other characters go through the tokenizer as they are. All this holds for one normaliser and
    pre-tokenizer; a file with any other one encodes whole texts.
    """

    KEPT = 600_000

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path) as f:
            told = json.load(f)
        self.apart = told.get("normalizer") == _NORMALIZER and told.get("pre_tokenizer") == _PRE_TOKENIZER
        self.whole, self.pieces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.vocabulary = self.whole.get_vocab_size(with_added_tokens=True)
        self.dtype, self.kind = (np.uint16, "H") if self.vocabulary <= 1 << 16 else (np.uint32, "I")
        self.by_word: dict[str, bytes] = {}
        self.by_piece: dict[bytes, bytes] = {}
        if self.apart:
            self.pieces.normalizer = None
            self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)

    def _lists(self, strings: list, tokenizer, known: dict) -> tuple[np.ndarray, np.ndarray]:
        """The strings' ids one after another, and each one's first, by way of what is known of them. Bytes are Latin-1."""
        if len(known) > self.KEPT:
            known.clear()
        new = [s for s in strings if s not in known]
        plain = [s.decode("latin-1") if isinstance(s, bytes) else s for s in new]
        for s, e in zip(new, tokenizer.encode_batch_fast(plain, add_special_tokens=False), strict=True):
            known[s] = array(self.kind, e.ids).tobytes()
        per = [known[s] for s in strings]
        sizes = np.fromiter(map(len, per), np.int64, len(per)) // np.dtype(self.dtype).itemsize
        return np.frombuffer(b"".join(per), self.dtype), np.concatenate(([0], np.cumsum(sizes)))

    def _plain(self, words: pa.Array) -> np.ndarray:
        """Whether each word is of visible Latin-1 characters, without an apostrophe or a special token's name."""
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        raw = np.frombuffer(words.buffers()[2], np.uint8, ends[-1]) if len(ends) else np.zeros(0, np.uint8)
        odd = _ODD_BYTE[raw]
        odd[1:] |= (raw[:-1] == 0xC2) & _ODD_AFTER_C2[raw[1:]]
        before = np.concatenate(([0], np.cumsum(odd)))
        plain = np.diff(before[np.concatenate(([0], ends))]) == 0
        for s in self.special:
            plain &= ~pc.match_substring(words, s).to_numpy(zero_copy_only=False)
        return plain

    def words(self, words: pa.Array) -> pa.ListArray:
        """Each word's ids."""
        words = pa.concat_arrays([words])
        plain = self._plain(words)
        low = pc.utf8_lower(words.filter(pa.array(plain)))
        first = np.concatenate(([0], np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64))))
        raw = (low.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(low)).as_py()] if len(low) else b"").decode().encode("latin-1")
        kind = _KIND[np.frombuffer(raw, np.uint8)]
        # A piece is a run of letters, one digit, or a run of other signs.
        cut = np.ones(len(kind), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        cut[first[:-1]] = True
        starts = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        taken = _ragged(*self._lists(coded.dictionary.to_pylist(), self.pieces, self.by_piece)).take(coded.indices)
        own = _ragged(taken.values.to_numpy(), taken.offsets.to_numpy()[np.searchsorted(starts, first)])
        if plain.all():
            return own
        rest = _ragged(*self._lists(words.filter(pa.array(~plain)).to_pylist(), self.whole, self.by_word))
        return pa.concat_arrays([own, rest]).take(pa.array(np.where(plain, np.cumsum(plain) - 1, len(own) + np.cumsum(~plain) - 1)))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and the texts' numbers of ids."""
        n = len(texts)
        if not self.apart:
            lists = [[*e.ids, END] for e in self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for own in lists for i in own], self.dtype), np.array([len(own) for own in lists], np.int64)
        words, starts = common.split_words(texts)
        coded = words.dictionary_encode()
        per = self.words(coded.dictionary)
        # A text's end is one more word.
        code, ends = np.full(len(words) + n, len(per), np.int32), starts[1:] + np.arange(n)
        keep = np.ones(len(code), bool)
        keep[ends] = False
        code[keep] = coded.indices.to_numpy(zero_copy_only=False) if len(words) else []
        taken = pa.concat_arrays([per, _ragged(np.array([END], self.dtype), np.array([0, 1]))]).take(pa.array(code))
        return taken.values.to_numpy(), np.diff(taken.offsets.to_numpy()[ends + 1].astype(np.int64), prepend=0)


#: Of Latin-1 characters 0 for letters, 1 for digits and other numbers, 2 for the rest; and the bytes of UTF-8 that no plain word has.
_KIND = np.array([0 if c.isalpha() else 1 if unicodedata.category(c)[0] == "N" else 2 for c in map(chr, range(256))], np.uint8)
_ODD_BYTE = np.array([b <= 0x20 or b in (0x27, 0x7F) or b >= 0xC4 for b in range(256)])
_ODD_AFTER_C2 = np.array([b <= 0xA0 or b == 0xAD for b in range(256)])


def _ragged(flat: np.ndarray, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))


@lru_cache(maxsize=1)
def _tokenizer(name: str) -> WordTokenizer:
    import public_tokenizers

    return WordTokenizer(public_tokenizers.path(name))


_RAW = "part int, seq int, n_tokens long, start long, doc_ids binary, null_ids binary, lengths binary, ids binary"


def _raw_blocks(tokenizer: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part = _tokenizer(tokenizer), TaskContext.get().partitionId()
        held: list = []
        seq = done = size = 0

        def emit():
            ids, n, keys, nulls = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "n_tokens": len(ids), "start": done, "doc_ids": keys.astype("<i8").tobytes(), "null_ids": nulls.tobytes(), "lengths": n.astype("<u4").tobytes(), "ids": ids.astype("<u2" if tok.vocabulary <= 1 << 16 else "<u4").tobytes()}],
                pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("start", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "null_ids", "lengths", "ids")]]),
            )

        for chunk in common.text_chunks(batches, limit=CHUNK):
            keys = common.column_of(chunk, "doc_id")
            ids, n = tok.texts(common.texts_of(chunk))
            held.append((ids, n, pc.fill_null(keys, 0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)))
            size += len(ids)
            if size >= block:
                yield emit()
                done, seq, held, size = done + size, seq + 1, [], 0
        if held:
            yield emit()

    return run


def _ids(raw: bytes, vocabulary: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if vocabulary <= 1 << 16 else "<u4").astype(np.uint32)


def _counts(vocabulary: int):
    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for raw in b.column(0):
                total += np.bincount(_ids(raw.as_py(), vocabulary), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", block: int = BLOCK) -> None:
    """Tokenises every text (null: empty), ends it with id 1 and writes the ids below ``path``.

    Documents go in ascending order of doc_id, null ids first, repeated ids by a hash of their texts; by both they are cut into ranges, and by a
    running number, so that no id and no repeated row fills a task. Long texts are encoded whole, one at a time. An empty
    table makes files without blocks.
    """
    spark = docs.sparkSession
    keys = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "hash", "row"]
    ranged = keys.repartitionByRange(common.partitions(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    raw = ranged.mapInArrow(_raw_blocks(tokenizer, block), _RAW).checkpoint()  # keeps the partitions' order
    size = _tokenizer(tokenizer).vocabulary
    table = np.zeros(size, np.int64)
    for r in raw.select("ids").mapInArrow(_counts(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row per id of the vocabulary at most
        table[r["id"]] = r["n"]
    freq = scaled(table)
    offsets, before = {}, 0
    for r in raw.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row per partition
        offsets[r["part"]] = before
        before += r["n"]
    shared = spark.sparkContext.broadcast((freq, offsets))

    def pack(batches):
        freq, offsets = shared.value
        for b in batches:
            for r in b.to_pylist():
                out = {k: r[k] for k in ("part", "seq", "n_tokens", "doc_ids", "null_ids", "lengths")}
                out |= {"start": offsets[r["part"]] + r["start"], "block": encode(_ids(r["ids"], len(freq)), freq)}
                yield pa.RecordBatch.from_pylist([out], _packed)

    raw.mapInArrow(pack, _BLOCKS).write.parquet(f"{path}/blocks")
    kept = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame([(len(freq), -1), *kept], "id int, freq int").coalesce(1).write.parquet(f"{path}/frequencies")


_BLOCKS = "part int, seq int, start long, n_tokens long, doc_ids binary, null_ids binary, lengths binary, block binary"
_packed = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "null_ids", "lengths", "block")]])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document's), n_tokens and ids (32-bit, little-endian) of each document."""
    rows = spark.read.schema("id int, freq int").parquet(f"{path}/frequencies").collect()
    freq = np.zeros(next(r["id"] for r in rows if r["freq"] == -1), np.int64)
    for r in rows:
        if r["freq"] > 0:
            freq[r["id"]] = r["freq"]
    shared = spark.sparkContext.broadcast(freq)

    def unpack(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = decode(r["block"], shared.value).astype("<u4")
                n = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(n)
                raw = ids.tobytes()
                keys = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["null_ids"], np.uint8).astype(bool))
                each = pa.array([raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(r["start"] + ends - n), pa.array(n), each], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What the files hold of each document once written and read again: start, n_tokens and the ids' checksum."""
    path = path or common.shared_dir(docs.sparkSession)
    write(docs, path)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
