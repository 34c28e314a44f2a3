"""Fill-in-middle: texts cut in prefix, middle and suffix, put in another order between sentinels.

A finite automaton over bytes, held as a table, follows UTF-8 continuation, the borders of units (code points) and the
sentinels' bytes at once. Its transitions carry counts: of units begun and of sentinels completed. Texts are scanned in
blocks, all blocks of a batch a byte at a time in numpy; a block inside a text is run from every state, and the blocks' maps
are then put one after another, so that a text of any length takes as many steps as a block has bytes. The second pass runs
the blocks that hold a cut once more, from their true state, to the byte where the cut's unit begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: What stands before prefix, suffix and middle (fixed values of the format).
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many stay plain, and of a hundred others so many begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of a block.
BLOCK = 4096
_UNIT, _SENTINEL = 1, 1 << 16


class Automaton:
    """``next`` and ``counts`` by 256 * state + byte; states in ``next`` are times 256 too. Counts have units in the low 16 bits,
    sentinels in the high ones. State 0 is the start; a byte that may not follow begins a unit of its own."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        if not all(s and s.isascii() for s in sentinels):
            raise ValueError("sentinels are ASCII and not empty")
        begun = sorted({s[:i] for s in sentinels for i in range(len(s))})  # proper beginnings, '' first
        state = {b: i for i, b in enumerate(begun)}
        open_ = len(begun)  # states open_ + k: k + 1 bytes of the unit are to come
        self.states = open_ + 3
        self.next, self.counts = np.zeros(256 * self.states, np.int64), np.zeros(256 * self.states, np.uint32)
        for s in range(self.states):
            for b in range(256):
                if s >= open_ and 0x80 <= b <= 0xBF:
                    to, count = (s - 1 if s > open_ else 0), 0
                elif b < 0x80:
                    seen = (begun[s] if s < open_ else "") + chr(b)
                    done = any(seen.endswith(x) for x in sentinels)
                    to = 0 if done else max((state[seen[i:]] for i in range(len(seen) + 1) if seen[i:] in state), key=lambda k: len(begun[k]))
                    count = _UNIT + _SENTINEL * done
                else:
                    more = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
                    to, count = (open_ + more - 1 if more else 0), _UNIT
                self.next[256 * s + b], self.counts[256 * s + b] = 256 * to, count


class Scan:
    """The first pass over texts (bytes one after another, and their first ones): ``units`` and ``sentinels`` of each text."""

    def __init__(self, table: Automaton, flat: np.ndarray, first: np.ndarray, block: int = BLOCK):
        self.table, self.flat, self.first, self.block = table, flat, first, block
        size = np.diff(first)
        per = -(-size // block)
        self.head = np.concatenate(([0], np.cumsum(per)))  # each text's first block
        of = np.repeat(np.arange(len(size)), per)
        nth = np.arange(len(of)) - self.head[of]
        self.at = first[of] + nth * block
        self.size = np.minimum(block, first[of + 1] - self.at)
        # The first block of a text is run from the start state, the others from every state.
        runs = np.where(nth == 0, 1, table.states)
        lane = np.concatenate(([0], np.cumsum(runs)))
        own = np.repeat(np.arange(len(of)), runs)
        end, count = self._run(self.at[own], self.size[own], 256 * (np.arange(lane[-1]) - lane[own]))
        self.state, counts = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        for n in range(int(per.max(initial=0))):  # the blocks' maps one after another, all texts at once
            k = self.head[:-1][per > n] + n
            took = lane[k] + self.state[k] // 256
            counts[k] = count[took]
            on = per[of[k]] > n + 1
            self.state[k[on] + 1] = end[took[on]]
        self.before = np.concatenate(([0], np.cumsum(counts & (_SENTINEL - 1))))
        self.units = np.diff(self.before[self.head])
        self.sentinels = np.diff(np.concatenate(([0], np.cumsum(counts >> 16)))[self.head])

    def _run(self, at: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states and the counts after blocks that begin in the given states."""
        order = np.argsort(-size, kind="stable")
        at, state, count = at[order], state[order], np.zeros(len(at), np.uint32)
        left = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")  # blocks longer than j
        for j, n in enumerate(left.tolist()):
            step = state[:n] + self.flat[at[:n] + j]
            count[:n] += self.table.counts[step]
            state[:n] = self.table.next[step]
        out = np.empty(len(at), np.int64), np.empty(len(at), np.uint32)
        out[0][order], out[1][order] = state, count
        return out

    def offsets(self, text: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The second pass: the byte of each text at which the given unit begins; its end for the number of its units."""
        out = np.diff(self.first)[text]
        inner = np.flatnonzero(unit < self.units[text])
        goal = self.before[self.head[text[inner]]] + unit[inner]
        k = np.searchsorted(self.before, goal, side="right") - 1
        at, state, left = self.at[k], self.state[k], goal - self.before[k]
        for j in range(self.block):
            if not len(inner):
                break
            step = state + self.flat[at + j]
            left = left - (self.table.counts[step] & 1)
            found = left < 0
            if found.any():
                out[inner[found]] = at[found] + j - self.first[text[inner[found]]]
                keep = ~found
                inner, at, state, left, step = inner[keep], at[keep], state[keep], left[keep], step[keep]
            state = self.table.next[step]
        return out


def drawn(key: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first digits of the SHA-256 of seed and id (nothing for a null id)."""
    d = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(d[i : i + 4], "big") for i in (0, 4, 8, 12))


def restore(output: bytes, form: str, sentinels: tuple[str, ...] = SENTINELS) -> bytes:
    """The text of an output; ValueError if it has not the form."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in sentinels)
    order = (p, s, m) if form == "psm" else (s, p, m)
    if form not in ("psm", "spm") or not output.startswith(order[0]):
        raise ValueError("not an output of this form")
    second = output.index(order[1], len(order[0]))
    third = output.index(order[2], second + len(order[1]))
    one, two, middle = output[len(order[0]) : second], output[second + len(order[1]) : third], output[third + len(order[2]) :]
    return one + middle + two if form == "psm" else two + middle + one


def _cut(chunk: pa.RecordBatch, table: Automaton, seed: int, sentinels: tuple[str, ...]) -> Iterator[tuple]:
    """doc_id, n, form, units of prefix and middle (None if plain), output of each row."""
    keys = common.column_of(chunk, "doc_id").to_pylist()
    flat, first = common.flat_bytes(common.texts_of(chunk))
    scan = Scan(table, flat, first)
    h = np.array([drawn(k, seed) for k in keys], np.int64).reshape(-1, 4)
    n = scan.units
    plain = (n == 0) | (scan.sentinels > 0) | (h[:, 2] % 100 >= 100 - PLAIN)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    moved = np.flatnonzero(~plain)
    byte = np.zeros((len(keys), 2), np.int64)
    byte[moved] = scan.offsets(np.repeat(moved, 2), cuts[moved].ravel()).reshape(-1, 2)
    data = flat.tobytes()
    p, s, m = (x.encode() for x in sentinels)
    for i, key in enumerate(keys):
        text = data[first[i] : first[i + 1]]
        if plain[i]:
            yield key, int(n[i]), "plain", None, None, text
            continue
        a, b = byte[i].tolist()
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        form = "spm" if h[i, 3] % 100 < SUFFIX_FIRST else "psm"
        out = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
        yield key, int(n[i]), form, int(cuts[i, 0]), int(cuts[i, 1] - cuts[i, 0]), out


_ROW = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def transform(docs: DataFrame, seed: int = 1, sentinels: tuple[str, ...] = SENTINELS, digest: bool = False) -> DataFrame:
    """Of each row doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars and the output.

    Null texts count as empty and stay plain, as do texts that hold a sentinel. Rows with one id are cut at places drawn
    alike; a null id draws as an empty one. Texts of any length are cut in memory of about ten times their bytes. Other
    columns are ignored. With ``digest`` the SHA-256 of the output, and of the text restored from it, stand for the output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Automaton(sentinels)
        for chunk in common.text_chunks(batches):
            rows = []
            for *told, out in _cut(chunk, table, seed, sentinels):
                rows.append((*told, hashlib.sha256(out).hexdigest(), hashlib.sha256(restore(out, told[2], sentinels)).hexdigest()) if digest else (*told, out.decode(errors="replace")))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    schema = f"{_ROW}, output_sha256 string, restored_sha256 string" if digest else f"{_ROW}, output string"
    names = [c.split()[0] for c in schema.split(", ")]
    return common.bounded(docs.select("doc_id", "text")).mapInArrow(run, schema)
