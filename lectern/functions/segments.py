"""The part of a newsletter's text that belongs to one of its stories, found by fuzzy anchors."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import islice

import numpy as np
import pandas as pd
from lectern.functions.vector import vectorised

_TOKEN = re.compile(r"[^\W_]+")
ANCHOR, LEAST, SLACK, TAIL = 14, 3, 6, 400


def _tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def _anchor(snippet: str) -> tuple[str, ...]:
    """The first words of a snippet; what follows them is not read."""
    return tuple(m.group().lower() for m in islice(_TOKEN.finditer(snippet), ANCHOR))


def _places(words: list) -> dict:
    """Of each word the places where it stands, as bits."""
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_length(a: list[str], b: list[str], places: dict | None = None) -> int:
    """Longest common subsequence, all places of b at once: a bit of ``open_`` is 0 where the length grows."""
    places = _places(b) if places is None else places
    full = (1 << len(b)) - 1
    open_ = full
    for x in a:
        if met := open_ & places.get(x, 0):
            open_ = (open_ + met | open_ - met) & full
    return len(b) - open_.bit_count()


def matches(body: list[tuple[str, int, int]], snippet: str) -> list[int]:
    """Where in the body an anchor begins: its first word stands there, and 60% of its words follow in order."""
    anchor = _anchor(snippet)
    if len(anchor) < LEAST:
        return []
    need = max(LEAST, -(-len(anchor) * 6 // 10))
    return [start for i, (t, start, _) in enumerate(body) if t == anchor[0] and common_length(anchor, [w for w, *_ in body[i : i + len(anchor) + SLACK]]) >= need]


def is_label(line: str) -> bool:
    line = line.strip()
    letters = [c for c in line if c.isalpha()]
    return 1 <= len(line) <= 32 and line[0] not in "-—" and bool(letters) and all(c.isupper() for c in letters)


def _without_label(part: str) -> str:
    """Without the last line, if that is a label."""
    kept = part.rstrip(" \t\n")
    line = kept.rfind("\n") + 1
    return part[:line] if is_label(kept[line:]) else part


def _without_lead_in(part: str, title: str) -> str:
    """Without the next story's title, if that stands in the last 400 bytes, and a label right before it."""
    title = " ".join((title or "").split())
    if len(title) < 4:
        return part
    tail = part.encode()[-TAIL:].decode(errors="ignore")
    at = tail.lower().rfind(title.lower())
    return _without_label(part[: len(part) - len(tail) + at]) if at >= 0 else part


def segment(text: str, siblings: list[tuple[int, str, str]], position: int) -> str:
    """The story's part of the text, '' if its anchor is not found. siblings: (position, snippet, title).

    Of several places where the anchor fits the one with the longest part wins; a part ends where the nearest
    other anchor begins. If the next story's title is found near its end, it ends there, without one label line before it.
    """
    body = _tokens(text)
    own = next((s for s in siblings if s[0] == position), None)
    starts = matches(body, own[1] or "") if own else []
    if not starts:
        return ""
    others = sorted((at, title) for p, snippet, title in siblings if p != position for at in matches(body, snippet or ""))
    best = ("", "")
    for start in starts:
        end, title = next(((at, t) for at, t in others if at > start), (len(text), ""))
        if end - start > len(best[0]):
            best = (text[start:end], title)
    return _trimmed(*best)


def _trimmed(part: str, title: str) -> str:
    return _without_lead_in(part, title).strip()


#: Anchors of one first word and length beyond which they are tried in numpy.
_MANY = 24


class _Anchors:
    """Which of many anchors begin at a word: those of its first word, tried by one length after another."""

    def __init__(self, anchors: list[tuple[str, ...]], words: list[str]):
        self.words, self.by = words, defaultdict(lambda: defaultdict(list))
        for i, anchor in enumerate(anchors):
            if len(anchor) >= LEAST:
                self.by[anchor[0]][len(anchor)].append(i)
        self.anchors, self.coded = anchors, {}
        if all(len(own) <= _MANY for by in self.by.values() for own in by.values()):
            return
        number = {w: i for i, w in enumerate(dict.fromkeys([*words, *(w for a in anchors for w in a)]))}
        self.ids, self.bits = np.array([number[w] for w in words], np.int64), np.zeros(len(number), np.int64)
        self.coded = {(w, n): (np.array(own), np.array([[number[x] for x in anchors[i]] for i in own])) for w, by in self.by.items() for n, own in by.items() if len(own) > _MANY}

    def at(self, i: int) -> np.ndarray:
        found = []
        for n, own in self.by[self.words[i]].items() if self.words[i] in self.by else ():
            window, need = self.words[i : i + n + SLACK], max(LEAST, -(-n * 6 // 10))
            if (many := self.coded.get((self.words[i], n))) is None:
                places = _places(window)
                found += [k for k in own if sum(map(places.__contains__, self.anchors[k])) >= need and common_length(self.anchors[k], window, places) >= need]
                continue
            ids = self.ids[i : i + n + SLACK]
            np.bitwise_or.at(self.bits, ids, 1 << np.arange(len(ids)))
            full = (1 << len(ids)) - 1
            open_ = np.full(len(many[0]), full)
            for column in many[1].T:
                met = open_ & self.bits[column]
                open_ = (open_ + met | open_ - met) & full
            self.bits[ids] = 0
            found += many[0][len(ids) - np.bitwise_count(open_) >= need].tolist()
        return np.array(found, np.int64)


def all_segments(text: str, siblings: list[tuple[int, str, str]]) -> list[str]:
    """What segment gives for each of the siblings, whose positions are distinct. Equal anchors are looked for once, and only at words that begin
    one; what begins at each place is told by a number, one witness and the two least titles, so that memory grows with the text."""
    words, groups = [w.lower() for w in _TOKEN.findall(text)], defaultdict(list)
    for k, (_, snippet, _) in enumerate(siblings):
        groups[_anchor(snippet or "")].append(k)
    own = list(groups.values())
    anchors = _Anchors(list(groups), words)
    held: dict[int, np.ndarray] = {}

    def at(i: int) -> np.ndarray:
        if i in held:
            return held[i]
        found = anchors.at(i)
        if len(found) <= _MANY:  # few are remembered, many are found again
            held[i] = found
        return found

    # Siblings by title; of each anchor the two least.
    order = sorted(range(len(siblings)), key=lambda k: (siblings[k][2], k))
    rank = np.empty(len(siblings), np.int64)
    rank[order] = np.arange(len(order))
    last = len(siblings)
    least = np.array([[*sorted(rank[k].item() for k in ks), last][:2] for ks in own], np.int64).reshape(-1, 2)
    alone = np.array([len(ks) == 1 for ks in own], bool)

    places, witness, titles = [], [], []
    for i, m in enumerate(_TOKEN.finditer(text)):
        if words[i] in anchors.by and len(found := at(i)):
            places.append((i, m.start()))
            witness.append(int(found[0]) if len(found) == 1 and alone[found[0]] else -1)
            best = found[np.argmin(least[found, 0])]
            others = found[found != best]
            titles.append((int(least[best, 0]), int(min(least[best, 1], least[others, 0].min(initial=last)))))
    # For each place the next one where not the same single anchor alone begins.
    onward = list(range(1, len(places) + 1))
    for j in range(len(places) - 2, -1, -1):
        if witness[j] >= 0 and witness[j] == witness[j + 1]:
            onward[j] = onward[j + 1]
    longest, begun, ended = (np.zeros(len(own), np.int64) for _ in range(3))
    end_of = lambda j: places[j][1] if j < len(places) else len(text)
    for j, (i, start) in enumerate(places):
        found = at(i)
        after = np.full(len(found), j + 1)
        if j + 1 < len(places) and witness[j + 1] >= 0:
            after[found == witness[j + 1]] = onward[j + 1]
        size = np.full(len(found), end_of(j + 1) - start)
        size[after != j + 1] = end_of(onward[j + 1]) - start if j + 1 < len(places) else 0
        more = size > longest[found]
        longest[found[more]], begun[found[more]], ended[found[more]] = size[more], start, after[more]
    out = [""] * len(siblings)
    for a, ks in enumerate(own):
        for k in ks if longest[a] else ():
            title = next((siblings[order[r]][2] for r in titles[ended[a]] if r < last and order[r] != k), "") if ended[a] < len(places) else ""
            out[k] = _trimmed(text[begun[a] : begun[a] + longest[a]], title)
    return out


@vectorised("string")
def segment_udf(text: pd.Series, siblings: pd.Series, position: pd.Series) -> pd.Series:
    """segment of each row; rows of one text that follow each other share the search for its anchors."""
    out, last, parts = [], None, None
    for t, sib, p in zip(text, siblings, position, strict=True):
        rows = [(s["position"], s["snippet"], s["title"]) for s in sib]
        if (t, rows) != last:
            last, places = (t, rows), [r[0] for r in rows]
            parts = dict(zip(places, all_segments(t or "", rows), strict=True)) if len(set(places)) == len(places) else None
        out.append(segment(t or "", rows, p) if parts is None else parts.get(p, ""))
    return pd.Series(out, dtype=object)


@vectorised("array<string>")
def segments_udf(text: pd.Series, siblings: pd.Series) -> pd.Series:
    return pd.Series([all_segments(t or "", [(s["position"], s["snippet"], s["title"]) for s in sib] if sib is not None else []) for t, sib in zip(text, siblings, strict=True)])
