"""Personal data by aggregated weak supervision.

Fixed patterns find the base spans, which are always kept. Looser patterns find candidate spans, on which
labelers vote: patterns with checks, gazetteers (key words, domains, card ranges) and the context of the
span. Candidates are counted over the whole corpus by their votes and features, of which there is a bounded
number of combinations; expectation-maximisation estimates each labeler's reliability from the counts and
gives every combination the probability of being personal data, and a logistic classifier trained on these
probabilities decides on the spans. One pass reads the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
#: The base patterns. Fixed values.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the scans below use of them: an address's part before and after its sign, numbers held together by points.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD, _PHONE, _DIGIT = re.compile(PATTERNS["card"]), re.compile(PATTERNS["phone"]), re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _addresses(text: str, sign: re.Pattern, domain: re.Pattern, gap: int = 0) -> Iterator[tuple[int, int]]:
    """Leftmost addresses around each sign, in time that grows with the text: an address's first part is the
    run of its characters right before the sign (or before one blank, if ``gap`` is 1)."""
    done = 0
    for m in sign.finditer(text):
        at = m.start() - (gap and text[m.start() - 1 : m.start()] == " " and m.start() > done)
        start = done + len(text[done:at].rstrip(_LOCAL)) if at - done < 256 else _run_start(text, done, at)
        if start < at and (after := domain.match(text, m.end())):
            yield start, after.end()
            done = after.end()


def _run_start(text: str, low: int, at: int) -> int:
    """Where the run of an address's characters that ends at a place begins, by steps that double."""
    step = 256
    while True:
        begin = max(low, at - step)
        left = len(text[begin:at].rstrip(_LOCAL))
        if left or begin == low:
            return begin + left
        step *= 2


def _small(number: str) -> bool:
    """Whether a number of any length is at most 255."""
    n = number.lstrip("0")
    return len(n) <= 3 and int(n or 0) <= 255


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four numbers in a row of those that points hold together, from the left."""
    for m in _CHAIN.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                yield at, at + size
            at += size + 1


_AT = re.compile("@")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as listed, then start; ends are exclusive, in code points. They are those of
    PATTERNS, found in time that grows with the text."""
    out = []
    if "@" in text:
        out += [("email", *x) for x in _addresses(text, _AT, _DOMAIN)]
    if _DIGIT.search(text):
        out += [("ip", *x) for x in _ips(text)]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# --- candidates and labelers -------------------------------------------------------------------

#: Looser patterns by kind, each with what a text must hold for it to be tried; the span is the group ``v`` if there is one.
LOOSE = (
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\)[ ]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-]|\.[0-9])"), _DIGIT),
    ("card", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}[ -][0-9]{4,6}[ -][0-9]{4,5}(?:[ -][0-9]{1,4})?(?![0-9A-Za-z-]|\.[0-9])"), _DIGIT),
    ("national_id", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), re.compile(r"[0-9]-[0-9]{2}-")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){3,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"), re.compile(r"[A-Z]{2}[0-9]{2}")),
    ("secret", re.compile(r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|private[_-]?key))[\"']?[ ]{0,2}(?:=>|[=:])[ ]{0,2}(?:\"(?P<v>[^\s\"]{6,})\"|'(?P<w>[^\s']{6,})'|(?P<x>[^\s\"',;]{6,}))"), re.compile("pass|pwd|secret|token|key", re.I)),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z_-]{20,}|(?<![_-])eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+)(?![0-9A-Za-z])"), re.compile(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|eyJ")),
    ("secret", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[0-9A-Za-z+/=\s]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"), re.compile("PRIVATE KEY-----")),
)
#: Addresses whose sign or points are written out.
_WRITTEN_AT = re.compile(r"(?:\(at\)|\[at\]|\{at\})[ ]?", re.I)
_WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:[ ]?(?:\.|\(dot\)|\[dot\]|\{dot\})[ ]?[A-Za-z0-9-]+)+", re.I)
#: How issued credentials begin. Fixed values.
_ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "eyJ", "-----BEGIN")
#: Gazetteers: words near a span that name its kind.
NEAR = {
    "email": {"mail", "email", "e-mail", "contact", "write", "courriel", "correo"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"},
    "national_id": {"ssn", "social", "security", "passport", "id"},
    "iban": {"iban", "account", "konto", "compte", "cuenta", "bank"},
    "secret": {"password", "token", "key", "secret", "aws", "api"},
}
KINDS = tuple(NEAR)
COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE".split())
LABELERS = ("pattern", "near", "values", "context")


def _valid(kind: str, s: str) -> int:
    """The pattern labeler's vote: 1 for, -1 against, 0 none. Checks what the kind allows to be checked."""
    digits = _digits(s)
    if kind == "card":
        return 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    if kind == "phone":
        return 1 if 9 <= len(digits) <= 12 and len(set(digits)) > 2 else -1
    if kind == "national_id":
        return 1 if digits[:3] not in ("000", "666") and digits[:3] < "900" and digits[3:5] != "00" else -1
    if kind == "iban":
        t = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1 else -1
    if kind == "secret":
        return 1 if any(c.isdigit() for c in s[:4096]) and len(set(s[:4096])) > 7 else 0
    return 1


def _listed(kind: str, s: str) -> int:
    """The gazetteer labeler on the value itself."""
    if kind == "card":
        return 1 if s[0] in "3456" else -1
    if kind == "iban":
        return 1 if s[:2] in COUNTRIES else -1
    if kind == "email":
        return 1 if re.search(r"(?:com|org|net|edu|de|fr|es)\Z", s, re.I) else 0
    if kind == "secret":
        return 1 if s.startswith(_ISSUED) else 0
    return 0


def _setting(text: str, start: int, end: int) -> int:
    """The context labeler: numbers on both sides, or a table cell's bars, speak against."""
    before, after = text[max(0, start - 12) : start].split(), text[end : end + 12].split()
    last, follow = (before or [""])[-1], (after or [""])[0]
    if _DIGIT.match(last[-1:]) and _DIGIT.match(follow[:1]) or last == "|":
        return -1
    return 1 if last[-1:] in (":", "=", '"') and last else 0


def _loose(text: str) -> Iterator[tuple[str, int, int]]:
    if _WRITTEN_AT.search(text):
        yield from (("email", *x) for x in _addresses(text, _WRITTEN_AT, _WRITTEN_DOMAIN, 1))
    for kind, pattern, needs in LOOSE:
        if needs.search(text):
            for m in pattern.finditer(text):
                group = next((g for g in "vwx" if m[g]), 0) if "v" in pattern.groupindex else 0
                yield kind, *m.span(group)


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, combination): spans by looser patterns with their kind's, votes' and features' number.
    Of spans of one kind that overlap the first and longest stays."""
    out, last = [], {}
    for kind, start, end in sorted(_loose(text), key=lambda x: (x[1], -x[2])):
        if start < last.get(kind, 0):
            continue
        last[kind] = end
        s = text[start:end]
        words = {w.strip(".,;:()=\"'").lower() for w in re.split(r"[\s=:]+", text[max(0, start - 40) : start])[-4:]}
        votes = (_valid(kind, s), 1 if words & NEAR[kind] else 0, _listed(kind, s), _setting(text, start, end))
        shape = (int(" " in s or "-" in s), int(len(s) > 16))
        number = KINDS.index(kind)
        for v in votes:
            number = number * 3 + v + 1
        out.append((kind, start, end, (number * 2 + shape[0]) * 2 + shape[1]))
    return out


def _apart(found: list[tuple], own: list[tuple[str, int, int]]) -> list[tuple]:
    """The candidates that no base span meets."""
    if not own:
        return found
    own, reach = sorted(own, key=lambda x: x[1]), []
    for *_, end in own:
        reach.append(max(end, reach[-1] if reach else 0))
    starts = [x[1] for x in own]
    return [c for c in found if not (i := bisect_left(starts, c[2])) or reach[i - 1] <= c[1]]


COMBINATIONS = len(KINDS) * 3 ** len(LABELERS) * 4


def features() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each combination: kind, votes (a column per labeler) and the classifier's inputs."""
    n = np.arange(COMBINATIONS)
    shape = np.stack([n // 2 % 2, n % 2], 1)
    rest, votes = n // 4, []
    for _ in LABELERS:
        votes.append(rest % 3 - 1)
        rest = rest // 3
    votes = np.stack(votes[::-1], 1)
    x = np.concatenate([np.ones((len(n), 1)), (votes == 1), (votes == -1), shape, np.eye(len(KINDS))[rest]], 1).astype(float)
    return rest, votes, x


def aggregate(counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over the combinations' counts: the probability that a combination is personal
    data, and the labelers' reliabilities (of a yes and a no, given personal data or not, by labeler)."""
    kind, votes, _ = features()
    p = 1 / (1 + np.exp(-(0.5 + 1.5 * votes.sum(axis=1))))  # the majority's first guess
    rely = np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        share = np.array([(1 + (counts * p)[kind == k].sum()) / (2 + counts[kind == k].sum()) for k in range(len(KINDS))])
        for j in range(len(LABELERS)):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                # A labeler is held to be better than chance, which keeps the two classes from changing places.
                rely[j, 1, v + 1] = (counts * p)[at].sum() + (4.0, 2.0, 8.0)[v + 1]
                rely[j, 0, v + 1] = (counts * (1 - p))[at].sum() + (8.0, 2.0, 2.0)[v + 1]
        rely /= rely.sum(axis=2, keepdims=True)
        logit = np.log(share[kind] / (1 - share[kind]))
        for j in range(len(LABELERS)):
            logit = logit + np.log(rely[j, 1, votes[:, j] + 1] / rely[j, 0, votes[:, j] + 1])
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, rely


def train(counts: np.ndarray, steps: int = 500) -> np.ndarray:
    """The classifier's probability of each combination: logistic regression on the aggregated labels."""
    p, _ = aggregate(counts)
    x = features()[2]
    w, weight = np.zeros(x.shape[1]), counts / max(1.0, counts.sum())
    for _ in range(steps):
        q = 1 / (1 + np.exp(-x @ w))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (p - q)) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-x @ w))


# --- over documents ----------------------------------------------------------------------------

_FOUND = "doc_id long, base array<struct<kind:string,start:int,end:int>>, loose array<struct<kind:string,start:int,end:int,combination:int>>"
_SPAN = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.list_(pa.struct(_SPAN)), pa.list_(pa.struct([*_SPAN, ("combination", pa.int32())]))]
    for chunk in common.text_chunks(batches):
        base, loose = [], []
        for text in common.texts_of(chunk).to_pylist():
            own = base_spans(text)
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
            # Candidates that a base span already covers add nothing.
            loose.append([{"kind": k, "start": s, "end": e, "combination": c} for k, s, e, c in _apart(candidates(text), own)] if text else [])
        yield pa.RecordBatch.from_arrays([common.column_of(chunk, "doc_id"), pa.array(base, types[1]), pa.array(loose, types[2])], ["doc_id", "base", "loose"])


def spans(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, base spans and added spans (those whose probability is at least ``least``, with it) of every row.

    A null or empty text has none. Repeated rows get equal spans. All scans take time in proportion to the
    text, however long it is and whatever runs it holds.
    """
    found = common.stored(docs.select("doc_id", "text").mapInArrow(_find, _FOUND))
    counts = np.zeros(COMBINATIONS)
    for r in found.select(F.explode("loose.combination").alias("c")).groupBy("c").count().collect():  # a row per combination at most
        counts[r["c"]] = r["count"]
    odds = train(counts)
    likely = {int(c): float(odds[c]) for c in np.flatnonzero((counts > 0) & (odds >= least))}
    table = F.create_map(*[F.lit(x) for pair in likely.items() for x in pair]) if likely else F.lit(None).cast("map<int,double>")
    chosen = F.filter(F.transform("loose", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), table[x["combination"]].alias("p"))), lambda x: x["p"].isNotNull())
    return found.select("doc_id", "base", chosen.alias("added"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, all spans as text, and their number (``n_spans``)."""
    joined = F.expr("concat_ws(',', transform(base, x -> concat_ws(':', x.kind, x.start, x.end)))")
    order = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate((*BASE, *(k for k in KINDS if k not in BASE)))) + " end"
    of = lambda v: order.replace("case kind", f"case {v}.kind")
    every = F.expr(
        "concat_ws(',', transform(array_sort(concat(transform(base, x -> struct(x.kind as kind, x.start as start, x.end as end)), transform(added, x -> struct(x.kind as kind, x.start as start, x.end as end))),"
        f" (a, b) -> case when ({of('a')}) <> ({of('b')}) then ({of('a')}) - ({of('b')}) when a.start <> b.start then a.start - b.start else a.end - b.end end), x -> concat_ws(':', x.kind, x.start, x.end)))"
    )
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return spans(docs).select("doc_id", *counts, F.sha2(joined, 256).alias("base_sha256"), every.alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
