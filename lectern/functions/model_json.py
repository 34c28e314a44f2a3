"""Items from a language model's answer: whole, wrapped, fenced, cut off."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.markup import BLANK
from lectern.functions.repair import repaired
from lectern.functions.vector import vectorised

from .text import KINDS, RESERVED_TOPICS

ITEM = "struct<position:int,title:string,snippet:string,url:string,kind:string,section:string,summary:string,relevance_score:int,primary_topic:string,labels:array<string>>"
SCHEMA = f"struct<outcome:string,recovered:int,items:array<{ITEM}>>"
WRAPPERS = ("items", "stories", "results", "segments", "data")
_DECODER = json.JSONDecoder(parse_constant=lambda name: _bad(name))
_STRINGS = ("title", "snippet", "url", "kind", "section", "summary", "primary_topic")


def _bad(name: str):
    raise ValueError(f"{name} is no JSON")


def _value(text: str):
    """The first JSON value of a text; ValueError for none."""
    try:
        return _DECODER.raw_decode(text)[0]
    except RecursionError:
        raise ValueError("too deep") from None


def unfenced(text: str) -> str:
    """What a code fence holds: from its first line's end to the last fence, or the end."""
    if not text.startswith("```") or "\n" not in text:
        return text
    inner = text.partition("\n")[2]
    return (inner[: inner.rindex("```")] if "```" in inner else inner).strip(BLANK)


def flexible_int(v) -> int:
    """A number, or a text of one, half up and then toward zero; 0 for anything else, and for what 64 bits can't hold."""
    try:
        n = float(v.strip(BLANK) if isinstance(v, str) else v) + 0.5 if not isinstance(v, bool) else 0
        return int(n) if math.isfinite(n) and abs(n) < 2**63 else 0
    except (TypeError, ValueError, OverflowError):
        return 0


def _labels(v) -> list[str]:
    found: dict[str, str] = {}
    for x in [v] if isinstance(v, str) else v if isinstance(v, list) else []:
        if isinstance(x, str) and x.strip(BLANK):
            found.setdefault(x.strip(BLANK).lower(), whole(x.strip(BLANK)))
    return list(found.values())[:5]


def whole(x: str) -> str:
    """Halves of surrogate pairs, which JSON can name and UTF-8 can't hold, become the replacement character."""
    return x if x.isascii() else x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _item(raw, position: int) -> dict | None:
    """The element as an item; None if it is no object, has a wrong type or neither title nor snippet. Title, snippet and
    summary are repaired, then cut."""
    if not isinstance(raw, dict):
        return None
    raw = {k.lower(): v for k, v in raw.items()}
    if any(raw.get(k) is not None and not isinstance(raw[k], str) for k in _STRINGS):
        return None
    s = {k: whole(raw.get(k) or "") for k in _STRINGS}
    s = {k: repaired(x) if k in ("title", "snippet", "summary") else x.strip(BLANK) for k, x in s.items()}
    if not s["title"] and not s["snippet"]:
        return None
    kind = s["kind"].lower()
    return {
        "position": position, "title": s["title"], "snippet": s["snippet"][:1000], "url": s["url"] if s["url"].startswith(("http://", "https://")) else "",
        "kind": kind if kind in KINDS else "story", "section": s["section"], "summary": s["summary"][:800], "relevance_score": max(0, min(100, flexible_int(raw.get("relevance_score")))),
        "primary_topic": "" if s["primary_topic"].lower() in RESERVED_TOPICS else s["primary_topic"], "labels": _labels(raw.get("labels")),
    }


#: What parts an object's inside: brackets, commas, and strings as a whole, the last of which may be open.
_BEGIN = re.compile(r"[{\]]")
_PARTS = re.compile(r'"(?:[^"\\]|\\.)*+"?|[\[\]{},]', re.DOTALL)


def salvage(text: str) -> tuple[list[str], bool]:
    """The objects of an array's text, and whether it is closed. Of an object that is cut off its members before the last comma
    are told, if they are whole."""
    out, at = [], 1
    while True:
        begin = _BEGIN.search(text, at)
        if not begin or begin[0] == "]":
            return out, bool(begin)
        at = begin.start()
        braces = depth = 0
        comma = -1
        for m in _PARTS.finditer(text, at):
            c = m[0]
            braces += (c == "{") - (c == "}")
            depth += (c in "[{") - (c in "]}")
            if not braces:
                out.append(text[at : m.end()])
                at = m.end()
                break
            if c == "," and depth == 1:
                comma = m.start()
        else:
            if comma > 0:
                try:
                    json.loads(part := text[at:comma] + "}", parse_constant=_bad)
                    out.append(part)
                except (ValueError, RecursionError):
                    pass
            return out, False


def _elements(text: str) -> tuple[list, bool]:
    """The elements of an answer, and whether it is cut off; ValueError if there are none to be had."""
    try:
        value = _value(text)
    except ValueError:
        if text.startswith("["):
            parts, closed = salvage(text)
            if not closed:
                return [_or_none(p) for p in parts], True
        raise
    if value is None or isinstance(value, list):
        return value or [], False
    if not isinstance(value, dict):
        raise ValueError("neither array nor object")
    arrays = {k: v or [] for k, v in value.items() if v is None or isinstance(v, list)}
    if arrays:
        return arrays[next((k for k in WRAPPERS if k in arrays), min(arrays))], False
    if "title" in value or "relevance_score" in value:
        return [value], False
    raise ValueError("no array of items")


def _or_none(text: str):
    try:
        return _value(text)
    except ValueError:
        return None


def parse(answer: str | None) -> dict:
    """outcome: ok, truncated (with what was recovered), empty (an empty array) or error; and the items.

    The first JSON value tells, what follows it doesn't: an array, an object with an array (by the wrappers' names, else the first field by name;
    null counts as an empty one), or an object that is an item. An array that is not closed is cut off; any other fault is an error,
    as are an answer without any text and elements none of which is an item.
    """
    try:
        raw, cut = _elements(unfenced((answer or "").strip(BLANK)))
    except ValueError:
        return {"outcome": "error", "recovered": 0, "items": []}
    items = [x for r in raw if (x := _item(r, 0))]
    items = [x | {"position": i} for i, x in enumerate(items)]
    outcome = "truncated" if cut else "empty" if not raw else "ok" if items else "error"
    return {"outcome": outcome, "recovered": len(items), "items": items}


@vectorised(SCHEMA)
def parse_udf(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(v) for v in x], columns=["outcome", "recovered", "items"])


class _Items:
    def eval(self, answer: str):
        got = parse(answer)
        if not got["items"]:
            yield (got["outcome"], *[None] * 10)
        for item in got["items"]:
            yield (got["outcome"], *(item[c] for c in _FIELDS))


_FIELDS = ("position", "title", "snippet", "url", "kind", "section", "summary", "relevance_score", "primary_topic", "labels")
_ROWS = "outcome string, position int, title string, snippet string, url string, kind string, section string, summary string, relevance_score int, primary_topic string, labels array<string>"


def items(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Each row with outcome and fields of every item of its answer; a row with nulls for an answer without any."""
    return answers.lateralJoin(F.udtf(_Items, returnType=_ROWS)(F.col(column).outer()))


def register(spark: SparkSession, name: str = "items_of") -> None:
    """Makes the table function known to SQL: ``FROM answers, LATERAL items_of(answer)``."""
    spark.udtf.register(name, F.udtf(_Items, returnType=_ROWS))
