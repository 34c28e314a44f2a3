"""Scalar functions as Catalyst expressions: text, links, hashes, labels, times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import markup, repair as repairs

#: Names of the output schema and its kinds, never valid as topics. Fixed values.
RESERVED_TOPICS = ("title", "snippet", "url", "kind", "section", "summary", "relevance_score", "primary_topic", "labels", "story", "blurb", "ad", "promo")
KINDS = ("story", "blurb", "ad", "promo")
NO_TOPICS = "(none specified)"
#: The heading after which a prompt holds the newsletter's text.
BODY = "\nText:\n"
LINK = r"https?://[^\s\"'<>)]+"


def stripped(x: Column) -> Column:
    """Without white space at the ends, the no-break space and all of Unicode's included."""
    return F.trim(x, F.lit(markup.BLANK))


def collapse(x: Column) -> Column:
    """Runs of white space, the no-break space included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def truncate(x: Column, n: int) -> Column:
    """The first n characters; all of them unless n is positive."""
    return F.left(x, F.lit(n)) if n > 0 else x


def clean_html(x: Column, n: int = 0) -> Column:
    """Text of any markup on one line: noise subtrees and comments go, tags part words, character references are resolved once."""
    return truncate(markup.flat_text_udf(x), n)


def strip_invisible(x: Column) -> Column:
    return F.regexp_replace(x, "[​-‏⁠﻿­᠎]", "")


def block_text(x: Column) -> Column:
    """Lines collapsed, at most one empty line in a row, none at the ends."""
    lines = F.transform(F.split(x, "\n"), collapse)
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), F.lit("\n"))


def address(x: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(stripped(x)), F.lit("")), F.lit("unknown"))


def display_name(x: Column) -> Column:
    """The part before the first @, if there is any."""
    return F.when(F.instr(x, "@") > 1, F.substring_index(x, "@", 1)).otherwise(x)


def dedupe_hash(body: Column) -> Column:
    return F.when(body != "", F.sha2(F.lower(body), 256))


def repair(x: Column) -> Column:
    """Filler runs and words repeated at once go, and spaces close up."""
    return repairs.repaired_udf(x)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def anchor(x: Column) -> Column:
    """The first 14 tokens, none if they are fewer than 3."""
    t = tokens(x)
    return F.when(F.size(t) >= 3, F.slice(t, 1, 14)).otherwise(F.array().cast("array<string>"))


def lcs_length(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two array columns: one row of the table at a time."""
    row = f"aggregate({b}, named_struct('left', 0, 'diag', 0, 'i', 0, 'row', array()::array<int>), (s, y) -> named_struct('left', greatest(s.left, prev[s.i], s.diag + if(x = y, 1, 0)), 'diag', prev[s.i], 'i', s.i + 1, 'row', array_append(s.row, greatest(s.left, prev[s.i], s.diag + if(x = y, 1, 0)))), s -> s.row)"
    return F.expr(f"if(size({a}) = 0 or size({b}) = 0, 0, element_at(aggregate({a}, array_repeat(0, size({b})), (prev, x) -> {row}), -1))")


def is_label(x: Column) -> Column:
    """A section label: 1 to 32 characters, no leading dash, a letter, and no letter that is not upper-case."""
    t = stripped(x)
    return F.length(t).between(1, 32) & ~t.rlike("^[-—]") & t.rlike(r"\p{L}") & ~t.rlike(r"[\p{L}&&[^\p{Lu}]]")


def clean_topic(x: Column) -> Column:
    t = stripped(x)
    return F.when(F.lower(t).isin(*RESERVED_TOPICS), "").otherwise(t)


def unfence(x: Column) -> Column:
    """What a Markdown code fence holds: from its first line's end to the last fence, or the end; a text without one is trimmed only."""
    t = stripped(x)
    inner = F.substr(t, F.instr(t, "\n") + 1)
    held = F.when(F.instr(inner, "```") > 0, F.left(inner, F.length(inner) - F.length(F.substring_index(inner, "```", -1)) - 3)).otherwise(inner)
    return F.when(F.startswith(t, F.lit("```")) & (F.instr(t, "\n") > 0), stripped(held)).otherwise(t)


def source_title(name: Column) -> Column:
    """A readable name from a file's: without folder and extension, dashes as blanks."""
    return stripped(F.translate(F.regexp_replace(F.regexp_extract(name, r"([^/]*)\z", 1), r"\.[^.]*\z", ""), "-_", "  "))


def paragraphs(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"\n{2,}"), stripped), lambda p: p != "")


def lines(x: Column) -> Column:
    """A text's lines with their places from 0, to be exploded."""
    return F.transform(F.split(x, "\n"), lambda line, i: F.struct(i.cast("long").alias("position"), line.alias("line")))


def prepared(html: Column, plain: Column, most: int = 24_000) -> Column:
    """The body that is scored and hashed: the markup's text if there is markup, else the plain text collapsed; cut at ``most``."""
    given = F.nullif(html, F.lit(""))
    return F.when(given.isNotNull(), clean_html(given, most)).otherwise(truncate(collapse(F.coalesce(plain, F.lit(""))), most))


def preferred(html: Column, plain: Column) -> Column:
    """Markup if there is any, else the plain text."""
    return F.coalesce(F.nullif(html, F.lit("")), plain)


def message_id(x: Column) -> Column:
    return F.regexp_replace(stripped(x), r"\A<|>\z", "")


def prompt_head(topics: tuple[str, ...] = ()) -> str:
    return (
        "Cut the newsletter below into its items, in reading order. Give each item a kind: story (text that develops a subject), blurb (one line), ad (paid), promo (the sender about itself). "
        "Rate from 0 to 100 how well it fits these topics: " + (", ".join(topics) or NO_TOPICS) + ". Answer with a JSON array of objects with title, snippet, kind, section, summary, relevance_score, primary_topic, labels and nothing else."
    )


def prompt(subject: Column, body: Column, source: Column | None = None, topics: tuple[str, ...] = ()) -> Column:
    """What a model is asked: rules, the reader's topics, the answer's form, and the newsletter after the last heading."""
    named = F.lit("") if source is None else F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("\nSource: "), source)).otherwise("")
    return F.concat(F.lit(prompt_head(topics)), named, F.lit("\nSubject: "), F.coalesce(subject, F.lit("")), F.lit(BODY), F.coalesce(body, F.lit("")))


def links(x: Column, most: int = 50) -> Column:
    """The first links in order, each once, without trailing punctuation."""
    found = F.regexp_extract_all(x, F.lit(LINK), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(".,);")))), 1, most)


def web_only(x: Column) -> Column:
    return F.when(x.rlike("^https?://"), x).otherwise("")


def item_link(url: Column, base: str, key: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit(f"{base}/#/items/"), key))


def base_url(configured: str, host: str, forwarded: str = "", tls: bool = False) -> str:
    """The origin of absolute links: the configured one, else from the request."""
    return configured or f"{'https' if tls or forwarded == 'https' else 'http'}://{host}"


def is_uuid(x: Column) -> Column:
    return x.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\z")


def hue_of(colour: Column) -> Column:
    """The hue of a colour's text, rounded; 40 if it has none."""
    found = F.regexp_extract(F.coalesce(colour, F.lit("")), r"(?i)hsl\(\s*([0-9.]+)", 1)
    return F.coalesce(F.floor(found.try_cast("double") + 0.5) % 360, F.lit(40)).cast("int")


def next_rating(now: Column, target: Column) -> Column:
    """A second choice of the same rating clears it."""
    return F.when(now == target, "none").otherwise(target)


def hue(x: str) -> Column:
    """FNV-1a of the UTF-8 bytes, modulo 360; null for the empty text."""
    byte = f"transform(sequence(1, greatest(octet_length({x}), 1)), i -> cast(conv(substr(hex(encode({x}, 'utf-8')), 2 * i - 1, 2), 16, 10) as bigint))"
    return F.expr(f"case when {x} <> '' then aggregate({byte}, cast(2166136261 as bigint), (h, b) -> ((h ^ b) * 16777619) & 4294967295) % 360 end")


def colour(x: str) -> Column:
    return F.when(F.col(x) == "", "hsl(40, 8%, 60%)").otherwise(F.concat(F.lit("hsl("), hue(x).cast("string"), F.lit(", 62%, 56%)")))


def card_height(x: Column) -> Column:
    """A fixed bucket of 5 from the id's characters."""
    return F.aggregate(F.split(x, ""), F.lit(0), lambda s, c: (s + F.when(c == "", 0).otherwise(F.ascii(c))) % 997) % 5


def flexible_int(x: Column) -> Column:
    """Numbers and numeric strings, half up and then toward zero; anything else is 0, and what 64 bits can't hold."""
    return F.coalesce((stripped(x.cast("string")).try_cast("double") + 0.5).try_cast("long"), F.lit(0).cast("long"))


def score(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("int")


def known_kind(x: Column) -> Column:
    k = F.lower(stripped(x))
    return F.when(k.isin(*KINDS), k).otherwise("story")


#: Entries in which labels are looked for before the rest is read.
_NEAR = 64


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _labels(x: Column, most: int) -> Column:
    first = lambda full, low: F.transform(F.slice(F.array_distinct(low), 1, most), lambda t: F.element_at(full, F.array_position(low, t).cast("int")))
    return _let(F.filter(F.transform(x, stripped), lambda t: t != ""), lambda full: _let(F.transform(full, F.lower), lambda low: first(full, low)))


def labels(x: Column, most: int = 5) -> Column:
    """Trimmed, without empties, each once whatever its case, the first ones in their first form. The rest of a long list is
    read only if its beginning has fewer than ``most``."""
    near = lambda a: _labels(F.slice(a, 1, _NEAR), most)
    return _let(x, lambda a: _let(near(a), lambda got: F.when((F.size(got) >= most) | (F.size(a) <= _NEAR), got).otherwise(_labels(a, most))))


def csv_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), stripped), lambda t: t != "")


# --- times: the present is always given -----------------------------------------------------------


def day_label(day: Column, now: Column) -> Column:
    """Today, Yesterday, the weekday within a week (and in the future), else the date."""
    today = F.to_date(now)
    return F.when(day == today, "Today").when(day == F.date_sub(today, 1), "Yesterday").when(day > F.date_sub(today, 7), F.date_format(day, "EEEE")).otherwise(F.date_format(day, "MMM d, yyyy"))


def time_bound(x: Column) -> Column:
    """A bound from text: a time with its zone, or a date at midnight; null for the empty text. Other texts raise where they are checked (is_time_bound)."""
    stamp = F.when(x.rlike(_STAMP), F.to_utc_timestamp(F.try_to_timestamp(x), F.current_timezone()))
    return F.coalesce(stamp, F.when(x.rlike(_DATE), x.try_cast("date").cast("timestamp"))).cast("timestamp_ntz")


def is_time_bound(x: Column) -> Column:
    return F.coalesce((x == "") | time_bound(x).isNotNull(), F.lit(True))


_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"
_DATE = r"^\d{4}-\d{2}-\d{2}\z"
#: Days back of the presets of the archive's range. Fixed values.
PRESETS = {"24h": 1, "week": 7, "month": 30}


def range_from(preset: Column, now: Column) -> Column:
    """The first day of a preset range; empty for any other."""
    day = lambda n: F.date_format(F.date_sub(F.to_date(now), n), "yyyy-MM-dd")
    out = F.lit("")
    for name, n in PRESETS.items():
        out = F.when(preset == name, day(n)).otherwise(out)
    return out


def preset_of(since: Column, now: Column) -> Column:
    """The preset that a first day stands for, by the days from it rounded."""
    days = F.floor(F.timestamp_diff("SECOND", since.try_cast("timestamp_ntz"), now) / 86400 + 0.5)
    return F.when(F.coalesce(since, F.lit("")) == "", "any").when(days <= 1, "24h").when(days <= 7, "week").otherwise("month")


def received_or(received: Column, now: Column) -> Column:
    return F.coalesce(received, now)


def seconds_between(now: Column, then: Column) -> Column:
    return F.timestamp_diff("SECOND", then, now)


def human_gap(seconds: Column) -> Column:
    """How long ago in words; null is the beginning."""
    n = lambda unit: F.floor(seconds / unit)
    say = lambda unit, name: F.concat(n(unit).cast("string"), F.when(n(unit) == 1, f" {name} ago").otherwise(f" {name}s ago"))
    return F.when(seconds.isNull(), "the beginning").when(seconds < 60, "moments ago").when(seconds < 3600, say(60, "minute")).when(seconds < 86400, say(3600, "hour")).otherwise(say(86400, "day"))


def short_gap(seconds: Column) -> Column:
    """now, hours, days, months of 30 days, years of 365."""
    part = lambda unit, sign: F.concat(F.floor(seconds / unit).cast("string"), F.lit(sign))
    return F.when(seconds < 3600, "now").when(seconds < 86400, part(3600, "h")).when(seconds < 30 * 86400, part(86400, "d")).when(seconds < 365 * 86400, part(30 * 86400, "m")).otherwise(part(365 * 86400, "y"))


def mail_date(x: Column) -> Column:
    return F.date_format(x, "EEE, dd MMM yyyy HH:mm:ss '+0000'")


def xml_escape(x: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x
