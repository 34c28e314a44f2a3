"""Read-side queries over stories: feeds, archive, rollups, item details."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import markup, segments, text
from lectern.sources import shared

def _named(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))


def _timed(newsletters: DataFrame) -> DataFrame:
    return newsletters.select(F.col("id").alias("newsletter_id"), F.coalesce("received_at", "ingested_at").alias("received"))


def with_sources(newsletters: DataFrame, sources: DataFrame) -> DataFrame:
    """Newsletters with their source's name."""
    return newsletters.join(_named(sources), "source_id")


def page_total(page: DataFrame) -> DataFrame:
    """One row: the number of a page's items."""
    return page.agg(F.count(F.lit(1)).alias("total"))


def stories_per_newsletter(stories: DataFrame) -> DataFrame:
    return stories.groupBy("newsletter_id").agg(F.count(F.lit(1)).alias("n"))


def items(stories: DataFrame, sources: DataFrame, newsletters: DataFrame) -> DataFrame:
    """Stories with their source's name and the time of receipt, else of ingestion."""
    return stories.join(_named(sources), "source_id").join(_timed(newsletters), "newsletter_id")


def curated(df: DataFrame) -> DataFrame:
    return df.filter("kind = 'story'")


_BEST = (F.desc, "relevance_score"), (F.desc, "scored_at"), (F.asc, "id")


def _best() -> list[Column]:
    return [order(c) for order, c in _BEST]


def today(stories: DataFrame, since: Column | None = None, limit: int = 200, unopened: bool = False) -> DataFrame:
    """Scored stories, best and newest first; only those scored after ``since``, only unopened ones, if asked for."""
    df = curated(stories).filter("relevance_score is not null")
    df = df if since is None else df.filter(F.col("scored_at") > since)
    df = df.filter("opened_at is null") if unopened else df
    return df.orderBy(*_best()).limit(limit)


def today_feed(stories: DataFrame, sources: DataFrame, newsletters: DataFrame, **limits) -> DataFrame:
    """today's stories as items. The first ones are taken before the joins, which keep every story: each has its
    source and newsletter."""
    return items(today(stories, **limits), sources, newsletters).orderBy(*_best())


def today_view(stories: DataFrame, sources: DataFrame, newsletters: DataFrame, sessions: DataFrame, now: Column, label: str = "default", brief: bool = False) -> dict[str, DataFrame]:
    """What is new to a session (label, last_viewed_at), all if it never looked: ``items`` with the bound, how long ago that was, ``is_empty``
    and ``brief``; and the ``topics`` among them. If nothing is new, the best unopened stories stand in when asked for. The page is
    found once and kept as a small table."""
    found = sessions.filter(F.col("label") == label).agg(F.max("last_viewed_at")).first()[0]  # one row of a session
    since = F.lit(found).cast("timestamp_ntz")
    shown = shared.stored(today_feed(stories, sources, newsletters, since=None if found is None else since).coalesce(1))
    empty = shown.isEmpty()
    if empty and brief:
        shown = shared.stored(today_feed(stories, sources, newsletters, limit=15, unopened=True).coalesce(1))
    told = {"since": since, "since_human": text.human_gap(text.seconds_between(now, since)), "is_empty": F.lit(empty), "brief": F.lit(empty and brief)}
    return {"items": shown.withColumns(told).orderBy(*_best()), "topics": topic_chips(shown, *_best())}


@dataclass(frozen=True)
class ArchiveFilter:
    """What to keep; an empty value keeps all. ``query`` is a pattern in which % and _ are wild."""

    topic: str = ""
    source_id: str = ""
    since: str = ""
    until: str = ""
    query: str = ""
    limit: int = 200
    offset: int = 0


    @staticmethod
    def parse(params: dict[str, str]) -> ArchiveFilter:
        """From text parameters topic, source, from, to, q, limit and offset; ValueError for what is none."""
        bounds = {}
        for name, key in (("since", "from"), ("until", "to")):
            given = params.get(key, "")
            try:
                if re.fullmatch(r"\d{4}-\d{2}-\d{2}", given):
                    bounds[name] = datetime.strptime(given, "%Y-%m-%d").isoformat(sep=" ")
                elif given:
                    t = datetime.fromisoformat(given)
                    if t.tzinfo is None or "T" not in given:
                        raise ValueError
                    bounds[name] = t.astimezone(UTC).replace(tzinfo=None).isoformat(sep=" ")
            except ValueError:
                raise ValueError(f"invalid {key}: want a time with its zone or a date") from None
        limit, offset = params.get("limit") or "200", params.get("offset") or "0"
        if not re.fullmatch(r"[+]?\d+", limit) or int(limit) <= 0:
            raise ValueError("invalid limit")
        if not re.fullmatch(r"[+]?\d+", offset):
            raise ValueError("invalid offset")
        return ArchiveFilter(params.get("topic", ""), params.get("source", ""), **bounds, query=params.get("q", ""), limit=min(int(limit), 500), offset=int(offset))


_NEWEST = (F.desc, "received"), (F.asc, "position"), (F.asc, "id")


def archive(stories: DataFrame, sources: DataFrame, newsletters: DataFrame, f: ArchiveFilter) -> DataFrame:
    """Stories as items, scored or not, newest receipt first. Stories and newsletters are filtered before they meet."""
    live = [F.col("kind") == "story"]
    if f.topic:
        live.append(F.col("primary_topic") == f.topic)
    if f.source_id:
        live.append(F.col("source_id") == f.source_id)
    if query := f.query.strip():
        live.append(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{query}%") for c in ("title", "summary", "snippet")]))
    timed = _timed(newsletters)
    if f.since:
        timed = timed.filter(F.col("received") >= F.lit(f.since).cast("timestamp_ntz"))
    if f.until:
        timed = timed.filter(F.col("received") < F.lit(f.until).cast("timestamp_ntz"))
    order = [by(c) for by, c in _NEWEST]
    kept = stories.filter(reduce(lambda a, b: a & b, live)).join(timed, "newsletter_id").orderBy(*order).offset(f.offset).limit(min(f.limit, 500))
    return kept.join(_named(sources), "source_id").orderBy(*order)


def archive_view(stories: DataFrame, sources: DataFrame, newsletters: DataFrame, f: ArchiveFilter, now: Column) -> dict[str, DataFrame]:
    """The archive's page: its days, the number of its items, and the sources and topics of all stories, whatever the filter."""
    page = shared.stored(archive(stories, sources, newsletters, f).coalesce(1))  # found once; a page is limited
    return {"days": day_groups(page, now), "total": page_total(page), "sources": source_rollup(sources, stories), "topics": topic_registry(stories)}


def without_item(page: DataFrame, key: str) -> DataFrame:
    """A page from which an item was taken, as when it becomes an ad; days that it alone filled go with it."""
    return page.filter(F.col("id") != key)


def siblings(stories: DataFrame) -> DataFrame:
    """Of each newsletter all items of any kind by position, as anchors of its text."""
    own = F.struct("position", F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("title", F.lit("")).alias("title"))
    return stories.groupBy("newsletter_id").agg(F.array_sort(F.collect_list(own)).alias("siblings"))


def item_detail(item: DataFrame, stories: DataFrame, newsletters: DataFrame, now: Column | None = None) -> DataFrame:
    """Items (few, by id) with their newsletter's markup (raw_html), whether it has other items, and if so the part of
    its text that is theirs. Only the newsletters of these items are read further. To read is to open: with ``now`` items that
    were not opened yet are stamped so."""
    if now is not None:
        item = item.withColumn("opened_at", F.coalesce("opened_at", now))
    near = siblings(stories.join(item.select("newsletter_id").distinct(), "newsletter_id", "left_semi"))
    letters = newsletters.select(F.col("id").alias("newsletter_id"), "raw_html").join(item.select("newsletter_id").distinct(), "newsletter_id", "left_semi")
    read = letters.withColumn("_body", markup.block_text_udf(F.coalesce("raw_html", F.lit(""))))  # once for each newsletter
    joined = item.join(near, "newsletter_id").join(read, "newsletter_id", "left")
    told = joined.withColumn("segmented", F.size("siblings") > 1)
    part = segments.segment_udf(F.coalesce("_body", F.lit("")), F.col("siblings"), F.col("position"))
    return told.withColumn("segment_text", F.when(F.col("segmented") & F.col("raw_html").isNotNull(), F.nullif(part, F.lit("")))).drop("siblings", "_body")


def source_rollup(sources: DataFrame, stories: DataFrame) -> DataFrame:
    """Every source's counts and mean score; the mean takes all kinds. Stories are summed up before the join."""
    per = stories.groupBy("source_id").agg(
        F.count_if(F.col("kind") == "story").alias("story_count"),
        F.count_if(F.col("relevance_score").isNotNull()).alias("scored_count"),
        F.count_if("bookmarked").alias("bookmark_count"),
        F.count_if(F.col("user_rating") == 1).alias("up_count"),
        F.count_if(F.col("user_rating") == -1).alias("down_count"),
        F.avg("relevance_score").alias("avg_relevance"),
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("story_count", "scored_count", "bookmark_count", "up_count", "down_count")]
    joined = sources.join(per, F.col("id") == F.col("source_id"), "left").select("id", "name", *counts, "avg_relevance")
    return joined.orderBy(F.desc_nulls_last("avg_relevance"), "name")


def topic_registry(stories: DataFrame) -> DataFrame:
    """Topics with their number of stories and colour, most frequent first."""
    counted = curated(stories).filter("primary_topic <> ''").groupBy("primary_topic").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("primary_topic").alias("topic"), "n", text.colour("primary_topic").alias("colour")).orderBy(F.desc("n"), "topic")


def topic_chips(page: DataFrame, *order: Column | str) -> DataFrame:
    """Topics of a page by frequency, ties by first appearance in the page's order. A page is limited, so one task holds it."""
    placed = page.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    counted = placed.filter("primary_topic <> ''").groupBy("primary_topic").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first"))
    return counted.select(F.col("primary_topic").alias("topic"), "n", "first").orderBy(F.desc("n"), "first")


def day_groups(page: DataFrame, now: Column) -> DataFrame:
    """A row per UTC day of a page, newest first: label, number of items, their ids in order."""
    day = F.to_date("received")
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.expr("-unix_seconds(cast(received as timestamp))").alias("t"), "position", "id"))), lambda x: x["id"])
    grouped = page.withColumn("day", day).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.array_join(ids, " ").alias("ids"))
    return grouped.select(F.date_format("day", "yyyy-MM-dd").alias("day"), text.day_label(F.col("day"), now).alias("label"), "n", "ids").orderBy(F.desc("day"))


def segmented(stories: DataFrame) -> DataFrame:
    """Whether a story's newsletter has other items. Items are counted before the join, which Spark may split."""
    counted = stories.groupBy("newsletter_id").agg((F.count(F.lit(1)) > 1).alias("segmented"))
    return stories.select("id", "newsletter_id").join(counted, "newsletter_id").select("id", "segmented")


def dto(df: DataFrame) -> DataFrame:
    """Items as clients see them: no nulls."""
    rating = F.when(F.col("user_rating") == 1, "up").when(F.col("user_rating") == -1, "down").otherwise("none")
    listed = [F.coalesce("labels", F.array().cast("array<string>")).alias("labels")] if "labels" in df.columns else []
    return df.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "summary", "snippet", "primary_topic")], F.coalesce("relevance_score", F.lit(0)).alias("score"), rating.alias("rating"), F.col("opened_at").isNotNull().alias("read"), "bookmarked", *listed)


def by_position(stories: DataFrame) -> DataFrame:
    """Of each newsletter its items' ids by position."""
    return stories.groupBy("newsletter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]), " ").alias("ids"))


def headline(chips: DataFrame) -> DataFrame:
    """One row: the page's first three topics as a phrase."""
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.negative("n").alias("n"), "first", F.lower("topic").alias("topic")))), 1, 3), lambda x: x["topic"])
    named = chips.agg(top.alias("t"))
    size = F.size("t")
    return named.select(F.when(size == 0, "").when(size == 1, F.col("t")[0]).when(size == 2, F.array_join("t", " and ")).otherwise(F.concat(F.try_element_at("t", F.lit(1)), F.lit(", "), F.try_element_at("t", F.lit(2)), F.lit(" and "), F.try_element_at("t", F.lit(3)))).alias("headline"))


def kind_breakdown(newsletters: DataFrame, stories: DataFrame) -> DataFrame:
    """Of every newsletter the numbers of each kind in fixed order, without zeros; ``empty`` if it has none."""
    counted = stories.groupBy(F.col("newsletter_id").alias("id")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in text.KINDS])
    parts = F.concat_ws(", ", *[F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {k}"))) for k in text.KINDS])
    return newsletters.select("id").join(counted, "id", "left").select(F.col("id").alias("newsletter_id"), F.coalesce(F.nullif(parts, F.lit("")), F.lit("empty")).alias("breakdown"))


def eval_report(counted: DataFrame, low: int, high: int) -> DataFrame:
    """Cases (newsletter_id, n) that hold a number of stories within bounds."""
    return counted.withColumn("passed", F.col("n").between(low, high))


def engagement(*pages: DataFrame) -> DataFrame:
    """Distinct bookmarked and rated items over several pages."""
    every = reduce(DataFrame.unionByName, [p.select("id", "bookmarked", "user_rating") for p in pages]).dropDuplicates(["id"])
    return every.agg(F.count_if("bookmarked").alias("bookmarked"), F.count_if(F.col("user_rating").isNotNull()).alias("rated"))


def rss_items(page: DataFrame, base: str) -> DataFrame:
    """A feed's fields, newest first."""
    url = F.col("url") if "url" in page.columns else F.lit(None).cast("string")
    return page.select("id", F.coalesce("title", F.lit("")).alias("title"), text.item_link(url, base, F.col("id")).alias("link"), F.coalesce(F.nullif("summary", F.lit("")), "snippet", F.lit("")).alias("description"), F.coalesce("primary_topic", F.lit("")).alias("category"), text.mail_date(F.col("received")).alias("published"), "received", "position")


def rss(page: DataFrame, base: str, title: str) -> DataFrame:
    """One row: the feed as RSS 2.0 text."""
    e = text.xml_escape
    item = F.concat(*[x for c, tag in (("title", "title"), ("link", "link"), ("id", "guid"), ("description", "description"), ("category", "category"), ("published", "pubDate")) for x in (F.lit('<guid isPermaLink="false">' if tag == "guid" else f"<{tag}>"), e(F.col(c)), F.lit(f"</{tag}>"))])
    rows = rss_items(page, base).select(F.struct(F.expr("-unix_seconds(cast(received as timestamp))").alias("t"), "position", "id", F.concat(F.lit("<item>"), item, F.lit("</item>")).alias("xml"), "published").alias("r"))
    got = rows.agg(F.array_sort(F.collect_list("r")).alias("r"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{base}</link>'
    return got.select(F.concat(F.lit(head), F.lit("<lastBuildDate>"), F.coalesce(F.try_element_at("r", F.lit(1))["published"], F.lit("")), F.lit("</lastBuildDate>"), F.array_join(F.transform("r", lambda x: x["xml"]), ""), F.lit("</channel></rss>")).alias("rss"))
