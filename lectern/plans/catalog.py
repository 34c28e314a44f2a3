"""All queries of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import markup, model_json, segments, text
from lectern.operators import intake, reads, scoring, state
from lectern.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: The present, in compared queries.
NOW = "1998-06-01 12:00:00"


def query(sql: str | None = None, views: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {tables.SQL} {sql}" if views else sql
        return f

    return add


def _tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tables.stories(spark, d), tables.sources(spark, d), tables.newsletters(spark, d)


def _today(spark, d, **limits) -> DataFrame:
    return reads.today_feed(*_tables(spark, d), **limits)


def _archive(spark, d, **f) -> DataFrame:
    return reads.archive(*_tables(spark, d), reads.ArchiveFilter(**f))


_SHOWN = ("id", "source_name", "title", "primary_topic", "relevance_score", "scored_at", "received")
_COLS = ", ".join(_SHOWN)
_TODAY = "SELECT {} FROM v_items WHERE kind = 'story' AND relevance_score IS NOT NULL {} ORDER BY relevance_score DESC, scored_at DESC, id LIMIT {}"


@query(_TODAY.format(_COLS, "", 200), True)
def top1_today_feed(spark, d):
    return _today(spark, d).select(*_SHOWN)


@query(_TODAY.format(_COLS, "AND scored_at > TIMESTAMP '1997-01-01'", 200), True)
def flt3_today_since(spark, d):
    return _today(spark, d, since=F.lit("1997-01-01").cast("timestamp_ntz")).select(*_SHOWN)


@query(_TODAY.format(_COLS, "AND opened_at IS NULL", 15), True)
def top2_brief(spark, d):
    return _today(spark, d, limit=15, unopened=True).select(*_SHOWN)


_FILTER = reads.ArchiveFilter(topic="ECONOMY", since="1995-01-01", until="1998-01-01", query=" brand_1 ", limit=200, offset=5)
_ARCHIVE = "SELECT {} FROM v_items WHERE kind = 'story' {} ORDER BY received DESC, position, id LIMIT {} OFFSET {}"


@query(_ARCHIVE.format(_COLS, "AND primary_topic = 'ECONOMY' AND received >= TIMESTAMP '1995-01-01' AND received < TIMESTAMP '1998-01-01' AND (title ILIKE '%brand_1%' OR summary ILIKE '%brand_1%' OR snippet ILIKE '%brand_1%')", 200, 5), True)
def top3_archive_filtered(spark, d):
    return reads.archive(*_tables(spark, d), _FILTER).select(*_SHOWN)


@query(_ARCHIVE.format(_COLS, "AND source_id = '1'", 500, 0), True)
def flt5_archive_source(spark, d):
    return _archive(spark, d, source_id="1", limit=9999).select(*_SHOWN)


@query("""SELECT so.id, so.name, count(*) FILTER (WHERE st.kind = 'story') AS story_count, count(st.relevance_score) AS scored_count,
  count(*) FILTER (WHERE st.bookmarked) AS bookmark_count, count(*) FILTER (WHERE st.user_rating = 1) AS up_count,
  count(*) FILTER (WHERE st.user_rating = -1) AS down_count, round(avg(st.relevance_score), 6) AS avg_relevance
  FROM v_sources so LEFT JOIN v_stories st ON st.source_id = so.id GROUP BY so.id, so.name""", True)
def agg1_source_rollup(spark, d):
    return reads.source_rollup(tables.sources(spark, d), tables.stories(spark, d)).withColumn("avg_relevance", F.round("avg_relevance", 6))


@query("SELECT so.id, so.name FROM v_sources so WHERE EXISTS (SELECT 1 FROM v_stories st WHERE st.source_id = so.id AND st.kind = 'story')", True)
def ui3_sidebar_sources(spark, d):
    return reads.source_rollup(tables.sources(spark, d), tables.stories(spark, d)).filter("story_count > 0").select("id", "name")


_HUE = "list_reduce(list_concat([2166136261::BIGINT], list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 360"


@query(f"SELECT primary_topic AS topic, count(*) AS n, 'hsl(' || CAST({_HUE.format('primary_topic')} AS VARCHAR) || ', 62%, 56%)' AS colour FROM v_stories WHERE kind = 'story' AND primary_topic <> '' GROUP BY primary_topic", True)
def agg2_topic_registry(spark, d):
    return reads.topic_registry(tables.stories(spark, d))


_PAGE = "page AS (SELECT *, row_number() OVER (ORDER BY relevance_score DESC, scored_at DESC, id) AS rn FROM v_items WHERE kind = 'story' AND relevance_score IS NOT NULL ORDER BY relevance_score DESC, scored_at DESC, id LIMIT 200)"
_CHIPS = "chips AS (SELECT primary_topic AS topic, count(*) AS n, min(rn) AS first FROM page WHERE primary_topic <> '' GROUP BY primary_topic)"


def _chips(spark, d):
    return reads.topic_chips(_today(spark, d), F.desc("relevance_score"), F.desc("scored_at"), "id")


@query(f", {_PAGE}, {_CHIPS} SELECT topic, n, first FROM chips", True)
def agg3_topic_chips(spark, d):
    return _chips(spark, d)


@query(f", {_PAGE}, {_CHIPS}, t AS (SELECT list(lower(topic) ORDER BY n DESC, first)[1:3] AS t FROM chips) SELECT CASE len(t) WHEN 0 THEN '' WHEN 1 THEN t[1] WHEN 2 THEN t[1] || ' and ' || t[2] ELSE t[1] || ', ' || t[2] || ' and ' || t[3] END AS headline FROM t", True)
def top9_headline(spark, d):
    return reads.headline(_chips(spark, d))


@query(f""", page AS ({_ARCHIVE.format('*', '', 200, 0)}) SELECT strftime(received, '%Y-%m-%d') AS day,
  CASE WHEN received::DATE = DATE '1998-06-01' THEN 'Today' WHEN received::DATE = DATE '1998-05-31' THEN 'Yesterday' WHEN received::DATE > DATE '1998-05-25' THEN strftime(received, '%A') ELSE strftime(received, '%b %-d, %Y') END AS label,
  count(*) AS n, string_agg(id, ' ' ORDER BY received DESC, position, id) AS ids FROM page GROUP BY 1, 2""", True)
def agg4_archive_days(spark, d):
    return reads.day_groups(_archive(spark, d), F.lit(NOW).cast("timestamp_ntz"))


@query(f", page AS ({_ARCHIVE.format('id', '', 200, 100)}) SELECT count(*) AS total FROM page", True)
def agg5_page_total(spark, d):
    return reads.page_total(_archive(spark, d, offset=100))


@query("SELECT id, (SELECT count(*) FROM v_stories s WHERE s.newsletter_id = v_stories.newsletter_id) > 1 AS segmented FROM v_stories", True)
def jn3_segmented(spark, d):
    return reads.segmented(tables.stories(spark, d))


@query("SELECT newsletter_id, count(*) AS n FROM v_stories GROUP BY newsletter_id", True)
def agg6_stories_per_newsletter(spark, d):
    return reads.stories_per_newsletter(tables.stories(spark, d))


@query(f", a AS ({_TODAY.format('id, bookmarked, user_rating', '', 200)}), b AS ({_ARCHIVE.format('id, bookmarked, user_rating', '', 200, 0)}) SELECT count(*) FILTER (WHERE bookmarked) AS bookmarked, count(user_rating) AS rated FROM (SELECT * FROM a UNION SELECT * FROM b)", True)
def agg7_engagement_counters(spark, d):
    return reads.engagement(_today(spark, d), _archive(spark, d))


_KINDS = ", ".join(f"CASE WHEN count(*) FILTER (WHERE kind = '{k}') > 0 THEN CAST(count(*) FILTER (WHERE kind = '{k}') AS VARCHAR) || ' {k}' END" for k in text.KINDS)


@query(f"SELECT n.id AS newsletter_id, coalesce(nullif(concat_ws(', ', {_KINDS}), ''), 'empty') AS breakdown FROM v_newsletters n LEFT JOIN v_stories s ON s.newsletter_id = n.id GROUP BY n.id", True)
def agg8_kind_breakdown(spark, d):
    return reads.kind_breakdown(tables.newsletters(spark, d), tables.stories(spark, d))


@query("SELECT newsletter_id, count(*) AS n, count(*) BETWEEN 2 AND 5 AS passed FROM v_stories WHERE kind = 'story' GROUP BY newsletter_id", True)
def agg10_eval_bounds(spark, d):
    return reads.eval_report(reads.stories_per_newsletter(reads.curated(tables.stories(spark, d))), 2, 5)


@query("SELECT id, coalesce(title, '') AS title, coalesce(summary, '') AS summary, coalesce(snippet, '') AS snippet, coalesce(primary_topic, '') AS primary_topic, coalesce(relevance_score, 0) AS score, CASE user_rating WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'none' END AS rating, opened_at IS NOT NULL AS read, bookmarked, CASE WHEN position % 2 = 1 THEN string_split(summary, ' ') ELSE [] END AS labels FROM v_stories", True)
def flt12_item_view(spark, d):
    return reads.dto(tables.stories(spark, d).withColumn("labels", F.when(F.col("position") % 2 == 1, F.split("summary", " "))))


_ODD = "SELECT id, CASE position WHEN 7 THEN 'odd' ELSE kind END AS kind, CASE position WHEN 6 THEN relevance_score + 60 ELSE relevance_score END AS relevance_score, CASE position WHEN 5 THEN 2 ELSE user_rating END AS user_rating FROM v_stories"


@query(f"SELECT id, CASE WHEN kind NOT IN ('story', 'blurb', 'ad', 'promo') THEN 'kind' WHEN relevance_score NOT BETWEEN 0 AND 100 THEN 'score' ELSE 'rating' END AS broken FROM ({_ODD}) WHERE kind NOT IN ('story', 'blurb', 'ad', 'promo') OR relevance_score NOT BETWEEN 0 AND 100 OR user_rating NOT IN (-1, 1)", True)
def flt14_invalid_rows(spark, d):
    """Constraints over stories some of which are made to break them."""
    at = F.col("position")
    odd = tables.stories(spark, d).withColumns({"kind": F.when(at == 7, "odd").otherwise(F.col("kind")), "relevance_score": F.when(at == 6, F.col("relevance_score") + 60).otherwise(F.col("relevance_score")), "user_rating": F.when(at == 5, 2).otherwise(F.col("user_rating"))})
    return state.invalid_stories(odd)


@query("SELECT id, 'status' AS broken FROM (SELECT id, CASE WHEN scoring_attempts = 3 THEN 'done' ELSE processing_status END AS s FROM v_newsletters) WHERE s NOT IN ('pending_scoring', 'scoring', 'scored', 'failed')", True)
def flt14_invalid_statuses(spark, d):
    return state.invalid_newsletters(tables.newsletters(spark, d).withColumn("processing_status", F.when(F.col("scoring_attempts") == 3, "done").otherwise(F.col("processing_status"))))


_LINK = "CASE WHEN position = 1 THEN 'https://n.example/' || id ELSE 'https://x.example/#/items/' || id END"
_RSS = f"page AS ({_ARCHIVE.format('*', '', 50, 0)}), feed AS (SELECT id, position, received, coalesce(title, '') AS title, {_LINK} AS link, coalesce(nullif(summary, ''), snippet, '') AS description, coalesce(primary_topic, '') AS category, strftime(received, '%a, %d %b %Y %H:%M:%S +0000') AS published FROM page)"


def _feed(spark, d) -> DataFrame:
    return _archive(spark, d, limit=50).withColumn("url", F.when(F.col("position") == 1, F.concat(F.lit("https://n.example/"), "id")))


@query(f", {_RSS} SELECT id, title, link, description, category, published FROM feed", True)
def snk2_rss_items(spark, d):
    return reads.rss_items(_feed(spark, d), "https://x.example").drop("received", "position")


def _escaped(c: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        c = f"replace({c}, '{char}', '{entity}')"
    return c


_ENTRY = " || ".join(f"'<{tag}>' || {_escaped(c)} || '</{tag.split()[0]}>'" for c, tag in (("title", "title"), ("link", "link"), ("id", 'guid isPermaLink="false"'), ("description", "description"), ("category", "category"), ("published", "pubDate")))


@query(f""", {_RSS} SELECT '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Items</title><link>https://x.example</link><lastBuildDate>' || coalesce(arg_max(published, received), '') || '</lastBuildDate>' || coalesce(string_agg('<item>' || {_ENTRY} || '</item>', '' ORDER BY received DESC, position, id), '') || '</channel></rss>' AS rss FROM feed""", True)
def snk2_rss(spark, d):
    return reads.rss(_feed(spark, d), "https://x.example", "Items")


@query(f", page AS ({_TODAY.format('id, title', '', 200)}) SELECT id, '{{\"id\":\"' || id || '\",\"title\":\"' || title || '\"}}' AS json FROM page", True)
def snk1_json_items(spark, d):
    return _today(spark, d).select("id", F.to_json(F.struct("id", "title")).alias("json"))


@query("SELECT newsletter_id, string_agg(id, ' ' ORDER BY position, id) AS ids FROM v_stories GROUP BY newsletter_id", True)
def top7_positions(spark, d):
    return reads.by_position(tables.stories(spark, d))


@query("SELECT newsletter_id, string_agg(position || ':' || snippet || ':' || title, '|' ORDER BY position, snippet, title) AS siblings FROM v_stories GROUP BY newsletter_id", True)
def jn8_siblings(spark, d):
    return reads.siblings(tables.stories(spark, d)).select("newsletter_id", F.array_join(F.transform("siblings", lambda x: F.concat_ws(":", x["position"].cast("string"), x["snippet"], x["title"])), "|").alias("siblings"))


@query("SELECT n.id, s.name FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey % 10 + 1 AS VARCHAR) AS source_id FROM orders) n JOIN v_sources s ON s.id = n.source_id", True)
def jn4_newsletter_sources(spark, d):
    sent = tables.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 10 + 1).cast("string").alias("source_id"))
    return reads.with_sources(sent, tables.sources(spark, d)).select("id", F.col("source_name").alias("name"))


@query(f", page AS ({_TODAY.format('*', '', 200)}) SELECT id FROM page WHERE primary_topic = 'ECONOMY'", True)
def ui1_topic_in_page(spark, d):
    return _today(spark, d).filter("primary_topic = 'ECONOMY'").select("id")


@query(f", page AS ({_ARCHIVE.format('*', '', 200, 0)}) SELECT strftime(received, '%Y-%m-%d') AS day, count(*) AS n FROM page WHERE id <> (SELECT min(id) FROM page) GROUP BY 1", True)
def ui4_page_without_ad(spark, d):
    page = _archive(spark, d)
    return reads.day_groups(reads.without_item(page, page.agg(F.min("id")).first()[0]), F.lit(NOW).cast("timestamp_ntz")).select("day", "n")


# --- whole views ----------------------------------------------------------------------------------

_SEEN = "SELECT CAST(user_id AS VARCHAR) AS label, max(ts) AS last_viewed_at FROM events GROUP BY user_id"


def _sessions(spark, d) -> DataFrame:
    return state.sessions(tables.table(spark, d, "events").select(F.col("user_id").cast("string").alias("label"), "ts"))


def _today_parts(view: dict[str, DataFrame]) -> DataFrame:
    none = F.lit(None)
    items = view["items"].select(F.lit("item").alias("part"), F.col("id").alias("key"), none.cast("long").alias("n"), "since", "since_human", "is_empty", "brief")
    return items.unionByName(view["topics"].select(F.lit("topic").alias("part"), F.col("topic").alias("key"), F.col("n").cast("long").alias("n")), allowMissingColumns=True)


_SINCE = f"date_diff('second', since, TIMESTAMP '{NOW}')"
_AGO = " ".join(f"WHEN {_SINCE} < {most} THEN CAST({_SINCE} // {unit} AS VARCHAR) || CASE WHEN {_SINCE} // {unit} = 1 THEN ' {name} ago' ELSE ' {name}s ago' END" for most, unit, name in ((3600, 60, "minute"), (86400, 3600, "hour"), (10**12, 86400, "day")))
_TODAY_PARTS = f"SELECT 'item' AS part, id AS key, CAST(NULL AS BIGINT) AS n, since, CASE WHEN since IS NULL THEN 'the beginning' WHEN {_SINCE} < 60 THEN 'moments ago' {_AGO} END AS since_human, is_empty, brief FROM shown UNION ALL SELECT 'topic', primary_topic, count(*), NULL, NULL, NULL, NULL FROM shown WHERE primary_topic <> '' GROUP BY primary_topic"


@query(f", seen AS ({_SEEN}), latest AS (SELECT * FROM seen ORDER BY last_viewed_at DESC, label LIMIT 1), page AS ({_TODAY.format('*', 'AND scored_at > (SELECT last_viewed_at FROM latest)', 200)}), brief AS ({_TODAY.format('*', 'AND opened_at IS NULL', 15)}), shown AS (SELECT id, primary_topic, since, is_empty, is_empty AS brief FROM (SELECT id, primary_topic, false AS is_empty FROM page UNION ALL SELECT id, primary_topic, true FROM brief WHERE NOT EXISTS (SELECT 1 FROM page)), (SELECT last_viewed_at AS since FROM latest)) {_TODAY_PARTS}", True)
def api1_today(spark, d):
    """What is new to the session that looked last, else the brief; with its topics."""
    seen = _sessions(spark, d)
    label = seen.orderBy(F.desc("last_viewed_at"), "label").first()["label"]
    return _today_parts(reads.today_view(*_tables(spark, d), seen, F.lit(NOW).cast("timestamp_ntz"), label, brief=True))


@query(f", page AS ({_TODAY.format('*', '', 200)}), shown AS (SELECT id, primary_topic, CAST(NULL AS TIMESTAMP) AS since, false AS is_empty, false AS brief FROM page) {_TODAY_PARTS}", True)
def api1_today_first_visit(spark, d):
    return _today_parts(reads.today_view(*_tables(spark, d), state.ensure_session(_sessions(spark, d)), F.lit(NOW).cast("timestamp_ntz")))


@query(f"WITH seen AS ({_SEEN}) SELECT * FROM seen WHERE label <> 'default' UNION ALL SELECT 'default', TIMESTAMP '{NOW}'")
def api2_mark_seen(spark, d):
    return state.mark_seen(_sessions(spark, d), F.lit(NOW).cast("timestamp_ntz"))


@query(f""", page AS ({_ARCHIVE.format('*', "AND primary_topic = 'ECONOMY' AND received >= TIMESTAMP '1995-01-01'", 100, 0)})
  SELECT 'day' AS part, strftime(received, '%Y-%m-%d') AS key, count(*) AS n FROM page GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM page
  UNION ALL SELECT 'source', so.id, count(*) FILTER (WHERE st.kind = 'story') FROM v_sources so LEFT JOIN v_stories st ON st.source_id = so.id GROUP BY so.id
  UNION ALL SELECT 'topic', primary_topic, count(*) FROM v_stories WHERE kind = 'story' AND primary_topic <> '' GROUP BY primary_topic""", True)
def api3_archive(spark, d):
    view = reads.archive_view(*_tables(spark, d), reads.ArchiveFilter.parse({"topic": "ECONOMY", "from": "1995-01-01", "limit": "100"}), F.lit(NOW).cast("timestamp_ntz"))
    part = lambda name, df, key, n: df.select(F.lit(name).alias("part"), key.alias("key"), F.col(n).alias("n"))
    days, total = part("day", view["days"], F.col("day"), "n"), part("total", view["total"], F.lit(""), "total")
    return days.unionByName(total).unionByName(part("source", view["sources"], F.col("id"), "story_count")).unionByName(part("topic", view["topics"], F.col("topic"), "n"))


@query()
def api4_item_detail(spark, d):
    """Every line of a page with any text as an item, with its part of the page's text."""
    pages = tables.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("raw_html"))
    lines = pages.select(F.col("id").alias("newsletter_id"), F.posexplode(F.split(markup.block_text_udf("raw_html"), "\n")).alias("position", "snippet")).filter("snippet <> ''")
    stories = lines.select(F.concat_ws("-", "newsletter_id", F.col("position").cast("string")).alias("id"), "newsletter_id", "position", "snippet", F.lit("").alias("title"))
    return reads.item_detail(stories, stories, pages).select("id", "segmented", "segment_text")


# --- queue and state ------------------------------------------------------------------------------


@query("SELECT id, ingested_at FROM v_newsletters WHERE processing_status = 'pending_scoring' ORDER BY ingested_at, id LIMIT 20", True)
def src10_pending_queue(spark, d):
    return state.pending(tables.newsletters(spark, d), 20).select("id", "ingested_at")


@query("SELECT n.id, CASE WHEN t.id IS NOT NULL THEN 'scoring' ELSE n.processing_status END AS processing_status, n.scoring_attempts + CASE WHEN t.id IS NOT NULL THEN 1 ELSE 0 END AS scoring_attempts, t.id IS NOT NULL AS claimed FROM v_newsletters n LEFT JOIN (SELECT id FROM v_newsletters WHERE processing_status = 'pending_scoring' ORDER BY ingested_at, id LIMIT 5) t ON t.id = n.id", True)
def dml3_claim_batch(spark, d):
    return state.claim(tables.newsletters(spark, d)).select("id", "processing_status", "scoring_attempts", "claimed")


@query("SELECT CASE processing_status WHEN 'scoring' THEN 'pending_scoring' ELSE processing_status END AS processing_status, count(*) AS n FROM v_newsletters GROUP BY 1", True)
def dml5_requeue_stale(spark, d):
    return state.requeue_stale(tables.newsletters(spark, d)).groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))


_OUTCOME = "CASE o_orderkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'transport' WHEN 2 THEN 'truncated' WHEN 3 THEN 'empty' ELSE 'other' END"


@query(f"""SELECT o_orderkey AS id, CASE WHEN x = 'ok' THEN 'scored' WHEN x = 'transport' THEN 'pending_scoring' WHEN x IN ('truncated', 'empty') AND NOT det AND att < 3 THEN 'pending_scoring' WHEN x = 'truncated' AND items > 0 THEN 'scored' ELSE 'failed' END AS status
  FROM (SELECT o_orderkey, {_OUTCOME} AS x, o_orderkey % 2 = 0 AS det, o_orderkey % 4 AS att, o_orderkey % 3 AS items FROM orders)""")
def str4_routing(spark, d):
    o, key = tables.table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(key.alias("id"), state.route(F.expr(_OUTCOME), key % 2 == 0, key % 4, key % 3).alias("status"))


@query("SELECT x AS outcome, count(*) AS n FROM (SELECT " + _OUTCOME + " AS x FROM orders) GROUP BY x")
def agg9_batch_outcomes(spark, d):
    return tables.table(spark, d, "orders").groupBy(F.expr(_OUTCOME).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_ACTION = "CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'toggle' WHEN 'purchase' THEN 'up' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'down' END ELSE CASE WHEN event_id % 7 = 0 THEN 'ad' ELSE 'seen' END END"


@query(f"""WITH e AS (SELECT event_id % 200 AS story, event_id AS seq, {_ACTION} AS action FROM events)
  SELECT story, count(*) FILTER (WHERE action = 'toggle') % 2 = 1 AS bookmarked, nullif(arg_max(action, seq) FILTER (WHERE action IN ('up', 'down', 'none')), 'none') AS rating, min(seq) FILTER (WHERE action = 'open') AS opened_seq, bool_or(action = 'ad') AS is_ad FROM e GROUP BY story""")
def dml9_engagement_fold(spark, d):
    e = tables.table(spark, d, "events").select((F.col("event_id") % 200).alias("story"), F.col("event_id").alias("seq"), F.expr(_ACTION).alias("action"))
    return state.engagement(e)


@query("SELECT user_id AS label, max(ts) AS last_viewed_at FROM events GROUP BY user_id")
def dml13_sessions(spark, d):
    return state.sessions(tables.table(spark, d, "events").select(F.col("user_id").alias("label"), "ts"))


_BODY = r"trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))"
_DELIVERIES = f"deliveries AS (SELECT doc_id AS seq, CASE WHEN doc_id % 7 = 0 THEN 'm' || CAST(doc_id // 21 AS VARCHAR) END AS message_id, CASE WHEN {_BODY} <> '' THEN sha256(lower({_BODY})) END AS hash FROM documents)"


def _deliveries(spark, d):
    key = F.col("doc_id")
    body = text.collapse(F.col("text"))
    return tables.table(spark, d, "documents").select(key.alias("seq"), F.when(key % 7 == 0, F.concat(F.lit("m"), F.floor(key / 21).cast("string"))).alias("message_id"), text.dedupe_hash(body).alias("hash"))


@query(f"""WITH {_DELIVERIES}, ids AS (SELECT message_id, min(seq) AS seq FROM deliveries WHERE message_id IS NOT NULL GROUP BY message_id),
  kept AS (SELECT d.* FROM deliveries d JOIN ids USING (seq)), known AS (SELECT hash, min(seq) AS known FROM kept WHERE hash IS NOT NULL GROUP BY hash),
  firsts AS (SELECT hash, min(seq) AS seq FROM deliveries WHERE message_id IS NULL AND hash IS NOT NULL GROUP BY hash)
  SELECT seq, message_id, hash FROM kept UNION ALL SELECT f.seq, NULL, f.hash FROM firsts f LEFT JOIN known k ON k.hash = f.hash WHERE k.known IS NULL OR k.known > f.seq
  UNION ALL SELECT seq, NULL, hash FROM deliveries WHERE message_id IS NULL AND hash IS NULL""")
def dml2_dedupe(spark, d):
    return state.surviving(_deliveries(spark, d))


@query(f"WITH {_DELIVERIES} SELECT hash, max(seq) AS seq FROM deliveries WHERE hash IS NOT NULL GROUP BY hash")
def win2_latest_by_hash(spark, d):
    return state.latest_by_hash(_deliveries(spark, d).filter("hash is not null")).select("hash", "seq")


@query("SELECT 'newsletter' AS kind, source AS identity, arg_min(lang, doc_id) AS name, min(doc_id) AS first_seq FROM documents GROUP BY source")
def dml1_sources(spark, d):
    return state.first_sources(tables.table(spark, d, "documents").select(F.lit("newsletter").alias("kind"), F.col("source").alias("identity"), F.col("lang").alias("name"), F.col("doc_id").alias("seq")))


_NEW = "SELECT id, newsletter_id, 'u' || summary AS url FROM v_stories WHERE position = 1"
_PRIOR = "SELECT id, position, 'u' || summary AS url, bookmarked, user_rating, opened_at FROM v_stories WHERE position > 1"


@query(f", prior AS ({_PRIOR}), held AS (SELECT url, arg_max((bookmarked, user_rating, opened_at), (position, id)) AS was FROM prior WHERE bookmarked OR user_rating IS NOT NULL OR opened_at IS NOT NULL GROUP BY url) SELECT n.id, n.newsletter_id, n.url, coalesce(was[1], false) AS bookmarked, was[2] AS user_rating, was[3] AS opened_at FROM ({_NEW}) n LEFT JOIN held USING (url)", True)
def jn6_carry_over(spark, d):
    s = tables.stories(spark, d).withColumn("url", F.concat(F.lit("u"), "summary"))
    return state.carry_over(s.filter("position = 1").select("id", "newsletter_id", "url"), s.filter("position > 1").select("id", "position", "url", "bookmarked", "user_rating", "opened_at"))


@query("SELECT id, newsletter_id, position FROM v_stories WHERE newsletter_id NOT IN (SELECT newsletter_id FROM v_stories WHERE position = 5) UNION ALL SELECT id || '-new', newsletter_id, position FROM v_stories WHERE position = 5", True)
def dml8_replace_all(spark, d):
    s = tables.stories(spark, d).select("id", "newsletter_id", "position")
    return state.replace_all(s, s.filter("position = 5").withColumn("id", F.concat("id", F.lit("-new"))))


# --- text -----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({_BODY}) AS body, left({_BODY}, 80) AS head FROM documents")
def txt1_collapse(spark, d):
    body = text.collapse(F.col("text"))
    return tables.table(spark, d, "documents").select("doc_id", F.sha2(body, 256).alias("body"), text.truncate(body, 80).alias("head"))


@query(f"WITH {_DELIVERIES} SELECT seq, hash FROM deliveries")
def hsh1_dedupe_hash(spark, d):
    return _deliveries(spark, d).select("seq", "hash")


#: White space of any kind at both ends, in the comparison engine.
_ENDS = r"^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '{_ENDS}', '', 'g')".replace("{{", "{").replace("}}", "}")


_WILD = "CASE c_custkey % 4 WHEN 0 THEN chr(160) || upper(c_name) || chr(9) WHEN 1 THEN chr(26085) || c_mktsegment WHEN 2 THEN ' ' || c_mktsegment || chr(8195) ELSE chr(10) END"
_SCALARS = rf"""SELECT c_custkey AS id, coalesce(nullif(lower({_strip('w')}), ''), 'unknown') AS address, {_strip('w')} AS topic, length({_strip('w')}) BETWEEN 1 AND 32 AND NOT starts_with({_strip('w')}, '-') AND regexp_matches({_strip('w')}, '\p{{L}}') AND NOT regexp_matches({_strip('w')}, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') AS label FROM (SELECT c_custkey, {_WILD} AS w FROM customer)"""


@query(_SCALARS)
def txt15_labels_of_odd_texts(spark, d):
    """Addresses, topics and labels of texts with odd white space and letters without case."""
    w = F.expr(_WILD.replace("chr(160)", "'\u00a0'").replace("chr(26085)", "'\u65e5'").replace("chr(8195)", "'\u2003'"))
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.address(w).alias("address"), text.clean_topic(w).alias("topic"), text.is_label(w).alias("label"))


@query(r"""SELECT c_custkey AS id, coalesce(nullif(lower(trim(c_name)), ''), 'unknown') AS address, CASE WHEN instr(c_name || '@x', '@') > 1 THEN split_part(c_name || '@x', '@', 1) END AS display,
  CASE WHEN lower(trim(c_mktsegment)) IN ('title', 'story', 'ad') THEN '' ELSE trim(c_mktsegment) END AS topic, length(c_mktsegment) BETWEEN 1 AND 32 AND NOT starts_with(c_mktsegment, '-') AND regexp_matches(c_mktsegment, '\p{L}') AND NOT regexp_matches(c_mktsegment, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') AS label,
  list_reduce(list_concat([0::BIGINT], list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda s, c: (s + c) % 997) % 5 AS height FROM customer""")
def txt4_scalars(spark, d):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.address(name).alias("address"), text.display_name(F.concat(name, F.lit("@x"))).alias("display"), text.clean_topic(seg).alias("topic"), text.is_label(seg).alias("label"), text.card_height(name).cast("long").alias("height"))


@query(r"SELECT doc_id, list_slice(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), 1, 14) AS anchor FROM documents WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) >= 3")
def txt9_anchors(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", text.anchor(F.col("text")).alias("anchor")).filter("size(anchor) > 0")


#: Texts with loops of a model in them, and the rule over words and what stands between them.
_LOOPED = "replace(replace(replace(text, ', ', ', and and AND '), '. ', '. _ _ _ _ So so____'), ' d', ' d  d')"
_W = r"[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*"


def _repairing(name: str, rows: str) -> str:
    """The comparison engine's table (key, text) of repaired texts, none of them null."""
    return rf"""{name}_f AS (SELECT key, regexp_replace(text, '(?:[_*~][\t\n\f\r ]+){{3,}}[_*~]?|[_*~]{{4,}}', ' ', 'g') AS t FROM ({rows})),
  {name}_l AS (SELECT key, regexp_extract_all(t, '{_W}') AS w, string_split_regex(t, '{_W}') AS g FROM {name}_f),
  {name}_e AS (SELECT key, i, g[i] AS gap, w[i] AS word, i > 1 AND g[i] <> '' AND {_strip('g[i]')} = '' AND lower(w[i]) = lower(w[i - 1]) AS gone FROM (SELECT key, w, g, unnest(range(1, len(g) + 1)) AS i FROM {name}_l)),
  {name}_j AS (SELECT key, string_agg(CASE WHEN coalesce(gone, false) THEN '' ELSE coalesce(gap, '') || coalesce(word, '') END, '' ORDER BY i) AS t FROM {name}_e GROUP BY key),
  {name} AS (SELECT key, {_strip(f"regexp_replace(coalesce({name}_j.t, ''), '[ \t\f\x0b]{{2,}}', ' ', 'g')")} AS text FROM {name}_f LEFT JOIN {name}_j USING (key))"""


_REPAIRED = f"WITH {_repairing('r', f'SELECT doc_id AS key, {_LOOPED} AS text FROM documents WHERE text IS NOT NULL')} SELECT doc_id, r.text FROM documents LEFT JOIN r ON key = doc_id"


@query(_REPAIRED)
def txt6_repair(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", text.repair(F.expr(_LOOPED)).alias("text"))


@query()
def txt10_lcs(spark, d):
    a = tables.table(spark, d, "benchmark").select("item_id", text.anchor(F.col("text")).alias("a"), text.anchor(F.expr("substring(text, 20)")).alias("b"))
    return a.select("item_id", text.lcs_length("a", "b").alias("n"))


@query("SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', chr(10) || chr(10)), '\\n{2,}'), lambda p: trim(p)), lambda p: p <> '') AS paragraphs FROM documents")
def txt20_paragraphs(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", text.paragraphs(F.replace("text", F.lit(". "), F.lit("\n\n"))).alias("paragraphs"))


_NUMBER = "CASE event_id % 6 WHEN 0 THEN '1e10' WHEN 1 THEN ' 85 ' WHEN 2 THEN 'junk' WHEN 3 THEN '' WHEN 4 THEN '-7.5' ELSE CAST(value AS {0}) END"


@query(f"SELECT id, n, CAST(greatest(0, least(100, n)) AS INT) AS score FROM (SELECT event_id AS id, coalesce(CAST(trunc(TRY_CAST(trim({_NUMBER.format('VARCHAR')}) AS DOUBLE) + 0.5) AS BIGINT), 0) AS n FROM events)")
def jsn5_flexible_int(spark, d):
    n = text.flexible_int(F.expr(_NUMBER.format("STRING")))
    return tables.table(spark, d, "events").select(F.col("event_id").alias("id"), n.alias("n"), text.score(n).alias("score"))


@query("WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), f AS (SELECT doc_id, arg_min(" + _strip("t") + ", i) AS t, min(i) AS i FROM w WHERE " + _strip("t") + " <> '' GROUP BY doc_id, lower(" + _strip("t") + ")) SELECT d.doc_id AS id, CASE WHEN text IS NOT NULL THEN coalesce((SELECT list(f.t ORDER BY f.i) FROM f WHERE f.doc_id = d.doc_id)[1:5], []) END AS labels FROM documents d")
def arr1_labels(spark, d):
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.labels(F.split("text", " ")).alias("labels"))


_GAP = "date_diff('second', o_orderdate, TIMESTAMP '1998-06-01 12:00:00')"


@query(f"""SELECT o_orderkey AS id, CASE WHEN g < 60 THEN 'moments ago' WHEN g < 3600 THEN CAST(g // 60 AS VARCHAR) || CASE WHEN g // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END WHEN g < 86400 THEN CAST(g // 3600 AS VARCHAR) || CASE WHEN g // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE CAST(g // 86400 AS VARCHAR) || CASE WHEN g // 86400 = 1 THEN ' day ago' ELSE ' days ago' END END AS gap,
  CASE WHEN g < 3600 THEN 'now' WHEN g < 86400 THEN CAST(g // 3600 AS VARCHAR) || 'h' WHEN g < 2592000 THEN CAST(g // 86400 AS VARCHAR) || 'd' WHEN g < 31536000 THEN CAST(g // 2592000 AS VARCHAR) || 'm' ELSE CAST(g // 31536000 AS VARCHAR) || 'y' END AS short FROM (SELECT o_orderkey, {_GAP} AS g FROM orders)""")
def dt5_gaps(spark, d):
    gap = text.seconds_between(F.lit(NOW).cast("timestamp_ntz"), F.col("o_orderdate"))
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.human_gap(gap).alias("gap"), text.short_gap(gap).alias("short"))


# --- markup and links -----------------------------------------------------------------------------

#: What a page's markup ends with, so that references, quotes and open ends of all kinds occur.
_ENDED = """CASE page_id % 7 WHEN 0 THEN '<p>it&#39;s &eacute;t&eacute; &mdash; &#x41;&amp;lt;<!-- open <b>x</b>' WHEN 1 THEN '<a title="a>b">c</a> < d <!-- x -->e' WHEN 2 THEN 'f<style>p{}' WHEN 3 THEN ' tail <unclosed href="x' WHEN 4 THEN '<head/>f<p/>g<?pi h?>i</>j' WHEN 5 THEN '<DIV>k&notit; l' ELSE '' END"""


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    """The comparison engine's text: each pattern in turn."""
    for pattern, to in pairs:
        quoted = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{quoted}', {to}, 'g')"
    return x


_REST = r"""("[^"]*("|\z)|'[^']*('|\z)|[^'">])*(>|\z)"""
_NOISE = (r"(?s)<!--.*?(-->|\z)", *(rf"(?is)<{t}(\s[^>]*)?>.*?(</{t}>|\z)" for t in sorted(markup.NOISE)))
_REFERENCES = (("&quot;?", "'\"'"), ("&copy;?", "'©'"), ("&middot;?", "'·'"), ("&nbsp;?", "' '"), ("&lt;?", "'<'"), ("&gt;?", "'>'"), ("&#39;", "chr(39)"), ("&eacute;", "'é'"), ("&mdash;", "'—'"), ("&#x41;", "'A'"), ("&not", "'¬'"), ("&amp;?", "'&'"))
_PAGE_TEXT = f"(html || {_ENDED})"
_FLAT = "trim(" + _replaced(_PAGE_TEXT, *((p, "' '") for p in _NOISE), (f"(?s)<[A-Za-z/!?]{_REST}", "' '"), *_REFERENCES, (r"[\s\p{Z}]+", "' '")) + ")"
_LINED = _replaced(_PAGE_TEXT, *((p, "''") for p in _NOISE), (rf"(?is)</?({'|'.join(sorted(markup.BLOCKS))})([\s/]{_REST}|>)", "chr(10)"), (f"(?s)<[A-Za-z/!?]{_REST}", "''"), *_REFERENCES, (r"[\x{200b}-\x{200f}\x{2060}\x{feff}\x{ad}\x{180e}]", "''"))


def _pages(spark, d) -> DataFrame:
    return tables.table(spark, d, "pages").withColumn("html", F.concat("html", F.expr(_ENDED)))


@query(f"SELECT page_id, sha256({_FLAT}) AS body, length({_FLAT}) AS n FROM pages")
def html1_clean_text(spark, d):
    flat = text.clean_html(F.col("html"))
    return _pages(spark, d).select("page_id", flat.alias("flat")).select("page_id", F.sha2("flat", 256).alias("body"), F.length("flat").cast("long").alias("n"))


@query(f"SELECT page_id, left({_FLAT}, 40) AS head FROM pages")
def html1_clean_text_any(spark, d):
    return _pages(spark, d).select("page_id", text.clean_html(F.col("html"), 40).alias("head"))


@query(r"""SELECT page_id, list_distinct(l) = [] AS none, list_reduce(list_concat([[]::VARCHAR[]], list_transform(l, lambda u: [u])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END)[1:50] AS links FROM (SELECT page_id, list_transform(regexp_extract_all(html || ' [a](https://x.y/z)[b](https://q.r/s). https://e.f/g;;, https://x.y/z', 'https?://[^\s"''<>)]+'), lambda u: regexp_replace(u, '[.,);]+$', '')) AS l FROM pages)""")
def url2_links(spark, d):
    links = text.links(F.concat("html", F.lit(" [a](https://x.y/z)[b](https://q.r/s). https://e.f/g;;, https://x.y/z")))
    return tables.table(spark, d, "pages").select("page_id", (F.size(links) == 0).alias("none"), links.alias("links"))


@query()
def txt12_segments(spark, d):
    """Of every document each story's part, a story being a line, by its own anchor."""
    docs = tables.table(spark, d, "documents")
    sib = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("position"), x.alias("snippet"), F.lit("").alias("title")))
    return docs.select("doc_id", F.posexplode_outer(segments.segments_udf("text", sib)).alias("position", "part"))


#: Answers of all kinds made from one array; what an answer of each kind comes to.
_ANSWER = """CASE n WHEN 0 THEN a WHEN 1 THEN concat(' ```json', chr(10), a, chr(10), '``` so') WHEN 2 THEN concat('Here: ', a) WHEN 3 THEN concat('{"note":1,"stories":', a, '} bye') WHEN 4 THEN concat('{"items":', left(a, length(a) - 1)) WHEN 5 THEN concat(left(a, length(a) - 1), ',{"title":"b","url":"//') WHEN 6 THEN ' ' WHEN 7 THEN ' []' ELSE concat('{"title":"lone","relevance_score":"1e10","n":', length(a), '}') END"""


@query(f"""WITH {_repairing('r', "SELECT conv_id || '-' || turn AS key, coalesce(text, '') AS text FROM conversations")}, c AS (SELECT conv_id, turn, r.text AS t, (conv_id + turn) % 9 AS n FROM conversations JOIN r ON key = conv_id || '-' || turn), o AS (SELECT *, CASE WHEN n IN (2, 4, 6) OR n IN (0, 1, 3) AND t = '' THEN 'error' WHEN n = 5 THEN 'truncated' WHEN n = 7 THEN 'empty' ELSE 'ok' END AS outcome FROM c)
  SELECT conv_id, turn, outcome, CASE WHEN n = 8 THEN 'lone' WHEN outcome IN ('ok', 'truncated') THEN t END AS title, CASE WHEN n = 8 OR outcome IN ('ok', 'truncated') THEN 'story' END AS kind, CASE WHEN n = 8 THEN 100 WHEN outcome IN ('ok', 'truncated') THEN CAST(greatest(0, least(100, turn)) AS INT) END AS relevance_score FROM o WHERE n <> 5 OR t <> ''
  UNION ALL SELECT conv_id, turn, outcome, 'b', 'story', 0 FROM o WHERE n = 5""")
def jsn1_parse_items(spark, d):
    """Items of answers made from conversation turns: whole, fenced, wrapped, cut off, empty, and none."""
    item = F.to_json(F.array(F.struct(F.col("text").alias("title"), F.col("role").alias("kind"), F.col("turn").alias("relevance_score"))))
    turn = tables.table(spark, d, "conversations").select("conv_id", "turn", item.alias("a"), ((F.col("conv_id") + F.col("turn")) % 9).alias("n"))
    parsed = turn.select("conv_id", "turn", model_json.parse_udf(F.expr(_ANSWER)).alias("p"))
    return parsed.select("conv_id", "turn", "p.outcome", F.posexplode_outer("p.items").alias("pos", "item")).select("conv_id", "turn", "outcome", "item.title", "item.kind", "item.relevance_score")


@query(ORACLE_SQL["jsn1_parse_items"])
def jsn3_items_table(spark, d):
    """The same items by the table function, in SQL."""
    item = F.to_json(F.array(F.struct(F.col("text").alias("title"), F.col("role").alias("kind"), F.col("turn").alias("relevance_score"))))
    turn = tables.table(spark, d, "conversations").select("conv_id", "turn", item.alias("a"), ((F.col("conv_id") + F.col("turn")) % 9).alias("n"))
    model_json.register(spark)
    return spark.sql("SELECT conv_id, turn, i.outcome, i.title, i.kind, i.relevance_score FROM {answers} a, LATERAL items_of(a.answer) i", answers=turn.select("conv_id", "turn", F.expr(_ANSWER).alias("answer")))


# --- intake and scoring ---------------------------------------------------------------------------

_MESSAGES = f"""messages AS (SELECT doc_id AS seq, lower(source) || '@x.example' AS identity, CASE WHEN doc_id % 7 = 0 THEN 'm' || CAST(doc_id // 21 AS VARCHAR) END AS message_id, CASE WHEN b <> '' THEN sha256(lower(b)) END AS hash FROM (SELECT *, left({_BODY.replace('text', "coalesce(text, '')")}, 24000) AS b FROM documents)),
  ids AS (SELECT message_id, min(seq) AS seq FROM messages WHERE message_id IS NOT NULL GROUP BY message_id), named AS (SELECT m.* FROM messages m JOIN ids USING (seq)), known AS (SELECT hash, min(seq) AS known FROM named WHERE hash IS NOT NULL GROUP BY hash),
  firsts AS (SELECT hash, min(seq) AS seq FROM messages WHERE message_id IS NULL AND hash IS NOT NULL GROUP BY hash),
  kept AS (SELECT seq FROM named UNION ALL SELECT f.seq FROM firsts f LEFT JOIN known k ON k.hash = f.hash WHERE k.known IS NULL OR k.known > f.seq UNION ALL SELECT seq FROM messages WHERE message_id IS NULL AND hash IS NULL),
  keyed AS (SELECT m.*, k.seq IS NOT NULL AS stored, sha256(identity || '|' || CAST(m.seq AS VARCHAR)) AS key FROM messages m LEFT JOIN kept k USING (seq))"""


def _messages(spark, d) -> DataFrame:
    key, none = F.col("doc_id"), F.lit(None).cast("string")
    sent = tables.table(spark, d, "documents").select(key.alias("seq"), F.concat(F.lit(" "), F.upper("source"), F.lit("@x.example ")).alias("from_addr"), F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("from_name"), none.alias("subject"), F.when(key % 7 == 0, F.concat(F.lit("m"), F.floor(key / 21).cast("string"))).alias("message_id"), F.lit("").alias("raw_html"), F.col("text").alias("body_text"), F.lit(None).cast("timestamp_ntz").alias("received_at"))
    return intake.normalised(sent, F.lit(NOW).cast("timestamp_ntz"))


@query(f"""WITH {_MESSAGES} SELECT seq, CASE WHEN message_id IS NOT NULL THEN first_value(key) OVER (PARTITION BY message_id ORDER BY seq) WHEN hash IS NULL OR stored THEN key
  ELSE last_value(CASE WHEN stored THEN key END IGNORE NULLS) OVER (PARTITION BY hash ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS id,
  'pending_scoring' AS status, sha256('newsletter|' || identity) AS source_id, NOT stored AS duplicate FROM keyed""")
def api9_ingest(spark, d):
    return intake.ingest(_messages(spark, d))


@query(ORACLE_SQL["api9_ingest"])
def api9_ingest_again(spark, d):
    """The same deliveries in two batches, the second against what the first one stored."""
    rows, at = _messages(spark, d), F.lit(NOW).cast("timestamp_ntz")
    cut = rows.agg(F.max("seq")).first()[0] // 2
    early, late = rows.filter(F.col("seq") <= cut), rows.filter(F.col("seq") > cut)
    told = intake.ingest(early)
    return told.unionByName(intake.ingest(late, intake.fresh(early, told, at + F.make_dt_interval(secs=F.col("seq"))), span=100))


@query(f"SELECT doc_id AS seq, lower(source) || '@x.example' AS identity, CASE WHEN lang <> 'en' THEN lang ELSE lower(source) END AS name, TIMESTAMP '{NOW}' AS received_at FROM documents")
def txt5_senders(spark, d):
    return _messages(spark, d).select("seq", "identity", "name", "received_at")


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'h' ELSE 't' END AS way, sha256(CASE WHEN page_id % 2 = 0 THEN left({_FLAT}, 500) ELSE left({_BODY.replace('text', 'html')}, 500) END) AS body, CASE WHEN page_id % 2 = 0 THEN {_PAGE_TEXT} ELSE url END AS preferred FROM pages")
def txt3_prepared_bodies(spark, d):
    even = F.col("page_id") % 2 == 0
    html = F.when(even, F.concat("html", F.expr(_ENDED))).otherwise("")
    return tables.table(spark, d, "pages").select("page_id", F.when(even, "h").otherwise("t").alias("way"), F.sha2(text.prepared(html, F.col("html"), 500), 256).alias("body"), text.preferred(html, F.col("url")).alias("preferred"))


@query("SELECT o_orderkey AS id, 'k' || o_orderkey || '@x' AS message_id FROM orders")
def src6_message_ids(spark, d):
    key = F.concat(F.lit("k"), F.col("o_orderkey").cast("string"), F.lit("@x"))
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" <"), key, F.lit(">\t"))).otherwise(key)
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.message_id(raw).alias("message_id"))


_LINES = f"""lines AS (SELECT CAST(doc_id AS VARCHAR) AS newsletter_id, pos, {_BODY.replace('text', 'line')} AS x FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))"""


def _scored(spark, d) -> DataFrame:
    key = F.col("doc_id")
    sent = tables.table(spark, d, "documents").select(key.cast("string").alias("id"), F.when(key % 3 > 0, F.col("source")).otherwise(" ").alias("subject"), F.when(key % 11 > 0, F.col("text")).alias("body_text"), (key % 4).alias("scoring_attempts"))
    return scoring.score(sent, scoring.RuleScorer(), ("rail", "cities"))


@query(f"""WITH {_LINES}, x AS (SELECT newsletter_id, pos, x, row_number() OVER (PARTITION BY newsletter_id ORDER BY pos) - 1 AS position FROM lines WHERE x <> '' AND CAST(newsletter_id AS BIGINT) % 11 > 0),
  {_repairing('whole', "SELECT newsletter_id || '-' || position AS key, x AS text FROM x")}, {_repairing('head', "SELECT newsletter_id || '-' || position AS key, rtrim(left(x, 80)) AS text FROM x")}
  SELECT newsletter_id, position, CASE WHEN length(x) >= 200 THEN 'story' ELSE 'blurb' END AS kind, nullif(head.text, '') AS title, nullif(left(whole.text, 1000), '') AS snippet, CASE WHEN length(x) >= 200 THEN left(whole.text, 800) END AS summary, CASE WHEN length(x) >= 200 THEN CAST(length(x) % 101 AS INT) END AS relevance_score, CASE WHEN length(x) >= 200 THEN TIMESTAMP '{NOW}' END AS scored_at
  FROM x JOIN whole ON whole.key = newsletter_id || '-' || position JOIN head ON head.key = whole.key""")
def api10_scored_stories(spark, d):
    found = scoring.stories_of(_scored(spark, d), "rules", F.lit(NOW).cast("timestamp_ntz"))
    return found.select("newsletter_id", "position", "kind", "title", "snippet", "summary", "relevance_score", "scored_at")


@query(f"""WITH {_LINES}, n AS (SELECT newsletter_id, count(*) FILTER (WHERE x <> '') AS n FROM lines GROUP BY newsletter_id), i AS (SELECT newsletter_id, CAST(newsletter_id AS BIGINT) AS k, CASE WHEN CAST(newsletter_id AS BIGINT) % 11 > 0 THEN n ELSE 0 END AS n FROM n)
  SELECT newsletter_id AS id, CASE WHEN k % 3 = 0 AND n = 0 THEN 'ok' WHEN n = 0 THEN 'empty' ELSE 'ok' END AS outcome, CASE WHEN k % 3 > 0 AND n = 0 THEN 'failed' ELSE 'scored' END AS status, n AS n_items FROM i""")
def flt15_scoring_outcomes(spark, d):
    """Blank newsletters are scored without a call, others without an item fail."""
    return _scored(spark, d).select("id", "outcome", "status", F.size("items").cast("long").alias("n_items"))


_PROMPT = text.prompt_head(("rail", "cities")).replace("'", "''")


@query(f"SELECT doc_id AS id, sha256('{_PROMPT}' || chr(10) || 'Source: ' || lang || chr(10) || 'Subject: ' || source || chr(10) || 'Text:' || chr(10) || coalesce(text, '')) AS prompt FROM documents")
def txt18_prompts(spark, d):
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(text.prompt(F.col("source"), F.col("text"), F.col("lang"), ("rail", "cities")), 256).alias("prompt"))


@query("SELECT id, newsletter_id, position, kind FROM v_stories WHERE position <= 3 UNION ALL SELECT id, newsletter_id, position, CASE WHEN position = 5 THEN 'story' ELSE kind END FROM v_stories WHERE position > 3", True)
def dml6_insert_many(spark, d):
    s = tables.stories(spark, d).select("id", "newsletter_id", "position", "kind")
    return state.insert_many(s.filter("position <= 3"), s.filter("position > 3").withColumn("kind", F.when(F.col("position") != 5, F.col("kind")).otherwise("")))


@query(f"SELECT id, CASE WHEN kind = 'story' AND position <= 2 THEN upper(title) ELSE summary END AS summary, CASE WHEN kind = 'story' AND position <= 2 THEN position * 10 ELSE relevance_score END AS relevance_score, CASE WHEN kind = 'story' AND position <= 2 THEN 'm' END AS model, CASE WHEN kind = 'story' AND position <= 2 THEN TIMESTAMP '{NOW}' ELSE scored_at END AS scored_at FROM v_stories", True)
def dml7_score_update(spark, d):
    s = tables.stories(spark, d)
    scores = s.filter("position <= 2").select("id", F.upper("title").alias("summary"), (F.col("position") * 10).alias("relevance_score"), F.lit("t").alias("primary_topic"), F.array(F.lit("l")).alias("labels"))
    after = state.score_update(s.withColumn("labels", F.lit(None).cast("array<string>")).withColumns({"model": F.lit(None).cast("string"), "prompt_version": F.lit(None).cast("string")}), scores, "m", "1", F.lit(NOW).cast("timestamp_ntz"))
    return after.select("id", "summary", "relevance_score", "model", "scored_at")


_MOVE = "CASE event_type WHEN 'view' THEN 'claim' WHEN 'signup' THEN 'claim' WHEN 'click' THEN 'requeue' WHEN 'purchase' THEN 'done' ELSE 'fail' END"


@query(f""", e AS (SELECT CAST(event_id % 2000 AS VARCHAR) AS id, event_id AS seq, {_MOVE} AS action, event_type AS reason FROM events), l AS (SELECT id, arg_max(action, seq) AS action, arg_max(reason, seq) AS reason, count(*) FILTER (WHERE action = 'claim') AS claims FROM e GROUP BY id)
  SELECT n.id, CASE l.action WHEN 'claim' THEN 'scoring' WHEN 'requeue' THEN 'pending_scoring' WHEN 'done' THEN 'scored' WHEN 'fail' THEN 'failed' ELSE processing_status END AS processing_status, CASE WHEN l.action = 'fail' THEN l.reason END AS scoring_error, CAST(scoring_attempts + coalesce(claims, 0) AS INT) AS scoring_attempts FROM v_newsletters n LEFT JOIN l ON l.id = n.id""", True)
def dml4_transitions(spark, d):
    e = tables.table(spark, d, "events").select((F.col("event_id") % 2000).cast("string").alias("id"), F.col("event_id").alias("seq"), F.expr(_MOVE).alias("action"), F.col("event_type").alias("reason"))
    return state.transitions(tables.newsletters(spark, d), e).select("id", "processing_status", "scoring_error", "scoring_attempts")


@query("SELECT count(*) AS affected FROM v_newsletters WHERE processing_status = 'scoring'", True)
def agg11_affected(spark, d):
    return spark.createDataFrame([(state.affected(tables.newsletters(spark, d), F.col("processing_status") == "scoring"),)], "affected long")


@query("SELECT id, processing_status FROM v_newsletters WHERE id = '1' UNION ALL SELECT id, processing_status FROM (SELECT * FROM v_newsletters WHERE processing_status = 'scored' ORDER BY ingested_at DESC, id DESC LIMIT 1)", True)
def src11_lookups(spark, d):
    n = tables.newsletters(spark, d).withColumn("hash", F.col("processing_status"))
    return state.lookup(n, id="1").unionByName(state.lookup(n, hash="scored")).select("id", "processing_status")


# --- parameters and small texts -------------------------------------------------------------------

_GIVEN = "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN {day} WHEN 2 THEN {time} || 'Z' WHEN 3 THEN {time} || '+02:00' ELSE 'soon' END"
_DAY, _TIME = "strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) WHEN 2 THEN date_trunc('second', o_orderdate) WHEN 3 THEN date_trunc('second', o_orderdate) - INTERVAL '2' HOUR END AS bound, o_orderkey % 5 <> 4 AS valid FROM orders")
def dt4_time_bounds(spark, d):
    given = F.expr(_GIVEN.format(day="date_format(o_orderdate, 'yyyy-MM-dd')", time="date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")"))
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.time_bound(given).alias("bound"), text.is_time_bound(given).alias("valid"))


_PRESET = "CASE o_orderkey % 4 WHEN 0 THEN '24h' WHEN 1 THEN 'week' WHEN 2 THEN 'month' ELSE 'any' END"


@query(f"""SELECT id, since, CASE WHEN since = '' THEN 'any' WHEN n <= 1 THEN '24h' WHEN n <= 7 THEN 'week' ELSE 'month' END AS preset FROM (SELECT *, floor(date_diff('second', CAST(nullif(since, '') AS TIMESTAMP), o_orderdate) / 86400.0 + 0.5) AS n FROM
  (SELECT o_orderkey AS id, o_orderdate, CASE {_PRESET} WHEN '24h' THEN strftime(o_orderdate - INTERVAL '1' DAY, '%Y-%m-%d') WHEN 'week' THEN strftime(o_orderdate - INTERVAL '7' DAY, '%Y-%m-%d') WHEN 'month' THEN strftime(o_orderdate - INTERVAL '30' DAY, '%Y-%m-%d') ELSE '' END AS since FROM orders))""")
def dt7_range_presets(spark, d):
    now = F.col("o_orderdate")
    ranged = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), now, text.range_from(F.expr(_PRESET), now).alias("since"))
    return ranged.select("id", "since", text.preset_of(F.col("since"), now).alias("preset"))


_COLOURS = "CASE p_partkey % 3 WHEN 0 THEN 'hsl(' || CAST(p_size * 9 AS {0}) || ', 62%, 56%)' WHEN 1 THEN 'HSL( ' || CAST(p_size AS {0}) || '.5, 1%, 2%)' ELSE 'red' END"


@query("SELECT p_partkey AS id, CAST(CASE p_partkey % 3 WHEN 0 THEN (p_size * 9) % 360 WHEN 1 THEN p_size + 1 ELSE 40 END AS INT) AS hue FROM part")
def hsh3_hues(spark, d):
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.hue_of(F.expr(_COLOURS.format("STRING"))).alias("hue"))


_IDS = "CASE WHEN c_custkey % 2 = 0 THEN concat_ws('-', substr(md5(c_name), 1, 8), substr(md5(c_name), 9, 4), substr(md5(c_name), 13, 4), substr(md5(c_name), 17, 4), substr(md5(c_name), 21, 12)) ELSE c_name END"


@query("SELECT c_custkey AS id, c_custkey % 2 = 0 AS valid FROM customer")
def flt13_valid_ids(spark, d):
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.is_uuid(F.expr(_IDS)).alias("valid"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = event_id % 2 THEN 'none' ELSE ['none', 'up'][CAST(event_id % 2 AS INT) + 1] END AS rating FROM events")
def ui5_rating_choice(spark, d):
    name = lambda n: F.element_at(F.array(F.lit("none"), F.lit("up"), F.lit("down")), (F.col("event_id") % n + 1).cast("int"))
    return tables.table(spark, d, "events").select(F.col("event_id").alias("id"), text.next_rating(name(3), name(2)).alias("rating"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS web, CASE WHEN page_id % 3 = 0 THEN 'https://b/#/items/' || page_id ELSE url END AS link FROM pages")
def url3_web_links(spark, d):
    raw = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url"))
    pages = tables.table(spark, d, "pages").select("page_id", text.web_only(raw).alias("web"))
    return pages.select("page_id", "web", text.item_link(F.col("web"), "https://b", F.col("page_id").cast("string")).alias("link"))


_FENCED = "CASE doc_id % 6 WHEN 0 THEN ' ```json' || chr(10) || text || chr(10) || '```' || chr(10) WHEN 1 THEN '```json' || chr(10) || text || chr(10) || '``` trailing' WHEN 2 THEN '```' || chr(10) || text || ' ``` a ````' WHEN 3 THEN '```' || replace(text, chr(10), ' ') WHEN 4 THEN text || chr(10) || '```' ELSE text END"


@query(f"""WITH t AS (SELECT doc_id AS id, {_strip(_FENCED)} AS t FROM documents), i AS (SELECT id, t, starts_with(t, '```') AND contains(t, chr(10)) AS fenced, substr(t, strpos(t, chr(10)) + 1) AS inner_text FROM t)
  SELECT id, CASE WHEN NOT fenced THEN t WHEN contains(inner_text, '```') THEN {_strip("left(inner_text, length(inner_text) - strpos(reverse(inner_text), '```') - 2)")} ELSE {_strip('inner_text')} END AS body FROM i""")
def txt17_unfenced(spark, d):
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.unfence(F.expr(_FENCED)).alias("body"))


@query("SELECT doc_id AS id, source || ' part ' || lang AS name FROM documents")
def txt19_source_names(spark, d):
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.source_title(F.concat(F.lit("/a.b/"), "source", F.lit("-part_"), "lang", F.lit(".html"))).alias("name"))


@query("SELECT c_custkey AS id, [c_name, c_mktsegment] AS parts FROM customer")
def arr2_csv(spark, d):
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.csv_list(F.concat(F.lit(" "), "c_name", F.lit(",\t"), "c_mktsegment", F.lit("\u00a0,, "))).alias("parts"))


@query("SELECT doc_id AS id, text AS body FROM documents")
def html3_visible(spark, d):
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.strip_invisible(F.replace("text", F.lit("e"), F.lit("\u200be\u00ad"))).alias("body"))


_BLOCK = "regexp_replace(" + _strip("array_to_string(list_transform(string_split(text, chr(10)), lambda x: " + _BODY.replace("text", "x") + "), chr(10))") + ", '\\n{3,}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id AS id, {_BLOCK} AS body FROM (SELECT doc_id, replace(text, '. ', '. ' || chr(10) || ' ' || chr(10) || chr(10)) AS text FROM documents)")
def html4_block_lines(spark, d):
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.block_text(F.replace("text", F.lit(". "), F.lit(". \n \n\n"))).alias("body"))


_BLOCK_PAGE = f"regexp_replace(regexp_replace(array_to_string(list_transform(string_split({_LINED}, chr(10)), lambda x: {_BODY.replace('text', 'x')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"


@query(f"SELECT page_id, {_BLOCK_PAGE} AS body FROM pages")
def html2_block_text(spark, d):
    return _pages(spark, d).select("page_id", markup.block_text_udf("html").alias("body"))


@query("SELECT doc_id AS id, i - 1 AS position, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def win3_ordinals(spark, d):
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.inline(text.lines(F.col("text"))))
