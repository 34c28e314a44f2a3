"""Changing state as folds over append-only rows: dedupe, queue, routing, engagement, replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_sources(deliveries: DataFrame) -> DataFrame:
    """A source per (kind, identity), named by its first delivery (seq)."""
    return deliveries.groupBy("kind", "identity").agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("first_seq"))


def surviving(deliveries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Deliveries (seq, message_id, hash) that are stored: the first of each message id; of the rest the first of
    each hash unless an earlier stored delivery with an id has it; and those with neither. ``known`` has the keys (message_id, hash) of
    what is stored already: its message ids are not stored again, nor are deliveries without one that have its hashes."""
    if known is not None:
        held = lambda c: known.filter(F.col(c).isNotNull()).select(F.col(c).alias("_held")).distinct()
        named = F.coalesce(F.col("message_id") != "", F.lit(False))
        fresh = deliveries.join(held("message_id"), named & (F.col("message_id") == F.col("_held")), "left_anti")
        return surviving(fresh.join(held("hash"), ~named & (F.col("hash") == F.col("_held")), "left_anti"))
    named = F.coalesce(F.col("message_id") != "", F.lit(False))
    bare = ~named & F.col("hash").isNotNull()
    keys = [F.when(named, F.col("message_id")).alias("message_id"), F.when(bare, F.col("hash")).alias("bare_hash"), F.when(~named & ~bare, F.col("seq")).alias("lone")]
    # What a delivery is comes out of the aggregate, so that no filter is pushed below it: both uses share one scan and shuffle.
    firsts = deliveries.groupBy(*keys).agg(F.min(F.struct("seq", "hash")).alias("first"), F.bool_and(bare).alias("is_bare")).select("message_id", "first.seq", "first.hash", "is_bare")
    by_hash = firsts.filter("hash is not null").groupBy("hash").agg(F.min(F.when(F.col("is_bare"), F.col("seq"))).alias("seq"), F.min(F.when(~F.col("is_bare"), F.col("seq"))).alias("known"))
    soft = by_hash.filter("seq is not null and (known is null or known > seq)").select("seq", F.lit(None).cast("string").alias("message_id"), "hash")
    return firsts.filter("not is_bare").select("seq", "message_id", "hash").unionByName(soft)


def pending(newsletters: DataFrame, limit: int) -> DataFrame:
    """The queue's head, oldest first."""
    return newsletters.filter("processing_status = 'pending_scoring'").orderBy("ingested_at", "id").limit(limit)


def claim(newsletters: DataFrame, limit: int = 5) -> DataFrame:
    """All newsletters after the oldest pending ones are taken: status scoring, one attempt more. The batch is
    limited by its parameter, so it may be broadcast."""
    taken = F.broadcast(pending(newsletters, limit).select(F.col("id").alias("_taken")))
    hit = F.col("_taken").isNotNull()
    return newsletters.join(taken, F.col("id") == F.col("_taken"), "left").withColumns({"processing_status": F.when(hit, "scoring").otherwise(F.col("processing_status")), "scoring_attempts": F.col("scoring_attempts") + hit.cast("int")}).withColumn("claimed", hit).drop("_taken")


def requeue_stale(newsletters: DataFrame) -> DataFrame:
    return newsletters.withColumn("processing_status", F.when(F.col("processing_status") == "scoring", "pending_scoring").otherwise(F.col("processing_status")))


def route(outcome: Column, deterministic: Column, attempts: Column, n_items: Column, most: int = 3) -> Column:
    """The next status after scoring. Transport errors go back without bound; a truncated or empty result goes back
    if it may differ next time, else what was salvaged is kept; all else fails."""
    again = ~deterministic & (attempts < most)
    return F.when(outcome == "ok", "scored").when(outcome == "transport", "pending_scoring").when((outcome == "truncated") & again, "pending_scoring").when((outcome == "truncated") & (n_items > 0), "scored").when((outcome == "empty") & again, "pending_scoring").otherwise("failed")


def engagement(events: DataFrame) -> DataFrame:
    """The state of each story after its events (story, seq, action): bookmarks toggle, the last rating holds,
    the first opening counts, an ad stays one."""
    rated = F.col("action").isin("up", "down", "none")
    return events.groupBy("story").agg(
        (F.count_if(F.col("action") == "toggle") % 2 == 1).alias("bookmarked"),
        F.nullif(F.max_by(F.when(rated, F.col("action")), F.when(rated, F.col("seq"))), F.lit("none")).alias("rating"),
        F.min(F.when(F.col("action") == "open", F.col("seq"))).alias("opened_seq"),
        F.bool_or(F.col("action") == "ad").alias("is_ad"),
    )


def sessions(seen: DataFrame) -> DataFrame:
    """When each label (label, ts) was last seen."""
    return seen.groupBy("label").agg(F.max("ts").alias("last_viewed_at"))


def ensure_session(known: DataFrame, label: str = "default") -> DataFrame:
    """The sessions (label, last_viewed_at) with one for the label, which has seen nothing yet if it is new."""
    one = known.sparkSession.createDataFrame([(label,)], "label string").join(known.select("label"), "label", "left_anti")
    return known.unionByName(one, allowMissingColumns=True)


def touch(known: DataFrame, label: str, at: Column) -> DataFrame:
    """The sessions after one has looked; LookupError for a label that is not known."""
    affected(known, F.col("label") == label)
    return known.withColumn("last_viewed_at", F.when(F.col("label") == label, at).otherwise(F.col("last_viewed_at")))


def mark_seen(known: DataFrame, at: Column, label: str = "default") -> DataFrame:
    return touch(ensure_session(known, label), label, at)


def affected(rows: DataFrame, hit: Column) -> int:
    """How many rows a change meets; LookupError for none."""
    n = rows.filter(hit).count()
    if not n:
        raise LookupError("no such row")
    return n


def lookup(rows: DataFrame, *, id: str | None = None, message_id: str | None = None, hash: str | None = None) -> DataFrame:
    """The row of an id or message id, or the latest one of a hash."""
    if id is not None:
        return rows.filter(F.col("id") == id)
    if message_id is not None:
        return rows.filter(F.col("message_id") == message_id)
    return rows.filter(F.col("hash") == hash).orderBy(F.desc("ingested_at"), F.desc("id")).limit(1)


def transitions(newsletters: DataFrame, events: DataFrame) -> DataFrame:
    """Newsletters after events (id, seq, action, reason): the last one tells the status; a failure keeps its reason, all else
    clears it; every claim is an attempt."""
    to = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])
    last = events.groupBy("id").agg(F.max_by("action", "seq").alias("_action"), F.max_by("reason", "seq").alias("_reason"), F.count_if(F.col("action") == "claim").alias("_claims"))
    joined = newsletters.join(last, "id", "left")
    return joined.withColumns({
        "processing_status": F.coalesce(to[F.col("_action")], "processing_status"),
        "scoring_error": F.when(F.col("_action") == "fail", F.col("_reason")),
        "scoring_attempts": F.col("scoring_attempts") + F.coalesce("_claims", F.lit(0)).cast("int"),
    }).drop("_action", "_reason", "_claims")


#: Statuses, and the one each event leads to. Fixed values.
STATUSES = ("pending_scoring", "scoring", "scored", "failed")
STATUS_OF = {"claim": "scoring", "requeue": "pending_scoring", "done": "scored", "fail": "failed"}


def insert_many(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored stories and fresh ones, whose kind is story where none is given."""
    return stored.unionByName(fresh.withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), F.lit("story"))), allowMissingColumns=True)


def score_update(stories: DataFrame, scores: DataFrame, model: str, version: str, now: Column) -> DataFrame:
    """Stories with the scores (id, summary, relevance_score, primary_topic, labels) that are given for those of kind story."""
    fields = ("summary", "relevance_score", "primary_topic", "labels")
    joined = stories.join(scores.select("id", F.struct(*fields).alias("_new")), "id", "left")
    hit = (F.col("kind") == "story") & F.col("_new").isNotNull()
    kept = lambda c: F.col(c) if c in stories.columns else F.lit(None)
    news = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(kept(c)) for c in fields}
    return joined.withColumns(news | {"model": F.when(hit, F.lit(model)).otherwise(kept("model")), "prompt_version": F.when(hit, F.lit(version)).otherwise(kept("prompt_version")), "scored_at": F.when(hit, now).otherwise(kept("scored_at"))}).drop("_new")


def carry_over(new: DataFrame, prior: DataFrame, within: str | None = None) -> DataFrame:
    """New stories with the engagement of the prior story of the same url (and newsletter, if ``within`` names its column);
    of several the highest position wins. Stories without a url carry nothing over."""
    keys = [within, "url"] if within else ["url"]
    held = prior.filter("url <> '' and (bookmarked or user_rating is not null or opened_at is not null)")
    last = held.groupBy(*keys).agg(F.max_by(F.struct("bookmarked", "user_rating", "opened_at"), F.struct("position", "id")).alias("was"))
    return new.join(last, keys, "left").select(*new.columns, F.coalesce("was.bookmarked", F.lit(False)).alias("bookmarked"), F.col("was.user_rating").alias("user_rating"), F.col("was.opened_at").alias("opened_at"))


def replace_all(stored: DataFrame, fresh: DataFrame, key: str = "newsletter_id") -> DataFrame:
    """Stored rows with all those of the fresh rows' keys replaced."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def invalid_stories(stories: DataFrame) -> DataFrame:
    """Rows that break a constraint, with its name."""
    broken = F.when(~F.col("kind").isin("story", "blurb", "ad", "promo"), "kind").when(~F.col("relevance_score").between(0, 100), "score").when(~F.col("user_rating").isin(-1, 1), "rating")
    return stories.select("id", broken.alias("broken")).filter("broken is not null")


def invalid_newsletters(newsletters: DataFrame) -> DataFrame:
    """Rows whose status is none."""
    return newsletters.filter(~F.col("processing_status").isin(*STATUSES)).select("id", F.lit("status").alias("broken"))


def latest_by_hash(rows: DataFrame) -> DataFrame:
    """The newest row of each hash, by an aggregate that is partial before the shuffle."""
    others = [c for c in rows.columns if c != "hash"]
    return rows.groupBy("hash").agg(F.max_by(F.struct(*others), "seq").alias("_last")).select("hash", *[F.col(f"_last.{c}").alias(c) for c in others])
