"""From messages to stored newsletters: sources, bodies, hashes, dedupe and what each sender is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.sources import shared


def source_key(identity: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("newsletter"), identity), 256)


def normalised(messages: DataFrame, now: Column, most: int = 24_000) -> DataFrame:
    """Messages (seq, from_addr, from_name, subject, message_id, raw_html, body_text, received_at) as newsletters: the source's
    identity and name, the prepared body and its hash; empty texts are null, and a missing time is now."""
    identity = text.address(F.coalesce("from_addr", F.lit("")))
    body = text.prepared(F.col("raw_html"), F.col("body_text"), most)
    blank = lambda c: F.nullif(c, F.lit(""))
    named = messages.withColumn("identity", identity).withColumn("body", body)
    return named.select(
        "seq", "identity", F.coalesce(blank("from_name"), text.display_name(F.col("identity"))).alias("name"), blank("subject").alias("subject"), blank("message_id").alias("message_id"),
        blank("raw_html").alias("raw_html"), blank("body").alias("body_text"), text.dedupe_hash(F.col("body")).alias("hash"), text.received_or(F.col("received_at"), now).alias("received_at"),
    )


def key_of(seq: Column, identity: Column) -> Column:
    """A newsletter's id, the same in every run."""
    return F.sha2(F.concat_ws("|", identity, seq.cast("string")), 256)


#: What ingest must know of stored newsletters.
KNOWN = "id string, message_id string, hash string, ingested_at timestamp_ntz"


def ingest(newsletters: DataFrame, known: DataFrame | None = None, span: int = 100_000) -> DataFrame:
    """What each delivery is told: id, status, source_id and whether it is a duplicate. A duplicate gets the id of the stored newsletter: that of its message
    id, else the latest one stored before it with its hash. ``known`` has the newsletters that earlier batches stored (KNOWN).

    Deliveries are read once, as a number and their keys. Stored rows are cut down to the batch's keys before anything else, so that
    a small batch is broadcast to them and no stored row is shuffled. The latest row before a delivery is looked for among ``span`` numbers of one hash at a
    time, with what the spans before it leave carried over, so that a frequent hash is shared out.
    """
    rows = shared.stored(newsletters.select("seq", "identity", "message_id", "hash", key_of(F.col("seq"), F.col("identity")).alias("id")))
    known = rows.sparkSession.createDataFrame([], KNOWN) if known is None else known
    named, bare = rows.filter("message_id is not null"), rows.filter("message_id is null and hash is not null")

    known_names = known.join(named.select("message_id").distinct(), "message_id", "left_semi").groupBy("message_id").agg(F.min_by("id", F.struct("ingested_at", "id")).alias("known_id"))
    first = named.groupBy("message_id").agg(F.min(F.struct("seq", "id", "hash")).alias("first")).join(known_names, "message_id", "left")
    by_name = named.drop("id").join(first, "message_id").select(
        "seq", F.coalesce("known_id", "first.id").alias("id"), "identity", (F.col("known_id").isNotNull() | (F.col("seq") != F.col("first.seq"))).alias("duplicate")
    )

    kept = first.filter("known_id is null and first.hash is not null").select("first.hash", "first.seq", "first.id")
    known_hashes = known.select("hash", "id", "ingested_at").join(bare.select("hash").distinct(), "hash", "left_semi")
    latest = known_hashes.groupBy("hash").agg(F.max_by("id", F.struct("ingested_at", "id")).alias("known_id"))
    # Of each hash the first delivery without a message id is stored, unless one with its hash was before it.
    least = bare.groupBy("hash").agg(F.min(F.struct("seq", "id")).alias("own")).join(kept.groupBy("hash").agg(F.min("seq").alias("named")), "hash", "left").join(latest, "hash", "left")
    opened = least.withColumn("own", F.when(F.col("known_id").isNull() & (F.col("named").isNull() | (F.col("named") > F.col("own.seq"))), F.col("own")))
    marks = kept.unionByName(opened.filter("own is not null").select("hash", "own.seq", "own.id"))

    none = lambda t, name: F.lit(None).cast(t).alias(name)
    part = F.floor(F.col("seq") / span).alias("part")
    both = bare.select("hash", "seq", part, "identity", none("string", "mark")).unionByName(marks.select("hash", "seq", part, none("string", "identity"), F.col("id").alias("mark")))
    before = both.groupBy("hash", "part").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("seq"))).alias("last"))
    earlier = Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = before.select("hash", "part", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    here = Window.partitionBy("hash", "part").orderBy("seq", F.col("mark").isNull())
    found = both.withColumn("mark", F.last("mark", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("identity is not null")
    told = found.join(carried, ["hash", "part"]).join(opened.select("hash", "known_id", F.col("own.seq").alias("own")), "hash")
    by_hash = told.select("seq", F.coalesce("mark", "carried", "known_id").alias("id"), "identity", (~F.col("seq").eqNullSafe(F.col("own"))).alias("duplicate"))

    lone = rows.filter("message_id is null and hash is null").select("seq", "id", "identity", F.lit(False).alias("duplicate"))
    every = by_name.unionByName(by_hash).unionByName(lone)
    return every.select("seq", "id", F.lit("pending_scoring").alias("status"), source_key(F.col("identity")).alias("source_id"), "duplicate")


def fresh(newsletters: DataFrame, told: DataFrame, now: Column) -> DataFrame:
    """The newsletters to store, by what ingest told of each: those that are no duplicates, waiting to be scored."""
    new = told.filter("not duplicate").select("seq", "id", "source_id", F.col("status").alias("processing_status"))
    return newsletters.join(new, "seq").withColumns({"ingested_at": now, "scoring_attempts": F.lit(0), "scoring_error": F.lit(None).cast("string")}).drop("seq", "identity", "name")
