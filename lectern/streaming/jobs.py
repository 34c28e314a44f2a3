"""Streams: intake of messages with dedupe, the life of each newsletter as keyed state, and the polled queue as micro-batches over versioned tables."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lectern.operators import intake as intakes
from lectern.operators import scoring, state
from lectern.sources import mail, shared


def intake(spark: SparkSession, path: str, schema: str, files: int = 5, within: str = "7 days", time: str = "received_at") -> DataFrame:
    """Deliveries from a drop folder, a bounded number of files at a time, each message id once. A delivery that comes again
    is known for as long as ``within`` tells after its time; state of earlier ones is let go."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(["message_id"])


def messages(spark: SparkSession, path: str, files: int = 100, most: int = mail.MOST_BYTES) -> DataFrame:
    """Messages from a folder to which files are added, a file each, as mail.read has them; larger files are left out before they are read."""
    given = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files).load(path)
    return mail.parsed(given, most)


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs a handler on each batch; without an interval, over what is there, and ends. A batch may come twice
    after a failure, so handlers overwrite by batch number."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stop(query: StreamingQuery) -> None:
    """Ends a stream after the batch it is in."""
    query.stop()
    query.awaitTermination()


def into_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that keeps each batch's rows in a folder of its own."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")


# --- the life of a newsletter -------------------------------------------------------------------

#: A newsletter's state as events leave it; ``stale`` tells that a claim was given back because nothing came after it in time.
LIFE = "id string, processing_status string, scoring_error string, scoring_attempts int, stale boolean"
_STATE = "seq long, action string, reason string, claims int"


class _Life(StatefulProcessor):
    """The event with the largest number tells the status, every claim is an attempt; events may come in any order. A claim that stays
    the last event for longer than ``within`` milliseconds after its time is given back."""

    def __init__(self, within: int | None):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.life = handle, handle.getValueState("life", _STATE)

    def _told(self, key: str, now: tuple, stale: bool = False) -> pd.DataFrame:
        _, action, reason, claims = now
        status = "pending_scoring" if stale else state.STATUS_OF[action]
        return pd.DataFrame({"id": [key], "processing_status": [status], "scoring_error": [reason if action == "fail" else None], "scoring_attempts": pd.array([claims], "Int32"), "stale": [stale]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, action, reason, claims = self.life.get() if self.life.exists() else (None, None, None, 0)
        at = None
        for batch in rows:
            claims += int((batch["action"] == "claim").sum())
            last = batch.loc[batch["seq"].idxmax()]
            if seq is None or int(last["seq"]) > seq:
                seq, action, at = int(last["seq"]), last["action"], last["at"]
                reason = None if pd.isna(last["reason"]) else last["reason"]
        now = (seq, action, reason, claims)
        self.life.update(now)
        if self.within is not None and at is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if action == "claim":
                self.handle.registerTimer(max(int(pd.Timestamp(at).timestamp() * 1000) + self.within, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._told(key[0], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.life.get()
        if now[1] == "claim":
            yield self._told(key[0], now, True)

    def close(self) -> None:
        pass


def lives(events: DataFrame, stale: int | None = None, late: str = "1 hour") -> DataFrame:
    """What each newsletter is after its events (id, seq, action, reason, at) of a batch, as an update stream (LIFE); state.transitions is the same
    fold over a table. Without ``stale`` events may come at any time. With it (seconds) a claim without a later event is given back
    once the stream's times are that far on; then events may be late by ``late``. The state is one row per newsletter, in RocksDB."""
    given = events.select("id", F.col("seq").cast("long").alias("seq"), "action", "reason", F.col("at").cast("timestamp").alias("at"))
    if stale is None:
        return given.groupBy("id").transformWithStateInPandas(_Life(None), LIFE, "Update", "None")
    return given.withWatermark("at", late).groupBy("id").transformWithStateInPandas(_Life(stale * 1000), LIFE, "Update", "EventTime")


#: What sessions need for lives.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


# --- tables -------------------------------------------------------------------------------------

_COMMIT = "runs string, name string, schema string, bucket int, held int"


@dataclass(frozen=True)
class Commit:
    """What a version is: the batch and step that each run came to, each table's columns, and the version that holds each bucket."""

    version: int
    runs: dict[str, tuple[int, str]]
    schemas: dict[str, str]
    holds: dict[str, dict[int, int]]


class Tables:
    """Newsletters and stories below a folder, by buckets of the newsletter's id. A version writes the buckets that it changes to folders of its
    own, and counts once its commit, a small table, is whole: readers see the last whole one. Buckets that neither it nor the
    few commits before it hold are removed. Writers of one driver take turns by ``lock``; there must be no other driver."""

    KEYS = {"newsletters": "id", "stories": "newsletter_id"}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, kept: int = 3):
        self.spark, self.path, self.buckets, self.kept = spark, path.rstrip("/"), buckets, kept
        self.lock = threading.RLock()

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _numbers(self, folder: str, sign: str) -> list[int]:
        """The numbers of the folders below one that are named so."""
        fs, where = self._at(folder)
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.removeprefix(sign)) for n in names if n.startswith(sign))

    def _remove(self, name: str) -> None:
        fs, where = self._at(name)
        fs.delete(where, True)

    def _whole(self, version: int) -> bool:
        fs, where = self._at(f"commits/v{version}/_SUCCESS")
        return fs.exists(where)

    def commit(self, version: int) -> Commit:
        rows = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits/v{version}").collect()  # a row per table and bucket
        holds = {name: {r["bucket"]: r["held"] for r in rows if r["name"] == name and r["bucket"] is not None} for name in self.KEYS}
        return Commit(version, {k: tuple(v) for k, v in json.loads(rows[0]["runs"]).items()}, {r["name"]: r["schema"] for r in rows}, holds)

    def last(self) -> Commit | None:
        found = next((v for v in reversed(self._numbers("commits", "v")) if self._whole(v)), None)
        return None if found is None else self.commit(found)

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(self.KEYS[name]), F.lit(self.buckets)).cast("int")

    def read(self, name: str, at: Commit | None = None, only: set[int] | None = None) -> DataFrame:
        """A table, or some buckets of it, at the last or a given commit."""
        at = at or self.last()
        held = [f"{self.path}/{name}/v{v}/bucket={b}" for b, v in sorted(at.holds[name].items()) if only is None or b in only]
        reader = self.spark.read.schema(at.schemas[name])
        return reader.parquet(*held) if held else self.spark.createDataFrame([], at.schemas[name])

    def write(self, changed: dict[str, DataFrame], only: set[int] | None, run: str, batch: int, step: str) -> Commit:
        """The next version: these tables' rows stand for the buckets named, or for all."""
        at = self.last()
        version = at.version + 1 if at else 0
        holds = {name: dict(at.holds[name]) if at else {} for name in self.KEYS}
        schemas = dict(at.schemas) if at else {}
        for name, df in changed.items():
            schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            parts = self.buckets if only is None else len(only)
            df.withColumn("bucket", self.bucket(name)).repartition(parts, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/v{version}")
            left = {b: v for b, v in holds[name].items() if only is not None and b not in only}
            holds[name] = left | dict.fromkeys(self._numbers(f"{name}/v{version}", "bucket="), version)
        runs = (at.runs if at else {}) | {run: (batch, step)}
        rows = [(json.dumps(runs), name, schemas[name], b, v) for name, held in holds.items() if name in schemas for b, v in (held or {None: None}).items()]
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/v{version}")
        done = Commit(version, runs, schemas, holds)
        self._clean(done)
        return done

    def _clean(self, now: Commit) -> None:
        oldest = now.version - self.kept + 1
        commits = [now, *(self.commit(v) for v in self._numbers("commits", "v") if oldest <= v < now.version and self._whole(v))]
        needed = {(name, b, v) for c in commits for name, held in c.holds.items() for b, v in held.items()}
        for v in self._numbers("commits", "v"):
            if v < oldest:
                self._remove(f"commits/v{v}")
        for name in self.KEYS:
            for v in self._numbers(name, "v"):
                buckets = self._numbers(f"{name}/v{v}", "bucket=")
                gone = [b for b in buckets if v < now.version and (name, b, v) not in needed]
                for b in gone if len(gone) < len(buckets) else ():
                    self._remove(f"{name}/v{v}/bucket={b}")
                if len(gone) == len(buckets) and v < now.version:
                    self._remove(f"{name}/v{v}")


# --- the worker ---------------------------------------------------------------------------------


def create(tables: Tables, newsletters: DataFrame, stories: DataFrame) -> Commit:
    """The first version."""
    return tables.write({"newsletters": newsletters, "stories": stories}, None, "", 0, "create")


def _buckets(tables: Tables, rows: DataFrame) -> set[int]:
    return {r[0] for r in rows.select(tables.bucket("newsletters")).distinct().collect()}  # buckets at most


def add(tables: Tables, rows: DataFrame, run: str, batch: int) -> None:
    """Newsletters added; only the buckets that they fall in are written."""
    with tables.lock:
        if only := _buckets(tables, rows):
            tables.write({"newsletters": tables.read("newsletters", only=only).unionByName(rows, allowMissingColumns=True)}, only, run, batch, "done")


def recover(tables: Tables, run: str, batch: int) -> None:
    """Newsletters that were being scored when the last worker ended go back to the queue."""
    with tables.lock:
        if only := _buckets(tables, tables.read("newsletters").filter("processing_status = 'scoring'")):
            tables.write({"newsletters": state.requeue_stale(tables.read("newsletters", only=only))}, only, run, batch, "recover")


def claim(tables: Tables, limit: int, run: str, batch: int) -> None:
    """The oldest pending newsletters are taken, if there are any."""
    with tables.lock:
        taken = state.pending(tables.read("newsletters"), limit).select("id", tables.bucket("newsletters").alias("bucket")).collect()  # limit rows at most
        if taken:
            only, hit = {r["bucket"] for r in taken}, F.col("id").isin([r["id"] for r in taken])
            rows = tables.read("newsletters", only=only).withColumns({"processing_status": F.when(hit, "scoring").otherwise(F.col("processing_status")), "scoring_attempts": F.col("scoring_attempts") + hit.cast("int")})
            tables.write({"newsletters": rows}, only, run, batch, "claim")


def finish(tables: Tables, scored: DataFrame, only: set[int], model: str, now: Column, run: str, batch: int) -> None:
    """Scored newsletters get their status, and their stories are replaced; both in one version."""
    with tables.lock:
        newsletters = tables.read("newsletters", only=only)
        told = newsletters.join(scored.select("id", F.col("status").alias("_status"), F.col("error").alias("_error")), "id", "left")
        error = F.when(F.col("_status") == "failed", F.col("_error")).when(F.col("_status").isNull(), F.col("scoring_error"))
        after = told.withColumns({"processing_status": F.coalesce("_status", "processing_status"), "scoring_error": error}).select(newsletters.columns)
        stories = scoring.persist(tables.read("stories", only=only), scored, model, now)
        tables.write({"newsletters": after, "stories": stories}, only, run, batch, "done")


def _time(now: str | None) -> Column:
    return F.lit(now or datetime.now(UTC).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def tick(tables: Tables, scorer: scoring.Scorer, now: str | None = None, limit: int = 5, topics: tuple[str, ...] = (), most: int = 3, run: str = "worker", report: Callable[[int, dict], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A handler: a batch claims the oldest pending newsletters, scores them, routes each by its outcome, and replaces its stories if
    it is scored. What it writes depends on the buckets of the claimed newsletters only.

    The claim is one version, the result another; both tell run and batch, ``run`` being one for one checkpoint and one worker. So a batch that comes again
    after a failure goes on with its own claim, or is known to be done, and what another run left as claimed goes back to the queue at the start.
    ``now`` is the time written, the clock's if it is None. ``report`` gets the numbers of rows that the batch's own write counted.
    """
    first = True

    def handle(_: DataFrame, n: int) -> None:
        nonlocal first
        batch, step = tables.last().runs.get(run, (-1, "done"))
        if batch > n or (batch, step) == (n, "done"):
            return
        if (batch, step) != (n, "claim"):
            if first:
                recover(tables, run, n)
            claim(tables, limit, run, n)
        first = False
        claimed = tables.read("newsletters").filter("processing_status = 'scoring'")
        if not (only := _buckets(tables, claimed)):
            return
        seen = Observation()
        count = lambda status: F.count_if(F.col("status") == status)
        scored = scoring.score(claimed, scorer, topics, most)
        counted = scored.observe(seen, F.count(F.lit(1)).alias("claimed"), count("scored").alias("scored"), count("failed").alias("failed"), count("pending_scoring").alias("requeued"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("items"))
        counted.write.mode("overwrite").parquet(f"{tables.path}/scored")  # a table: the model is asked once
        finish(tables, tables.spark.read.schema(scored.schema).parquet(f"{tables.path}/scored"), only, scorer.name, _time(now), run, n)
        if report:
            report(n, seen.get)

    return handle


def taking_in(tables: Tables, now: str | None = None, run: str = "intake", report: Callable[[int, dict], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A handler for batches of messages (mail.read's columns): each is made a newsletter and stored unless it is known, among the stored
    ones or in its batch. Messages of a batch stand by their path; batches are limited by their stream."""

    def handle(batch: DataFrame, n: int) -> None:
        if tables.last().runs.get(run, (-1,))[0] >= n:
            return
        place = batch.select("path").withColumn("seq", F.lit(n).cast("long") * (1 << 32) + F.row_number().over(Window.orderBy("path")))
        received = F.to_utc_timestamp(F.col("received_at").cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
        rows = intakes.normalised(batch.join(place, "path").withColumn("received_at", received), _time(now))
        seen = Observation()
        told = intakes.ingest(rows, tables.read("newsletters").select("id", "message_id", "hash", "ingested_at"))
        told = shared.stored(told.observe(seen, F.count(F.lit(1)).alias("deliveries"), F.count_if("duplicate").alias("duplicates")))
        add(tables, intakes.fresh(rows, told, _time(now)), run, n)
        if report:
            report(n, seen.get)

    return handle


def poll(spark: SparkSession, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Runs a handler at once and then at an interval, without rows."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return start(ticks, handle, checkpoint, every)
