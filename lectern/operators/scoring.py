"""Scoring newsletters: prompt, model, answer, routing, and the stories that replace a newsletter's former ones."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import model_json, text
from lectern.functions.vector import bounded
from lectern.operators import state

VERSION = "1"


class Scorer(Protocol):
    """A model: an answer to each prompt. ``deterministic`` models answer a prompt always alike."""

    name: str
    deterministic: bool

    def __call__(self, prompt: str) -> str: ...


class TransportError(Exception):
    """A call that did not come through; ``status`` is 0 without any answer."""

    def __init__(self, status: int = 0):
        super().__init__(f"status {status}")
        self.status = status


class RuleScorer:
    """Stands in for a model: every line of the text is an item, long ones stories, its score by its length."""

    name, deterministic = "rules", True

    def __call__(self, prompt: str) -> str:
        lines = [" ".join(x.split()) for x in prompt.partition(text.BODY)[2].split("\n")]
        return json.dumps([{"title": x[:80], "snippet": x, "kind": "story" if len(x) >= 200 else "blurb", "summary": x, "relevance_score": len(x) % 101} for x in lines if x])


def with_retry(call: Callable[[str], str], prompt: str, retries: int = 2, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's answer; failures on the way and of the server are tried again, each time after a longer wait. All others
    and the last one are raised."""
    for attempt in range(retries + 1):
        if attempt:
            sleep(wait * attempt)
        try:
            return call(prompt)
        except TransportError as e:
            if 0 < e.status < 500 or attempt == retries:
                raise
    raise AssertionError


def answers(prompts: DataFrame, scorer: Scorer, retries: int = 2, wait: float = 2.0) -> DataFrame:
    """id, outcome, error (what went wrong) and the answer's items of each prompt (id, prompt); a null prompt makes no call and has outcome ok."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["id"], batch["prompt"], strict=True):
                if prompt is None:
                    rows.append((key, "ok", None, []))
                    continue
                try:
                    got = model_json.parse(with_retry(scorer, prompt, retries, wait))
                    rows.append((key, got["outcome"], got["outcome"] if got["outcome"] != "ok" else None, got["items"]))
                except TransportError as e:
                    rows.append((key, "transport", str(e), []))
                except Exception as e:  # a fault of the model's: the newsletter fails with it, not the batch
                    rows.append((key, "error", f"{type(e).__name__}: {e}", []))
            yield pd.DataFrame(rows, columns=["id", "outcome", "error", "items"])

    bounded(prompts.sparkSession)
    return prompts.select("id", "prompt").mapInPandas(run, f"id string, outcome string, error string, items array<{model_json.ITEM}>")


def prompted(newsletters: DataFrame, topics: tuple[str, ...] = ()) -> DataFrame:
    """id and prompt of newsletters (id, subject, body_text); null where subject and body are blank."""
    blank = (F.coalesce(text.stripped(F.col("subject")), F.lit("")) == "") & (F.coalesce(text.stripped(F.col("body_text")), F.lit("")) == "")
    return newsletters.select("id", F.when(~blank, text.prompt(F.col("subject"), F.col("body_text"), topics=topics)).alias("prompt"))


def score(newsletters: DataFrame, scorer: Scorer, topics: tuple[str, ...] = (), most: int = 3) -> DataFrame:
    """id, outcome, error, items and next status of claimed newsletters (with scoring_attempts)."""
    given = answers(prompted(newsletters, topics), scorer)
    kept = [c for c in ("source_id",) if c in newsletters.columns]
    told = newsletters.select("id", "scoring_attempts", *kept).join(given, "id")
    status = state.route(F.col("outcome"), F.lit(scorer.deterministic), F.col("scoring_attempts"), F.size("items"), most)
    return told.select("id", "outcome", "error", "items", status.alias("status"), *kept)


def stories_of(scored: DataFrame, model: str, now: Column) -> DataFrame:
    """The stories of scored newsletters: items in order from 0; only those of kind story have what the model found."""
    kept = [c for c in ("source_id",) if c in scored.columns]
    rows = scored.filter("status = 'scored'").select(F.col("id").alias("newsletter_id"), *kept, F.posexplode("items").alias("position", "i"))
    is_story = F.col("i.kind") == "story"
    blank = lambda c: F.nullif(F.col(f"i.{c}"), F.lit("")).alias(c)
    only = lambda x, name: F.when(is_story, x).alias(name)
    key = F.sha2(F.concat_ws("|", "newsletter_id", F.col("position").cast("string")), 256).alias("id")
    found = [only(F.col(f"i.{c}"), c) for c in ("summary", "relevance_score", "primary_topic", "labels")]
    return rows.select(key, "newsletter_id", *kept, "position", F.col("i.kind").alias("kind"), blank("section"), blank("title"), blank("url"), blank("snippet"), *found, only(F.lit(model), "model"), only(F.lit(VERSION), "prompt_version"), only(now, "scored_at"))


def persist(stored: DataFrame, scored: DataFrame, model: str, now: Column) -> DataFrame:
    """Stored stories in which those of the scored newsletters are replaced; bookmarks, ratings and openings come along by url.
    A newsletter without items was scored without asking a model: it keeps the stories that it has."""
    done = scored.filter("status = 'scored' and size(items) > 0").select(F.col("id").alias("newsletter_id"))
    prior = stored.join(done, "newsletter_id", "left_semi")
    fresh = state.carry_over(stories_of(scored, model, now), prior, within="newsletter_id")
    return stored.join(done, "newsletter_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
