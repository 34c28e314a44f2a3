"""Mixing sources to target weights.

Sizes are summed per source, repetition rates follow from the targets, and every document is taken
floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
#: Sources up to this number are handled on the driver and broadcast; beyond it all stays distributed.
FEW_SOURCES = 20_000
#: Hash seeds to choose among; each source takes the one that brings its total nearest its target.
SEEDS = 16
_UNIT = float(1 << 53)


def _words():
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _unit(seed: int):
    """A number from [0, 1) by which a seed decides on a row."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", F.lit(seed)), 11) / F.lit(_UNIT)


def allot(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of the total by weight; what a share has above ``most`` times its size goes to the others
    by weight, until none is above."""
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if per * weights[i] >= most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = per * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if per * weights[i] < most * sizes[i]]
        left = max(left, 0.0)
    return target


def _targets(sized: DataFrame, share: float, most: float) -> DataFrame:
    """source, source_size, target; the weights go round by code point order, null last."""
    spark = sized.sparkSession
    sources = common.stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    if sources.count() <= FEW_SOURCES:
        rows = sorted(sources.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        sizes = [r["source_size"] for r in rows]
        target = allot(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))], share * sum(sizes), most)
        return spark.createDataFrame([(r["source"], r["source_size"], t) for r, t in zip(rows, target, strict=True)], "source string, source_size long, target double")
    # Many sources: ranks from range partitions and their counts, and the same rounds as aggregates.
    apart = common.stored(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id())
        .withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())))
    )
    base, before = 0, []
    for r in apart.groupBy("part").count().orderBy("part").collect():
        before.append((r["part"], base))
        base += r["count"]
    ranked = apart.join(F.broadcast(spark.createDataFrame(before, "part int, base long")), "part").withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("base") + F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    left, per, weight = share * sources.agg(F.sum("source_size")).first()[0], 0.0, ranked.agg(F.sum("weight")).first()[0]
    total, full = left, -1
    while True:
        per = left / weight if weight else per
        over = ranked.filter(F.lit(per) * F.col("weight") >= F.lit(most) * F.col("source_size"))
        r = over.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("size")).first()
        weight = ranked.filter(F.lit(per) * F.col("weight") < F.lit(most) * F.col("source_size")).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
        left = max(0.0, total - most * r["size"])
        if r["n"] == full:
            break
        full = r["n"]
    return ranked.select("source", "source_size", F.least(F.lit(most) * F.col("source_size"), F.lit(per) * F.col("weight")).alias("target"))


def _join(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """By source, null with null: a broadcast for few sources, else a shuffle whose hot keys Spark splits."""
    side = sources.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if n <= FEW_SOURCES else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def plan(sized: DataFrame, share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, int]:
    """source, source_size, target, whole copies, fraction and seed for each source, and their number."""
    targets = common.stored(_targets(sized, share, most))
    n = targets.count()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.withColumn("whole", F.floor(rate)).withColumn("fraction", rate - F.floor(rate))
    sums = [F.sum(F.when(_unit(s) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(SEEDS)]
    drawn = _join(sized, rates, n).groupBy("source").agg(*sums).withColumnRenamed("source", "_s")
    off = [F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{s}") - F.col("target")) for s in range(SEEDS)]
    best = F.array_position(F.array(*off), F.array_min(F.array(*off))).cast("int") - 1
    return common.stored(rates.join(drawn, F.col("source").eqNullSafe(F.col("_s"))).select(*rates.columns, best.alias("seed"))), n


def copies_of(rows: DataFrame, planned: tuple[DataFrame, int]) -> DataFrame:
    """The rows with their source's numbers and ``copies``."""
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", F.col("seed")), 11) / F.lit(_UNIT)
    return _join(rows, *planned).withColumn("copies", F.col("whole") + F.when(unit < F.col("fraction"), 1).otherwise(0))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and the text's checksum, which seeds the draw together with the id."""
    return docs.select("doc_id", "source", _words().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: how often the mix takes it and what that makes.

    Sizes are numbers of words (null or blank text: 0). Null is a source of its own and comes last.
    A source of size 0 has target 0. Repeated rows draw alike. Reruns agree: all draws are hashes.
    """
    sized = common.stored(measured(docs))
    out = copies_of(sized, plan(sized, share, most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def emit(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with."""
    sized = common.stored(measured(docs))
    planned, n = plan(sized, share, most)
    names = docs.columns
    rows = docs.select(F.struct(*[docs[common.quoted(c)] for c in names]).alias("_row"), *[c for c in ("doc_id", "source")], F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    taken = copies_of(rows, (planned.select("source", "whole", "fraction", "seed"), n)).filter("copies > 0")
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
