"""The domain tables as views of the tables at hand: suppliers as sources, orders as newsletters, order lines as stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("newsletter").alias("kind"), F.lower("s_name").alias("identity"))


def newsletters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"),
        F.when(key % 5 != 0, F.col("o_orderdate")).alias("received_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL '1' DAY")).alias("ingested_at"),
        F.when(status == "P", "pending_scoring").when(status == "O", "scoring").otherwise("scored").alias("processing_status"),
        (key % 4).cast("int").alias("scoring_attempts"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    joined = line.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    flag, number, kind, tax = F.col("l_returnflag"), F.col("l_linenumber"), F.col("p_type"), F.col("l_tax")
    return joined.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("id"),
        F.col("l_orderkey").cast("string").alias("newsletter_id"),
        F.col("l_suppkey").cast("string").alias("source_id"),
        number.alias("position"),
        F.when(kind == "PROMO", "promo").when(flag == "R", "ad").when((flag == "A") & (number > 4), "blurb").otherwise("story").alias("kind"),
        F.col("p_name").alias("title"),
        F.concat("p_brand", F.lit(" "), F.lower("p_type")).alias("summary"),
        F.col("p_brand").alias("snippet"),
        F.when(F.col("p_size") % 11 == 0, None).when(F.col("p_size") % 13 == 0, "").otherwise(kind).alias("primary_topic"),
        F.when((kind != "PROMO") & ((flag == "N") | ((flag == "A") & (number <= 4))) & (number != 3), (F.col("l_quantity") * 2).cast("int")).alias("relevance_score"),
        F.col("l_shipdate").alias("scored_at"),
        (F.col("l_discount") >= 0.085).alias("bookmarked"),
        F.when(tax >= 0.065, 1).when(tax < 0.015, -1).alias("user_rating"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate") + F.expr("INTERVAL '2' DAY")).alias("opened_at"),
    )


#: The same views for the comparison engine.
SQL = """
v_sources AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, 'newsletter' AS kind, lower(s_name) AS identity FROM supplier),
v_newsletters AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS received_at,
  o_orderdate + INTERVAL '1' DAY AS ingested_at,
  CASE o_orderstatus WHEN 'P' THEN 'pending_scoring' WHEN 'O' THEN 'scoring' ELSE 'scored' END AS processing_status,
  CAST(o_orderkey % 4 AS INT) AS scoring_attempts FROM orders),
v_stories AS (SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS id,
  CAST(l_orderkey AS VARCHAR) AS newsletter_id, CAST(l_suppkey AS VARCHAR) AS source_id, l_linenumber AS position,
  CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN l_returnflag = 'R' THEN 'ad' WHEN l_returnflag = 'A' AND l_linenumber > 4 THEN 'blurb' ELSE 'story' END AS kind,
  p_name AS title, concat(p_brand, ' ', lower(p_type)) AS summary, p_brand AS snippet,
  CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 13 = 0 THEN '' ELSE p_type END AS primary_topic,
  CASE WHEN p_type <> 'PROMO' AND (l_returnflag = 'N' OR (l_returnflag = 'A' AND l_linenumber <= 4)) AND l_linenumber <> 3 THEN CAST(l_quantity * 2 AS INT) END AS relevance_score,
  l_shipdate AS scored_at, l_discount >= 0.085 AS bookmarked, CASE WHEN l_tax >= 0.065 THEN 1 WHEN l_tax < 0.015 THEN -1 END AS user_rating,
  CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL '2' DAY END AS opened_at
  FROM lineitem JOIN part ON p_partkey = l_partkey),
v_items AS (SELECT st.*, so.name AS source_name, coalesce(n.received_at, n.ingested_at) AS received
  FROM v_stories st JOIN v_sources so ON so.id = st.source_id JOIN v_newsletters n ON n.id = st.newsletter_id)
"""
