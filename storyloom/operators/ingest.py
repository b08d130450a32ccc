"""Ingest operators: source filter, look-back window, deduplication by address, cap per source, source health."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.functions.urls import url_key


def enabled_only(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of enabled sources (P-3); the small side is left to Spark's size check."""
    return rows.join(sources.filter("is_enabled").select("source_id"), "source_id", "left_semi")


def of_sources(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of the named sources; no names: all rows (P-2)."""
    return rows.filter(F.col("source_id").isin(*ids)) if ids else rows


def within_window(rows: DataFrame, run_ts: dt.datetime | Column, hours: int = 26, column: str = "published") -> DataFrame:
    """Rows without a time, or not older than the window; no upper bound (P-1)."""
    run = run_ts if isinstance(run_ts, Column) else F.lit(run_ts)
    return rows.filter(F.col(column).isNull() | (F.col(column) >= run - F.expr(f"INTERVAL {int(hours)} HOURS")))


def first_by_url(rows: DataFrame) -> DataFrame:
    """The first row of each source and address without query, by feed, item and id (D-1)."""
    order = W.partitionBy("source_id", "__key").orderBy("feed_ord", "item_ord", "article_id")
    ranked = rows.withColumn("__key", url_key(F.col("url"))).withColumn("__n", F.row_number().over(order))
    return ranked.filter("__n = 1").drop("__n", "__key")


def newest_per_source(rows: DataFrame, limit: int = 120, column: str = "published") -> DataFrame:
    """The newest rows of each source; rows without a time come first (T-1). Plans a group limit before the shuffle."""
    order = W.partitionBy("source_id").orderBy(F.col(column).desc_nulls_first(), "article_id")
    return rows.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit).drop("__n")


def source_health(sources: DataFrame, feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """(source_id, tier, targets_ok, targets_total, targets, ok, articles) for each enabled source (A-11).

    A target is ok if at least one of the source's articles came from it.
    """
    seen = articles.groupBy("source_id", "feed_ord").agg(F.count("*").alias("n"))
    log = feeds.filter("is_enabled").join(seen, ["source_id", "feed_ord"], "left")
    per = log.groupBy("source_id").agg(F.count("*").alias("targets_total"), F.count("n").alias("targets_ok"), F.sum("n").alias("n"))
    out = sources.filter("is_enabled").select("source_id", "tier").join(per, "source_id", "left")
    total, ok = F.coalesce("targets_total", F.lit(0)), F.coalesce("targets_ok", F.lit(0))
    return out.select("source_id", "tier", ok.alias("targets_ok"), total.alias("targets_total"), F.concat_ws("/", ok, total).alias("targets"), (ok > 0).alias("ok"), F.coalesce("n", F.lit(0)).alias("articles"))


def edition_stats(articles: DataFrame, stories: DataFrame, major: int = 3) -> DataFrame:
    """One row of run figures (A-12)."""
    a = articles.agg(F.count("*").alias("total_articles"), F.countDistinct("source_id").alias("outlets_reporting"))
    s = stories.agg(F.count("*").alias("total_stories"), F.count_if(F.col("outlet_count") >= major).alias("major_stories"))
    return a.crossJoin(s)  # one row by one row


def target_health(sources: DataFrame, targets: DataFrame, articles: DataFrame) -> DataFrame:
    """(source_id, targets_ok, targets_total, articles, flag) of a collecting run: a target is ok if its fetch did not fail (A-11).

    flag: OK with an article or a target that answered, OPT where an optional source has none, FAIL otherwise.
    """
    per = targets.groupBy("source_id").agg(F.count("*").alias("targets_total"), F.count_if(F.col("error").isNull()).alias("targets_ok"))
    counts = articles.groupBy("source_id").agg(F.count("*").alias("articles"))
    rows = sources.filter("is_enabled").select("source_id", "is_optional").join(per, "source_id", "left").join(counts, "source_id", "left").fillna(0, ["targets_total", "targets_ok", "articles"])
    flag = F.when(F.col("targets_ok") > 0, "OK").when(F.col("is_optional"), "OPT").otherwise("FAIL")
    return rows.select("source_id", "targets_ok", "targets_total", "articles", flag.alias("flag"))
