"""The adapter views over the bundled tables, the same on the Spark and the SQL side."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.sources.tables import read_table

RUN = dt.datetime(2026, 6, 30, 8, tzinfo=dt.timezone.utc)
RUN_SECONDS = int(RUN.timestamp())


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles as the engine takes them: missing strings are empty, published is the fetch time, edition its day in Kuwait."""
    a = read_table(spark, d, "articles")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    lang = F.split_part(F.translate(F.lower(F.trim(F.coalesce("lang", F.lit("")))), "_", "-"), F.lit("-"), F.lit(1))
    day = F.date_from_unix_date(F.floor((F.unix_seconds("fetched_at") + 10800) / 86400).cast("int"))
    return a.select(
        "article_id", "source_id", F.col("source_id").alias("source_name"), lang.alias("lang"), empty("title"), "url", empty("section"),
        empty("summary"), empty("body"), F.col("fetched_at").alias("published"), "tier", "feed_ord", "item_ord", day.alias("edition"),
    )


ARTICLES = """
art as (select article_id, source_id, source_id as source_name, split_part(replace(lower(trim(coalesce(lang, ''))), '_', '-'), '-', 1) as lang,
  coalesce(title, '') as title, url, coalesce(section, '') as section, coalesce(summary, '') as summary, coalesce(body, '') as body,
  fetched_at as published, tier, feed_ord, item_ord, cast(date '1970-01-01' + cast(floor((floor(epoch(fetched_at)) + 10800) / 86400) as integer) as date) as edition
  from articles)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """Articles of stories, each listed once at its first place."""
    m = read_table(spark, d, "story_members").groupBy("story_id", "article_id").agg(F.min("ord").alias("ord"))
    return m.join(articles(spark, d), "article_id")


MEMBERS = ARTICLES + """,
mem as (select m.story_id, m.ord, art.* from (select story_id, article_id, min(ord) as ord from story_members group by all) m join art using (article_id))"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, title): the first line of each text."""
    return read_table(spark, d, "documents").filter("text is not null").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "lang", "source")


DOCUMENTS = "doc as (select doc_id, split_part(text, chr(10), 1) as title, lang, source from documents where text is not null)"
