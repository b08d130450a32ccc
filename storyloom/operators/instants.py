"""Problem 7: mixed timestamp formats and time zones, as an operator on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.timeparse import is_canonical, known_zone, with_utc_seconds


def with_instants(rows: DataFrame, sources: DataFrame, value: str = "published", key: str = "source_id", zone: str = "time_zone", out: str = "utc_s") -> DataFrame:
    """`rows` with `out` (BIGINT): the seconds since 1970-01-01 UTC that `value` denotes in the zone of its source.

    Every row of `rows` is kept once. Null, blank or meaningless values give null; a row whose source is null or
    unknown is read in UTC; a source listed twice counts with its smallest zone name; an existing column named
    `out` is replaced; other columns, whatever their names, pass through. Empty tables give empty results.
    The join carries the table of sources only, which Spark broadcasts while it is below its size threshold and
    shuffles beyond; the parse itself needs no shuffle.
    """
    zones = sources.groupBy(F.col(key).alias("__k")).agg(known_zone(F.min(zone)).alias("__z")).filter(F.col("__k").isNotNull())
    joined = rows.drop(out).join(zones, F.col(key) == F.col("__k"), "left")
    return with_utc_seconds(joined, value, "__z", out).drop("__k", "__z")


def instants_found(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, utc_s) of values that denote an instant and are not yet in the one unambiguous form."""
    rows = articles.select("article_id", "source_id", "published").filter(F.col("published").isNotNull() & ~is_canonical(F.col("published")))
    parsed = with_instants(rows.filter("article_id is not null"), sources).select("article_id", "utc_s")
    # collect_set leaves nulls out; a filter on utc_s would be pushed below the parse and repeat it many times over
    return parsed.groupBy("article_id").agg(F.collect_set("utc_s").alias("all")).select("article_id", F.explode("all").alias("utc_s"))


def normalised_published(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, published, published_utc): published_utc in the form YYYY-MM-DDTHH:MM:SSZ, null where no instant is named."""
    rows = with_instants(articles.select("article_id", "source_id", "published"), sources)
    day = F.date_from_unix_date(F.floor(F.col("utc_s") / 86400).cast("int")).cast("string")
    s = F.pmod(F.col("utc_s"), F.lit(86400))
    clock = F.format_string("%sT%02d:%02d:%02dZ", day, F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return rows.select("article_id", "published", F.when(F.col("utc_s").isNotNull(), clock).alias("published_utc"))
