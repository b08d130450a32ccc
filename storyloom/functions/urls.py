"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: shapes of article addresses.
ARTICLE_URL = r"(?i)(/article/|/articles/|/news/|/story/|/post/|/\d{5,}|/\d{4}/\d{2}/|ArticleDetails|NewsDetails|/2026/|/2025/)"


def url_key(url: Column) -> Column:
    """Address without its query."""
    return F.split_part(url, F.lit("?"), F.lit(1))


def host(url: Column) -> Column:
    """Host without www., null for a malformed address."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def is_article_url(url: Column) -> Column:
    return url.rlike(ARTICLE_URL)
