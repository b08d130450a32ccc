"""Aggregates of stories over their members: sources, languages, times, primary article, score, category, rank.

Members are rows (story_id, ord, article columns); each operator is one aggregation by story_id with map-side
combining. Ordered collections gather distinct names of one story only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.functions.text import normal_python, normalize_text
from storyloom.vocab.words import (
    CATEGORIES,
    CATEGORY_SECTIONS,
    KEYWORD_POINTS,
    KEYWORD_TITLES,
    OTHER_SECTION,
    OTHER_TIER,
    SECTION_WEIGHT,
    STRONG_POINTS,
    TIER_WEIGHT,
    WEAK_POINTS,
    Lexicon,
)


def unique_members(members: DataFrame) -> DataFrame:
    """The first member of each story and address (D-2)."""
    order = W.partitionBy("story_id", "url").orderBy("ord", "article_id")
    return members.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def first_seen(members: DataFrame, column: str) -> DataFrame:
    """(story_id, <column>s): distinct non-empty values in the order of their first member (A-1, A-5)."""
    firsts = members.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy("story_id", column).agg(F.min("ord").alias("o"))
    return firsts.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", column))), lambda s: s[column]).alias(f"{column}s"))


def primary_of(members: DataFrame) -> DataFrame:
    """(story_id, primary_id): the lowest tier, then the longest body or summary, then the title (A-6)."""
    text = F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("summary"), F.lit(""))
    key = F.struct(F.coalesce("tier", F.lit(2)).alias("t"), (-F.length(text)).alias("n"), F.coalesce("title", F.lit("")).alias("title"), F.col("article_id").alias("id"))
    return members.groupBy("story_id").agg(F.min(key).alias("k")).select("story_id", F.col("k.id").alias("primary_id"), F.col("k.title").alias("primary_title"), (-F.col("k.n")).alias("primary_length"))


def story_aggregates(members: DataFrame) -> DataFrame:
    """(story_id, n_articles, outlet_count, langs, latest, earliest, any_tier1) (A-2 to A-4)."""
    return members.groupBy("story_id").agg(
        F.count("*").alias("n_articles"),
        F.countDistinct("source_name").alias("outlet_count"),
        F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"),
        F.max("published").alias("latest"),
        F.min("published").alias("earliest"),
        F.max((F.coalesce("tier", F.lit(2)) == 1).cast("int")).alias("any_tier1"),
    )


def _lookup(column: Column, table: dict, default: float) -> Column:
    mapped = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(mapped, column), F.lit(default))


def recency_bonus(latest: Column, run: Column) -> Column:
    """2.0, 1.2 or 0.6 up to 4, 10 or 18 hours of age, else 0; nothing without a time (T-13)."""
    age = run.cast("double") - latest.cast("double")
    return F.when(latest.isNull(), 0.0).when(age <= 4 * 3600, 2.0).when(age <= 10 * 3600, 1.2).when(age <= 18 * 3600, 0.6).otherwise(0.0)


def story_scores(members: DataFrame, run_ts: dt.datetime | Column) -> DataFrame:
    """(story_id, score, outlet_count): tier and section weights, each source full once and 0.15 after, breadth, recency, detail (A-7)."""
    run = run_ts if isinstance(run_ts, Column) else F.lit(run_ts)
    weight = _lookup(F.col("tier"), TIER_WEIGHT, OTHER_TIER) * _lookup(F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("general")), SECTION_WEIGHT, OTHER_SECTION)
    # each source: its first article full, the others less; minima and sums, so that no story is gathered
    later = F.round(weight * 0.15, 6)
    first = F.struct("ord", "article_id", F.round(weight, 6).alias("full"), later.alias("later"))
    per_source = members.groupBy("story_id", "source_id").agg(F.min(first).alias("f"), F.sum(later).alias("all"))
    base = per_source.groupBy("story_id").agg(F.sum(F.col("all") - F.col("f.later") + F.col("f.full")).alias("base"))
    joined = base.join(story_aggregates(members), "story_id").join(primary_of(members), "story_id")
    score = F.col("base") + 2.6 * (F.col("outlet_count") - 1) + recency_bonus(F.col("latest"), run) + 0.8 * F.least(F.col("primary_length") / 2500, F.lit(1.0)) + 1.5 * F.col("any_tier1")
    return joined.select("story_id", F.round(score, 6).alias("score"), "outlet_count")


def ranked(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores with their rank, by score, outlets and story_id, within `by` (an edition) (T-3)."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.desc("outlet_count"), "story_id")
    return scores.withColumn("rank", F.row_number().over(order))


def first_titles(members: DataFrame, n: int) -> DataFrame:
    """(story_id, text): the first n titles of each story, joined; the window keeps n rows of a story before the shuffle."""
    rank = F.row_number().over(W.partitionBy("story_id").orderBy("ord", "article_id"))
    rows = members.select("story_id", "ord", "article_id", "title").withColumn("__r", rank).filter(F.col("__r") <= n)
    return rows.groupBy("story_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.coalesce("title", F.lit("")).alias("t")))), lambda s: s["t"]), " ").alias("text"))


def keyword_found(text: Column, keyword: str) -> Column:
    """Whether a normal text holds a keyword: Latin ones as whole words, plural included, others anywhere; null for an empty one."""
    plain = normal_python(keyword)
    if not plain:
        return F.lit(False)
    # the plain search comes first, as it is cheap and mostly fails
    return text.contains(plain) & text.rlike(rf"(?<![a-z0-9]){plain}(?:e?s)?(?![a-z0-9])") if plain.isascii() else text.contains(plain)


def categories(members: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(story_id, category): once 1.5 and 0.4 points for strongly and weakly naming sections, 0.8 for each keyword in the first six
    titles; ties go to the earlier category; Other where nothing scores (A-8). Sections are maxima and titles are limited before
    the shuffle, so that a story with most rows costs no more."""
    lexicon = lexicon or Lexicon()
    section = F.col("section")
    some = lambda names: F.max(F.when(section.isin(*names), 1.0).otherwise(0.0)) if names else F.max(F.lit(0.0))
    points = [F.round(STRONG_POINTS * some(strong) + WEAK_POINTS * some(weak), 6).alias(f"s:{name}") for name, (strong, weak) in CATEGORY_SECTIONS.items()]
    per = members.groupBy("story_id").agg(*points)
    texts = first_titles(members, KEYWORD_TITLES).select(F.col("story_id").alias("__s"), normalize_text(F.col("text")).alias("text"))
    rows = per.join(texts, F.col("story_id").eqNullSafe(F.col("__s")))
    scored = []
    for i, name in enumerate(CATEGORY_SECTIONS):
        hits = sum((keyword_found(F.col("text"), word).cast("int") for word in lexicon.keywords.get(name, [])), F.lit(0))
        scored.append(F.struct((-F.round(F.col(f"s:{name}") + KEYWORD_POINTS * hits, 6)).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("c")))
    best = F.array_min(F.array(*scored))
    return rows.select("story_id", best.alias("b")).select("story_id", F.when(F.col("b.s") < 0, F.col("b.c")).otherwise("Other").alias("category"))


def category_counts(named: DataFrame) -> DataFrame:
    """(category, pos, n) of the categories in use, in their fixed order (A-9)."""
    order = F.create_map(*[x for i, c in enumerate(CATEGORIES) for x in (F.lit(c), F.lit(i))])
    return named.groupBy("category").agg(F.count("*").alias("n")).withColumn("pos", F.try_element_at(order, F.col("category")))


def busiest_outlets(members: DataFrame, limit: int = 8) -> DataFrame:
    """(source_name, n, pct): sources by their number of articles, pct of the largest (A-10)."""
    counts = members.groupBy("source_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_name").limit(limit)
    top = F.max("n").over(W.partitionBy(F.lit(1)))
    return counts.withColumn("pct", F.bround(100 * F.col("n") / top).cast("int"))


def coverage_index(members: DataFrame) -> DataFrame:
    """(source_name, n, story_id, article_id): the complete index of articles, largest outlets first (A-16)."""
    counts = members.groupBy("source_name").agg(F.count("*").alias("n"))
    return members.select("source_name", "story_id", "article_id").join(counts, "source_name")


def story_texts(members: DataFrame, n: int = 6) -> DataFrame:
    """(story_id, text): the first titles of each story (A-18)."""
    return first_titles(members, n)


def top_stories(ranking: DataFrame, n: int = 28) -> DataFrame:
    """The first stories, which are analysed (T-4)."""
    return ranking.filter(F.col("rank") <= n)


def tail_stories(ranking: DataFrame, after: int = 28, n: int = 60) -> DataFrame:
    """The listed rest (T-5)."""
    return ranking.filter(F.col("rank").between(after + 1, after + n))


def micro_batches(ranking: DataFrame, size: int = 5) -> DataFrame:
    """Story numbers S1, S2, ... and contiguous batches of them (T-6, T-7)."""
    return ranking.withColumn("sid", F.concat(F.lit("S"), F.col("rank"))).withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("int"))
