"""An edition from end to end: collect, window, deduplicate, thread, score, analyse, remember, write.

Every step is an operator of the engine on DataFrames; only what is written as one file for one day reaches the driver.
"""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.functions.markup import html_article
from storyloom.operators import clustering, digest, entities, ingest, memory, similarity, stories
from storyloom.operators.instants import with_instants
from storyloom.session import checkpoint
from storyloom.sources import feeds as feed_source
from storyloom.sources import sinks
from storyloom.sources.config import load_config
from storyloom.vocab.words import Lexicon


@dataclass(frozen=True)
class RunOptions:
    """What a run may be told. Times are parameters: nothing reads the clock."""

    run: dt.datetime
    config: str = ""
    output: str = "editions"
    state: str = "state"
    date: str | None = None  # label of the edition; the run's day otherwise
    hours: int = 26
    max_analyse: int = 28
    tail: int = 60
    major_outlets: int = 3
    per_source: int = 120
    sources: tuple[str, ...] = ()
    language: str = "bilingual"
    threading: str = "exact"  # or graph, for days that no task can hold
    compatibility: bool = True  # NFKC before threading
    analyse: object = None  # a function from the analysed stories (DataFrame) to their analyses; None: extractive
    lexicon: Lexicon = field(default_factory=Lexicon)
    fetch_bodies: bool = True
    use_cache: bool = True
    html: bool = True
    dry_run: bool = False
    skip_if_done: bool = False
    marker: bool = True

    @property
    def label(self) -> str:
        return self.date or self.run.strftime("%Y-%m-%d")


def in_window(articles: DataFrame, sources: DataFrame, options: RunOptions) -> DataFrame:
    """Articles of enabled sources in the look-back window, each address once, the newest of each source (P-1 to P-3, D-1, T-1)."""
    rows = ingest.of_sources(ingest.enabled_only(articles, sources), list(options.sources))
    rows = ingest.newest_per_source(ingest.first_by_url(rows), options.per_source)
    return ingest.within_window(rows, options.run, options.hours)


def build_stories(articles: DataFrame, options: RunOptions) -> DataFrame:
    """(story_id, ord, article columns): members of the stories of one edition, newest first, each address once (J-1 to J-3, D-2)."""
    rows = articles.withColumn("edition", F.lit(options.label).cast("date"))
    tokens = similarity.tokenised(rows, options.lexicon, options.compatibility)
    if options.threading == "graph":
        classes, membership = similarity.headline_classes(tokens)
        found = clustering.graph_stories(classes, membership, similarity.same_story_edges(classes))
    else:
        places = clustering.exact_stories(tokens, rows.select("article_id", "published", F.col("article_id").alias("pos"), "url"))
        found = places.withColumn("story_id", F.min("article_id").over(W.partitionBy("cluster"))).select("article_id", "story_id")
    order = W.partitionBy("story_id").orderBy(F.col("published").desc_nulls_first(), "article_id")
    return stories.unique_members(rows.drop("edition").join(found, "article_id").withColumn("ord", F.row_number().over(order)))


def rank_stories(members: DataFrame, options: RunOptions) -> DataFrame:
    """(story_id, rank, score, outlet_count, category) (A-7, A-8, T-3)."""
    ranking = stories.ranked(stories.story_scores(members, options.run))
    return ranking.join(stories.categories(members, options.lexicon), "story_id").select("story_id", "rank", "score", "outlet_count", "category")


def run_stats(articles: DataFrame, ranking: DataFrame, options: RunOptions) -> DataFrame:
    """One row of figures: articles, outlets, stories, major and analysed ones, the window (A-12)."""
    stats = ingest.edition_stats(articles, ranking, options.major_outlets)
    start = int(options.run.timestamp()) - options.hours * 3600
    return stats.withColumn("analysed_stories", F.least("total_stories", F.lit(options.max_analyse))).withColumn("window_start_s", F.lit(start).cast("bigint")).withColumn("window_end_s", F.lit(int(options.run.timestamp())).cast("bigint"))


def with_bodies(members: DataFrame, ranking: DataFrame, options: RunOptions, get) -> DataFrame:
    """Members; the primary articles of the analysed stories that have no body get that of their page (M-9)."""
    top = stories.primary_of(members).join(stories.top_stories(ranking, options.max_analyse).select("story_id"), "story_id", "left_semi").select(F.col("primary_id").alias("article_id"))
    bare = members.filter(F.trim(F.coalesce("body", F.lit(""))) == "").join(top, "article_id", "left_semi").select("article_id", "url")
    pages = checkpoint(feed_source.fetched(bare, get).select("article_id", html_article("payload").alias("page_body")))
    return members.join(pages, "article_id", "left").withColumn("body", F.coalesce(F.nullif(F.col("page_body"), F.lit("")), "body")).drop("page_body")


def edition(articles: DataFrame, sources: DataFrame, options: RunOptions, get=feed_source.read_file) -> dict[str, DataFrame]:
    """The tables of an edition: articles, members, ranking, analyses, synthesis, stats. articles: with `published` as an instant."""
    kept = checkpoint(in_window(articles, sources, options))
    members = checkpoint(build_stories(kept, options))
    ranking = checkpoint(rank_stories(members, options))
    if options.fetch_bodies:
        members = checkpoint(with_bodies(members, ranking, options, get))
    top = stories.top_stories(ranking, options.max_analyse)
    chosen = members.join(top.select("story_id"), "story_id", "left_semi")
    analyses = options.analyse(chosen) if options.analyse else digest.extractive_analysis(chosen)
    titles = stories.primary_of(members).select("story_id", F.col("primary_title").alias("title"))
    named = ranking.join(titles, "story_id").join(analyses.select("story_id", "entities"), "story_id", "left")
    none = F.array().cast("array<string>")
    synthesis = digest.extractive_synthesis(named.select(F.lit(options.label).alias("edition"), "rank", "title", "outlet_count", F.coalesce("entities", none).alias("entities")))
    return {"articles": kept, "members": members, "ranking": ranking, "analyses": analyses, "synthesis": synthesis, "stats": run_stats(kept, ranking, options)}


def documents(tables: dict[str, DataFrame], options: RunOptions) -> tuple[str, dict, str]:
    """(Markdown, JSON document, HTML page) of one edition, from its analysed stories and the listed rest (K-2, K-9)."""
    shown = tables["ranking"].filter(F.col("rank") <= options.max_analyse + options.tail)
    cards = digest.edition_cards(shown, tables["members"], tables["analyses"]).orderBy("rank").collect()
    stats = tables["stats"].first().asDict()
    counts = [(r["category"], r["n"]) for r in stories.category_counts(tables["ranking"]).orderBy("pos").collect()]
    outlets = [(r["source_name"], r["n"]) for r in stories.busiest_outlets(tables["members"]).collect()]
    note = tables["synthesis"].first()
    value = {"date": options.label, "stats": stats, "categories": dict(counts), "outlets": dict(outlets), "synthesis": note.asDict() if note else {}, "stories": [c.asDict(recursive=True) for c in cards]}
    return digest.markdown_page(value), value, digest.html_page(value)


def run_edition(spark: SparkSession, options: RunOptions, get=feed_source.read_file) -> dict:
    """Collect the sources of a registry and write an edition; gives what was written, or why nothing was (`run`)."""
    marker = os.path.join(options.state, "run.json")
    if options.skip_if_done and sinks.is_done(marker, options.label):
        return {"skipped": "done"}
    sources, targets, settings = load_config(spark, options.config)
    zoned = sources.withColumn("time_zone", F.lit(settings["timezone"]))
    rows, log = feed_source.collect(sources, targets, get, options.per_source)
    timed = with_instants(rows, zoned).withColumn("published", F.timestamp_seconds("utc_s")).drop("utc_s")
    tables = edition(timed, sources, options, get)
    if tables["articles"].isEmpty():
        return {"skipped": "no articles"}
    markdown, value, page = documents(tables, options)
    value["health"] = [r.asDict() for r in ingest.target_health(sources, log, tables["articles"]).orderBy("source_id").collect()]
    written = sinks.write_edition_files(options.output, options.label, markdown, value, page if options.html else None)
    if options.use_cache and not options.dry_run:
        remember(spark, tables, options)
    if options.marker and not options.dry_run:
        sinks.write_marker(marker, options.label, len(value["stories"]), options.run.isoformat())
    return {"written": written, "stats": value["stats"]}


def remember(spark: SparkSession, tables: dict[str, DataFrame], options: RunOptions) -> None:
    """The synthesis and the entities of the day, upserted into the memory table (K-3)."""
    path = os.path.join(options.state, "memory")
    names = tables["analyses"].select(F.explode("entities").alias("entity")).agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    fresh = tables["synthesis"].select(F.lit(options.label).alias("date"), F.col("editor_note_en"), F.col("story_of_the_day")).crossJoin(names)  # one row by one row
    old = memory.read_state(spark, path)
    memory.replace_table(memory.upsert(old if old is not None else fresh.limit(0), fresh), path)
