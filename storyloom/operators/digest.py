"""Editions: extractive analyses, the synthesis from counts, JSON documents, Markdown, search, manifests and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.functions.text import escape_markdown, first_sentences
from storyloom.operators.stories import first_seen, primary_of


def search(cards: DataFrame, query: str = "", category: str = "") -> DataFrame:
    """Cards of a category whose title, summary, sources or category hold the text, without case (P-14)."""
    hay = F.lower(F.concat_ws(" ", "title", "summary", "sources", "category"))
    rows = cards.filter(F.col("category") == category) if category else cards
    return rows.filter(hay.contains(query.lower())) if query else rows


def extractive_analysis(members: DataFrame) -> DataFrame:
    """A deterministic record for each story without any model (M-1).

    Headlines only in the primary article's own language; the English summary is its first sentences, else its title, whatever its
    language, the Arabic one only where it is Arabic. Confidence is always low; tags are the first four sections. Others are
    named by the first four other titles. members: articles of stories (story_id, ord, ...).
    """
    primary = primary_of(members).select("story_id", F.col("primary_id").alias("article_id"))
    own = members.join(primary, ["story_id", "article_id"]).select("story_id", "title", "lang", first_sentences(F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("summary"), F.lit(""))).alias("lead"))
    rank = F.row_number().over(W.partitionBy("story_id").orderBy("ord", "article_id"))
    rest = members.select("story_id", "ord", "article_id", "title").join(primary, ["story_id", "article_id"], "left_anti").withColumn("__q", rank).filter("__q <= 4")
    rest = rest.groupBy("story_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__q", "title"))), lambda x: x["title"]), "; ").alias("others"))
    rows = own.join(first_seen(members, "source_name"), "story_id", "left").join(first_seen(members, "section"), "story_id", "left").join(rest, "story_id", "left")
    short, none = F.coalesce(F.nullif(F.col("lead"), F.lit("")), F.col("title")), F.lit("")
    names = F.coalesce("source_names", F.array().cast("array<string>"))
    count, listed = F.size(names).cast("string"), F.array_join(names, ", ")
    when = lambda lang, value: F.when(F.col("lang") == lang, value).otherwise(none)
    return rows.select(
        "story_id",
        when("en", F.col("title")).alias("headline_en"),
        when("ar", F.col("title")).alias("headline_ar"),
        short.alias("summary_en"),
        when("ar", short).alias("summary_ar"),
        F.concat(F.lit("Carried by "), count, F.lit(" outlet(s): "), listed, F.lit(".")).alias("why_it_matters_en"),
        F.concat(F.lit("عدد المصادر "), count, F.lit(": "), listed, F.lit(".")).alias("why_it_matters_ar"),
        F.coalesce(F.concat(F.lit("Also: "), "others"), none).alias("between_the_lines_en"),
        none.alias("between_the_lines_ar"),
        none.alias("watch_next_en"),
        none.alias("watch_next_ar"),
        F.lit("low").alias("confidence"),
        F.lit("No model was used.").alias("confidence_reason"),
        F.array().cast("array<string>").alias("entities"),
        F.slice(F.coalesce("sections", F.array().cast("array<string>")), 1, 4).alias("tags"),
        F.lit("extractive").alias("_source"),
    )


def with_analyses(stories: DataFrame, analyses: DataFrame, key: str = "story_id") -> DataFrame:
    """Every story with its analysis, null where it has none (J-11)."""
    return stories.join(analyses, key, "left")


def reference_order(articles: DataFrame, *first: str) -> DataFrame:
    """(first, pos, ...): the order of a story's references: tier, outlet, title (T-12)."""
    order = W.partitionBy(*first).orderBy(F.coalesce("tier", F.lit(2)), "source_name", "title", "article_id")
    return articles.withColumn("pos", F.row_number().over(order))


def extractive_synthesis(stories: DataFrame, carried: str = "", limit: int = 8) -> DataFrame:
    """One row for each edition: the note from counts, the first story, majors, history cut to 1200 characters, distinct entities (A-19).

    stories: (edition, rank, title, outlet_count, entities array). Stories without an edition are one edition of their own.
    """
    names = stories.select("edition", F.explode("entities").alias("e")).filter(F.trim("e") != "").groupBy("edition", F.lower("e").alias("k")).agg(F.min("e").alias("e"), F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("edition").orderBy(F.desc("n"), "k"))
    first = names.withColumn("p", place).filter(F.col("p") <= limit).groupBy(F.col("edition").alias("at"))
    top = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.substring("e", 1, 100).alias("e")))), lambda s: s["e"]), ", ").alias("names"))
    rows = stories.groupBy("edition").agg(F.count("*").alias("n"), F.count_if(F.col("outlet_count") >= 3).alias("majors"), F.min_by("title", "rank").alias("story_of_the_day"))
    note = F.concat(F.col("n").cast("string"), F.lit(" stories, "), F.col("majors").cast("string"), F.lit(" carried by three outlets or more."))
    joined = rows.join(top, F.col("edition").eqNullSafe(F.col("at")), "left")
    return joined.select("edition", note.alias("editor_note_en"), "story_of_the_day", F.lit(carried[:1200]).alias("history"), F.coalesce("names", F.lit("")).alias("entities"))


def edition_json(stories: DataFrame, members: DataFrame) -> DataFrame:
    """(edition, story_id, doc): each story with its articles as a JSON document, score to 3 digits (K-2). Documents stay one row
    for each story; an edition's file is their concatenation at the sink."""
    part = F.struct("ord", F.struct("article_id", "source_id", "title", "url").alias("a"))
    arts = members.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["a"]).alias("articles"))
    doc = F.to_json(F.struct("story_key", F.round("score", 3).alias("score"), "category", "outlet_count", "articles"))
    return stories.join(arts, "story_id", "left").select("edition", "story_id", doc.alias("doc"))


def edition_markdown(stories: DataFrame) -> DataFrame:
    """(edition, markdown): the ranked list of an edition's stories. stories: (edition, rank, title, outlet_count, category) (K-9)."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". **"), escape_markdown(F.col("title")), F.lit("** ("), F.col("outlet_count").cast("string"), F.lit(", "), F.col("category"), F.lit(")"))
    rows = stories.select("edition", "rank", line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n")
    return rows.groupBy("edition").agg(lines.alias("body")).select("edition", F.concat(F.lit("# "), F.col("edition").cast("string"), F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("markdown"))


def other_headline(lang: Column, headline_en: Column, headline_ar: Column, title: Column, normal) -> Column:
    """The other language's headline, only if it says something else than the title (P-17)."""
    other = F.when(lang == "ar", headline_en).otherwise(headline_ar)
    return F.when((F.trim(other) != "") & (normal(other) != normal(title)), other)


def localized(preferred: Column, alternate: Column) -> Column:
    """The preferred language's value, else the other's (P-19)."""
    return F.coalesce(F.nullif(F.trim(preferred), F.lit("")), F.nullif(F.trim(alternate), F.lit("")))


def manifest_changes(published: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, change): insert, update or delete, by content hash; both sides (name, content) (K-7, D-8, J-12)."""
    p = published.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("old"))
    w = wanted.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("new"))
    rows = p.join(w, "name", "full")
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    return rows.select("name", change.alias("change")).filter("change is not null")


def stale_rows(published: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows that differ in either direction (K-8)."""
    return published.exceptAll(wanted).withColumn("side", F.lit("published")).unionByName(wanted.exceptAll(published).withColumn("side", F.lit("wanted")))


def edition_order(editions: DataFrame) -> DataFrame:
    """Editions newest first; the first is the lead (T-14)."""
    return editions.orderBy(F.desc("edition"))


def read_editions(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(stories, members) from documents of edition_json, one JSON text for each line: outlets are derived anew, not read (S-17)."""
    schema = "story_key string, score double, category string, outlet_count bigint, articles array<struct<article_id: bigint, source_id: string, title: string, url: string>>"
    docs = spark.read.schema(schema).json(path).filter("story_key is not null")
    members = docs.select("story_key", F.posexplode("articles").alias("ord", "a")).select("story_key", "ord", "a.*")
    outlets = members.groupBy("story_key").agg(F.countDistinct("source_id").alias("outlet_count"))
    return docs.select("story_key", "score", "category").join(outlets, "story_key", "left"), members


def distinct_ignoring_case(items: Column) -> Column:
    """Trimmed distinct items in their first spelling and order, compared without case; blanks left out (D-5)."""
    clean = F.filter(F.transform(items, F.trim), lambda x: x != "")
    lower = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def link_label(kind: Column) -> Column:
    """A link type in words."""
    return F.initcap(F.regexp_replace(kind, "[_-]", " "))


def themes(synthesis: DataFrame) -> DataFrame:
    """(edition, pos, theme, story_ids, note): the labelled themes of an edition's synthesis; top_themes is an array of structs (P-20)."""
    rows = synthesis.select("edition", F.posexplode("top_themes").alias("pos", "t")).filter("t is not null")
    return rows.select("edition", "pos", F.trim("t.theme").alias("theme"), "t.story_ids", "t.note").filter("theme <> ''")


def edition_cards(ranking: DataFrame, members: DataFrame, analyses: DataFrame) -> DataFrame:
    """(rank, story_id, category, score, outlet_count, title, analysis fields, references): what a page shows of each story.

    References are the story's articles by tier, outlet and title (T-12); stories without analysis have nulls (J-11).
    """
    titles = primary_of(members).select("story_id", F.col("primary_title").alias("title"))
    part = F.struct("pos", F.struct("source_name", "title", "url").alias("a"))
    refs = reference_order(members, "story_id").groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["a"]).alias("references"))
    rows = with_analyses(ranking.join(titles, "story_id"), analyses.drop("entities", "tags", "_source"))
    return rows.join(refs, "story_id").withColumn("score", F.round("score", 3))


def _escaped(text: str | None) -> str:
    import re

    return re.sub(r"\s+", " ", re.sub(r"([\\`*_\[\]<>|])", r"\\\1", text or ""))


def markdown_page(edition: dict) -> str:
    """The Markdown of one edition (K-9): figures, note, glance by category and outlet, stories with references, index."""
    s, stories = edition["stats"], edition["stories"]
    out = [f"# {edition['date']}", f"{s['total_articles']} articles, {s['outlets_reporting']} outlets, {s['total_stories']} stories, {s['major_stories']} major."]
    if note := (edition.get("synthesis") or {}).get("editor_note_en"):
        out.append(note)
    out.append("## At a glance\n\n" + "\n".join([f"- {name}: {n}" for name, n in edition["categories"].items()] + [f"- {_escaped(name)}: {n}" for name, n in list(edition["outlets"].items())[:6]]))
    for story in stories:
        if story.get("confidence"):
            refs = "\n".join(f"- {_escaped(r['source_name'])}: [{_escaped(r['title'])}]({r['url']})" for r in story["references"])
            out.append(f"## {story['rank']}. {_escaped(story['title'])}\n\n*{story['category']}, {story['outlet_count']} outlets*\n\n{_escaped(story.get('summary_en'))}\n\n{refs}")
    if rest := [story for story in stories if not story.get("confidence")]:
        out.append("## Also\n\n" + "\n".join(f"- {_escaped(story['title'])} ({story['outlet_count']})" for story in rest))
    return "\n\n".join(out) + "\n"


def html_page(edition: dict) -> str:
    """The page of one edition: the same content, each story a card that search and category filters can use (K-9, P-14)."""
    from html import escape

    s, cards = edition["stats"], []
    for story in edition["stories"]:
        refs = "".join(f'<li><a href="{escape(r["url"] or "")}">{escape(r["source_name"] or "")}: {escape(r["title"] or "")}</a></li>' for r in story["references"])
        cards.append(f'<article data-category="{escape(story["category"])}"><h2>{story["rank"]}. {escape(story["title"] or "")}</h2><p>{escape(story.get("summary_en") or "")}</p><ul>{refs}</ul></article>')
    stats = f'{s["total_articles"]} articles, {s["outlets_reporting"]} outlets, {s["total_stories"]} stories, {s["major_stories"]} major'
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{edition["date"]}</title></head><body><h1>{edition["date"]}</h1><p class="stats">{stats}</p>{"".join(cards)}</body></html>'


def site_index(editions: list[tuple[str, str]]) -> str:
    """The page that lists editions (date, stats line), newest first (K-9, T-14)."""
    from html import escape

    items = "".join(f'<li><a href="{escape(d)}.html">{escape(d)}</a> {escape(stats)}</li>' for d, stats in sorted(editions, reverse=True))
    return f'<!doctype html><html><head><meta charset="utf-8"><title>Editions</title></head><body><ul>{items}</ul></body></html>'
