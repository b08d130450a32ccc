"""Entities and links between stories: normal names, the entity graph, link validation and listings, recurring names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import relax, squash, title_case
from storyloom.vocab.words import Lexicon

LINK_TYPES = ("same-thread", "cause-effect", "actor", "contradiction", "pattern", "timeline")


def not_outlets(names: DataFrame, outlets: DataFrame, column: str = "entity", outlet: str = "name") -> DataFrame:
    """Names that are no spelling of an outlet: both sides squashed and relaxed, neither begins with the other, from four
    characters on (P-9). A theta join in one direction each, done as equi joins on prefixes of every length in use."""
    form = lambda c: relax(squash(F.col(c)))
    left = names.withColumn("__f", form(column))
    right = outlets.select(form(outlet).alias("o")).filter(F.length("o") >= 4).distinct()
    # an outlet that begins with the name: the name is one of the outlet's prefixes, and the other way round
    prefixes = lambda c: F.transform(F.sequence(F.lit(4), F.length(c)), lambda n: F.substring(c, 1, n))
    longer = right.select(F.explode(prefixes(F.col("o"))).alias("p")).distinct()
    kept = left.join(longer, F.col("__f") == F.col("p"), "left_anti")
    # only the forms are compared a second time, each once
    own = left.select("__f").filter(F.length("__f") >= 4).distinct().select(F.col("__f").alias("__hit"), F.explode(prefixes(F.col("__f"))).alias("q"))
    hit = own.join(right, F.col("q") == F.col("o"), "left_semi").select("__hit").distinct()
    return kept.join(hit, F.col("__f") == F.col("__hit"), "left_anti").drop("__f")


def normal_entity(name: Column, lexicon: Lexicon | None = None) -> Column:
    """Single blanks; null for a stop name; canonical name by lower case, else title case of ASCII names (F-13, J-7)."""
    lexicon = lexicon or Lexicon()
    clean = F.trim(F.regexp_replace(name, r"\s+", " "))
    low = F.lower(clean)
    known = F.create_map(*[F.lit(x) for k, v in sorted(lexicon.entities.items()) for x in (k.lower(), v)]) if lexicon.entities else None
    named = F.coalesce(F.try_element_at(known, low), title_case(clean)) if known is not None else title_case(clean)
    return F.when((clean != "") & ~low.isin(*lexicon.stop_entities), named)


def entity_graph(mentions: DataFrame, least: int = 2) -> DataFrame:
    """(edition, entity, story_ids, n): entities of at least `least` stories of an edition; mentions (edition, sid, entity); ids
    in lexicographic order (A-13). Distinct pairs are formed first, and a list holds stories of one edition only."""
    pairs = mentions.filter("entity is not null and sid is not null").select("edition", "entity", "sid").distinct()
    grouped = pairs.groupBy("edition", "entity").agg(F.array_join(F.sort_array(F.collect_list("sid")), ",").alias("story_ids"), F.count("*").alias("n"))
    return grouped.filter(F.col("n") >= least)


def valid_links(links: DataFrame, stories: DataFrame, strict: bool = True) -> DataFrame:
    """Links (type, src, dst, evidence) between existing stories with evidence (P-10); strict: of a known type and not to
    itself; otherwise only the ids and the evidence count (P-11). stories: (sid)."""
    rows = links.select(F.lower(F.trim("type")).alias("type"), F.upper(F.trim("src")).alias("src"), F.upper(F.trim("dst")).alias("dst"), F.trim("evidence").alias("evidence"))
    rows = rows.filter("src is not null and dst is not null and evidence <> ''")
    if strict:
        rows = rows.filter(F.col("type").isin(*LINK_TYPES) & (F.col("src") != F.col("dst")))
    ids = stories.select("sid").distinct()
    return rows.join(ids.withColumnRenamed("sid", "src"), "src", "left_semi").join(ids.withColumnRenamed("sid", "dst"), "dst", "left_semi").select("type", "src", "dst", "evidence")


def links_by_type(links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, type, n, edges): most frequent first; links of one edition, or of several named in `by` (A-15)."""
    grouped = links.groupBy(*by, "type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(">", "src", "dst"))), ",").alias("edges"))
    return grouped.orderBy(*by, F.desc("n"), "type")


def links_by_story(links: DataFrame) -> DataFrame:
    """(sid, type, other): every link under both of its ends (J-9)."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("sid"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("sid"), F.col("src").alias("other"))))
    return links.select("type", ends.alias("e")).select("e.sid", "type", "e.other")


def link_titles(links: DataFrame, stories: DataFrame) -> DataFrame:
    """(src, src_title, dst, dst_title, type): titles of both ends, the id where a story has none (J-8)."""
    t = stories.select("sid", "title")
    rows = links.join(t.withColumnRenamed("sid", "src").withColumnRenamed("title", "a"), "src", "left").join(t.withColumnRenamed("sid", "dst").withColumnRenamed("title", "b"), "dst", "left")
    return rows.select("src", F.coalesce("a", "src").alias("src_title"), "dst", F.coalesce("b", "dst").alias("dst_title"), "type")


def recurring_entities(records: DataFrame, least_days: int = 2, limit: int = 12) -> DataFrame:
    """(entity, days): entities of at least so many dates, most days first; records (date, entity) (A-14)."""
    days = records.filter("entity is not null").groupBy("entity").agg(F.countDistinct("date").alias("days"))
    return days.filter(F.col("days") >= least_days).orderBy(F.desc("days"), "entity").limit(limit)


def phrase_form(text: Column) -> Column:
    """Runs of Latin letters, digits and Arabic characters with single blanks, in lower case, blank at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\x{600}-\x{6ff}]+", " ")), F.lit(" "))


def mentioned(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """Entities (entity) whose name stands as whole words in one of the texts (text); a leading article may be missing (J-10).

    Names meet texts by their first word, an equi join; the whole name is then looked for in the text.
    """
    bare = F.regexp_replace(phrase_form(F.col("entity")), r"^ (the|a|an) ", " ")
    names = entities.filter("entity is not null").select("entity", F.explode(F.array_distinct(F.array(phrase_form(F.col("entity")), bare))).alias("needle")).filter(F.trim("needle") != "")
    names = names.withColumn("w", F.element_at(F.split(F.trim("needle"), " "), 1))
    # each text looks its first words up; only texts with a candidate keep their words, as a set of needles of each
    words = texts.filter("text is not null").select(phrase_form(F.col("text")).alias("hay"))
    rows = words.select("hay", F.xxhash64("hay").alias("h"))
    firsts = names.groupBy("w").agg(F.count("*").alias("n"))
    index = rows.select("h", F.explode(F.array_distinct(F.split(F.trim("hay"), " "))).alias("w")).join(firsts.select("w"), "w", "left_semi").join(names, "w")
    pairs = index.select("h", "entity", "needle").distinct()
    return pairs.join(rows.dropDuplicates(["h"]), "h").filter(F.contains(F.col("hay"), F.col("needle"))).select("entity").distinct()
