"""Queries of the document-threading engine over the bundled tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.functions import times as D
from storyloom.functions import urls as U
from storyloom.operators import clustering, digest, entities, ingest, memory, similarity, stories
from storyloom.plans import edition
from storyloom.plans.views import ARTICLES, DOCUMENTS, MEMBERS, RUN, RUN_SECONDS, articles, documents, members
from storyloom.sources.tables import read_table as table
from storyloom.vocab import words as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, directory) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _normal(x: str) -> str:
    return (
        rf"lower(trim(regexp_replace(regexp_replace(translate(regexp_replace(coalesce({x}, ''), '{T.MARKS}', '', 'g'), '{T.FOLD_FROM}', '{T.FOLD_TO}'), "
        r"'[^\p{L}\p{N}_\s\x{600}-\x{6ff}]+', ' ', 'g'), '\s+', ' ', 'g')))"
    )


def _words(x: str) -> str:
    return f"list_filter(string_split({_normal(x)}, ' '), lambda w: w <> '')"


def _meaningful(x: str) -> str:
    return f"list_filter({_words(x)}, lambda w: not list_contains({_list(V.STOPWORDS)}, w) and length(w) > 1)"


def _stem(w: str) -> str:
    return rf"regexp_replace({w}, '{T.STEM}', '\1')"


def _stemmed(words) -> list[str]:
    return sorted({*words, *map(T.stem_word, words)})


_NUMBERS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in V.NUMBER_WORDS.items()) + "}"


def _canonical(x: str) -> str:
    number = f"coalesce({_NUMBERS}[w], w)"
    stems = f"list_transform(list_transform({_words(x)}, lambda w: {number}), lambda w: {_stem('w')})"
    return rf"list_distinct(list_filter({stems}, lambda t: not list_contains({_list(_stemmed(V.STOPWORDS))}, t) and not regexp_matches(t, '{T.YEAR}') and (length(t) > 1 or regexp_matches(t, '^\d+$'))))"


TOKENS = f"""
tok0 as (select edition, article_id, lang, {_canonical("title")} as toks from art),
tok as (select *, list_filter(toks, lambda t: not list_contains({_list(_stemmed(V.GENERIC))}, t)) as dist from tok0 where len(toks) > 0),
cls as (select edition, lang, list_sort(toks) as toks, min(article_id) as article_id, any_value(dist) as dist from tok group by edition, lang, list_sort(toks))"""

_VETO = (
    f"((len(list_intersect(a.toks, {_list(V.CASUALTY)})) > 0 and len(list_intersect(b.toks, {_list(V.CASUALTY)})) > 0 and len(list_intersect(list_intersect(a.toks, {_list(V.CASUALTY)}), b.toks)) = 0)"
    f" or (len(list_intersect(a.toks, {_list(V.COUNTS)})) > 0 and len(list_intersect(b.toks, {_list(V.COUNTS)})) > 0 and list_sort(list_intersect(a.toks, {_list(V.COUNTS)})) <> list_sort(list_intersect(b.toks, {_list(V.COUNTS)}))))"
)
# classes: equal token sets of one edition and language, by their smallest id
_PAIRS = "from cls a join cls b on a.edition = b.edition and a.article_id < b.article_id"
_SCORE = "len(list_intersect(a.toks, b.toks)) / least(len(a.toks), len(b.toks))"
_DSCORE = "len(list_intersect(a.dist, b.dist)) / least(len(a.dist), len(b.dist))"
_EDGES = f"edges as (select a.edition, a.article_id as src, b.article_id as dst, round({_SCORE}, 6) as score {_PAIRS} where {_SCORE} >= 0.5 and len(list_intersect(a.dist, b.dist)) >= 2 and not {_VETO})"


# ---------------------------------------------------------------- ingest


@query(f"with {ARTICLES} select article_id from art where published is null or floor(epoch(published)) >= {RUN_SECONDS} - 26 * 3600")
def window_filter(spark, d) -> DataFrame:
    return ingest.within_window(articles(spark, d), RUN).select("article_id")


@query(f"with {ARTICLES} select source_id, count(*) as n from art where source_id in ('lanternpost', 'harbourledger') group by source_id")
def source_filter(spark, d) -> DataFrame:
    return ingest.of_sources(articles(spark, d), ["lanternpost", "harbourledger"]).groupBy("source_id").agg(F.count("*").alias("n"))


@query(f"with {ARTICLES} select source_id, count(*) as n from art where source_id in (select source_id from sources where is_enabled) group by source_id")
def enabled_articles(spark, d) -> DataFrame:
    return ingest.enabled_only(articles(spark, d), table(spark, d, "sources")).groupBy("source_id").agg(F.count("*").alias("n"))


@query(f"with {ARTICLES} select article_id from art qualify row_number() over (partition by source_id, split_part(url, '?', 1) order by feed_ord nulls first, item_ord nulls first, article_id) = 1")
def url_dedup_first(spark, d) -> DataFrame:
    return ingest.first_by_url(articles(spark, d)).select("article_id")


@query(f"with {ARTICLES} select article_id from art qualify row_number() over (partition by source_id order by published desc nulls first, article_id) <= 120")
def per_source_topn(spark, d) -> DataFrame:
    return ingest.newest_per_source(articles(spark, d)).select("article_id")


@query(f"""with {ARTICLES}, seen as (select source_id, feed_ord, count(*) as n from art group by all),
per as (select f.source_id, count(*) as total, count(n) as okn, sum(n) as n from feeds f left join seen using (source_id, feed_ord) where is_enabled group by 1)
select s.source_id, s.tier, coalesce(okn, 0) as targets_ok, coalesce(total, 0) as targets_total, coalesce(okn, 0) || '/' || coalesce(total, 0) as targets, coalesce(okn, 0) > 0 as ok, cast(coalesce(per.n, 0) as bigint) as articles
from sources s left join per using (source_id) where s.is_enabled""")
def source_health(spark, d) -> DataFrame:
    return ingest.source_health(table(spark, d, "sources"), table(spark, d, "feeds"), articles(spark, d))


@query(f"""with {ARTICLES}, s as (select count(*) as total_stories, count(*) filter (outlet_count >= 3) as major_stories from stories)
select count(*) as total_articles, count(distinct source_id) as outlets_reporting, any_value(total_stories) as total_stories, any_value(major_stories) as major_stories from art, s""")
def edition_stats(spark, d) -> DataFrame:
    return ingest.edition_stats(articles(spark, d), table(spark, d, "stories"))


# ---------------------------------------------------------------- text


@query(f"with {DOCUMENTS}, t as (select unnest(list_distinct({_meaningful('title')})) as token from doc) select token, count(*) as n from t group by token")
def title_tokens(spark, d) -> DataFrame:
    return documents(spark, d).select(F.explode(T.tokens(F.col("title"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query()
def title_tokens_compatible(spark, d) -> DataFrame:
    """Tokens of the articles' titles after NFKC, which SQL lacks."""
    return articles(spark, d).select(F.explode(T.tokens(F.col("title"), compatibility=True)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"with {DOCUMENTS}, t as (select unnest({_words('title')}) as w from doc), s as (select {_stem('w')} as stem from t) select stem, count(*) as n from s group by stem")
def stem_counts(spark, d) -> DataFrame:
    return documents(spark, d).select(F.explode(T.words_of(T.normalize_text(F.col("title")))).alias("w")).select(T.stem(F.col("w")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query(f"with {ARTICLES}, f as (select substr(sha1(array_to_string({_meaningful('title')}, ' ')), 1, 16) as fingerprint from art) select fingerprint, count(*) as n from f group by fingerprint having count(*) > 1")
def fingerprint_groups(spark, d) -> DataFrame:
    rows = articles(spark, d).select(T.fingerprint(F.col("title")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1")


@query(f"with {ARTICLES}, {TOKENS}, t as (select unnest(toks) as token, dist from tok) select token, count(*) as n, count(*) filter (list_contains(dist, token)) as n_distinctive from t group by token")
def canonical_token_counts(spark, d) -> DataFrame:
    rows = similarity.tokenised(articles(spark, d)).select(F.explode("toks").alias("token"), "dist")
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.array_contains("dist", F.col("token"))).alias("n_distinctive"))


@query()
def aliased_tokens(spark, d) -> DataFrame:
    """Canonical tokens with phrase aliases across languages (a Python scan, as SQL has no greedy phrase match)."""
    lexicon = V.Lexicon(aliases={"لجنة المياه": "water board", "محكمة العمل": "labour tribunal", "hafenbehörde": "harbour authority", "office des eaux": "water board"})
    return articles(spark, d).select(F.explode(T.canonical_tokens(F.col("title"), lexicon)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""with {ARTICLES}, t as (select article_id, trim(summary, ' ') as s from art)
select article_id, case when length(s) <= 80 then s else rtrim(regexp_replace(substr(s, 1, 80), ' [^ ]*$', ''), ' ') || '…' end as short from t""")
def truncated_summaries(spark, d) -> DataFrame:
    return articles(spark, d).select("article_id", T.truncate(F.col("summary"), 80).alias("short"))


@query(rf"with {DOCUMENTS} select doc_id, regexp_replace(substr(regexp_replace({_normal('title')}, '[^\p{{L}}\p{{N}}]+', '-', 'g'), 1, 60), '^-+|-+$', '', 'g') as slug from doc")
def slugs(spark, d) -> DataFrame:
    return documents(spark, d).select("doc_id", T.slug(F.col("title")).alias("slug"))


def _truncated(x: str, limit: int) -> str:
    return f"case when length({x}) <= {limit} then {x} else rtrim(regexp_replace(substr({x}, 1, {limit}), ' [^ ]*$', ''), ' ') || '…' end"


def _sentences(x: str) -> str:
    """The first three sentences, joined."""
    clean = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'), ' ')"
    return rf"array_to_string(list_slice(string_split(regexp_replace({clean}, '([.!?؟]) ', '\1' || chr(1), 'g'), chr(1)), 1, 3), ' ')"


@query(f"with {ARTICLES}, t as (select article_id, {_sentences('body')} as s from art) select article_id, {_truncated('s', 420)} as lead from t")
def lead_sentences(spark, d) -> DataFrame:
    return articles(spark, d).select("article_id", T.first_sentences(F.col("body")).alias("lead"))


@query(rf"with {ARTICLES} select source_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') as host, count(*) as n, count(*) filter (regexp_matches(url, '{U.ARTICLE_URL}')) as n_articles from art group by 1, 2")
def url_hosts(spark, d) -> DataFrame:
    rows = articles(spark, d).select("source_id", U.host(F.col("url")).alias("host"), U.is_article_url(F.col("url")).alias("shaped"))
    return rows.groupBy("source_id", "host").agg(F.count("*").alias("n"), F.count_if("shaped").alias("n_articles"))


@query(rf"with {ARTICLES} select regexp_matches(title, '[\x{{600}}-\x{{6ff}}]') as arabic, count(*) as n from art group by 1")
def arabic_titles(spark, d) -> DataFrame:
    return articles(spark, d).groupBy(F.col("title").rlike(r"[\x{600}-\x{6ff}]").alias("arabic")).agg(F.count("*").alias("n"))


@query("""with e as (select cast(json_extract_string(props, '$.k') as bigint) as k from events) select k, count(*) as n from e group by k""")
def json_props(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- similarity and clustering


def _classes(spark, d) -> tuple[DataFrame, DataFrame]:
    return similarity.headline_classes(similarity.tokenised(articles(spark, d)))


@query(f"with {ARTICLES}, {TOKENS}, {_EDGES} select * from edges")
def same_story_edges(spark, d) -> DataFrame:
    """Pairs of classes; the members of a class are in headline_classes."""
    return similarity.same_story_edges(_classes(spark, d)[0])


@query(f"with {ARTICLES}, {TOKENS} select tok.article_id, cls.article_id as class_id, len(cls.dist) >= 2 as linked from tok join cls on tok.edition is not distinct from cls.edition and tok.lang is not distinct from cls.lang and list_sort(tok.toks) = cls.toks")
def headline_classes(spark, d) -> DataFrame:
    """The class of each headline, and whether its copies are linked."""
    classes, membership = _classes(spark, d)
    return membership.join(classes.select("class_id", (F.size("dist") >= 2).alias("linked")), "class_id").select("article_id", "class_id", "linked")


@query(f"with {ARTICLES}, {TOKENS} select a.article_id as src, b.article_id as dst {_PAIRS} where {_SCORE} >= 0.5 and len(list_intersect(a.dist, b.dist)) >= 2 and {_VETO}")
def number_veto_pairs(spark, d) -> DataFrame:
    return similarity.same_story_edges(_classes(spark, d)[0], veto=None).select("src", "dst")


@query(f"with {ARTICLES}, {TOKENS} select a.edition, a.article_id as src, b.article_id as dst, round({_DSCORE}, 6) as score {_PAIRS} where a.lang <> b.lang and len(list_intersect(a.dist, b.dist)) >= 2 and {_DSCORE} >= 0.3")
def cross_language_edges(spark, d) -> DataFrame:
    return similarity.bridge_edges(_classes(spark, d)[0])


@query(f"""with recursive {ARTICLES}, {TOKENS}, pairs as (select a.article_id as src, b.article_id as dst from tok a join tok b on a.edition = b.edition and a.article_id < b.article_id where {_SCORE} >= 0.5 and len(list_intersect(a.dist, b.dist)) >= 2 and not {_VETO}), both_ways as (select src, dst from pairs union all select dst, src from pairs),
walk as (select article_id, article_id as other from tok union select w.article_id, e.dst from walk w join both_ways e on e.src = w.other)
select article_id, min(other) as story_id from walk group by article_id""")
def stories_graph(spark, d) -> DataFrame:
    """The SQL links every pair of articles, copies included; the classes give the same stories."""
    classes, membership = _classes(spark, d)
    return clustering.graph_stories(classes, membership, similarity.same_story_edges(classes))


@query()
def stories_exact(spark, d) -> DataFrame:
    a = articles(spark, d)
    return clustering.exact_stories(similarity.tokenised(a, compatibility=True), a.select("article_id", "published", F.col("article_id").alias("pos"), "url"))


@query(f"""with {MEMBERS}, t as (select story_id, article_id, list_distinct({_meaningful('title')}) as s from mem),
p as (select a.story_id, len(list_intersect(a.s, b.s)) as i, len(a.s) as na, len(b.s) as nb from t a join t b on a.story_id = b.story_id and a.article_id < b.article_id)
select story_id, round(max(case when na > 0 and nb > 0 then greatest(i / (na + nb - i), 0.9 * i / least(na, nb)) else 0.0 end), 6) as similarity from p group by story_id""")
def story_similarity(spark, d) -> DataFrame:
    """Largest of jaccard and 0.9 of the overlap between two members of a story."""
    rows = members(spark, d).select(F.col("story_id").alias("edition"), "article_id", T.tokens(F.col("title")).alias("toks"))
    return similarity.best_pair(rows).select(F.col("edition").alias("story_id"), F.round("best", 6).alias("similarity"))


# ---------------------------------------------------------------- stories


@query(f"""with {MEMBERS} select story_id, count(*) as n_articles, count(distinct source_name) as outlet_count, array_to_string(list_sort(list(distinct lang)), ',') as langs,
cast(floor(epoch(max(published))) as bigint) as latest_s, cast(floor(epoch(min(published))) as bigint) as earliest_s, max(case when coalesce(tier, 2) = 1 then 1 else 0 end) as any_tier1 from mem group by story_id""")
def story_aggregates(spark, d) -> DataFrame:
    return stories.story_aggregates(members(spark, d)).withColumn("latest_s", F.unix_seconds("latest")).withColumn("earliest_s", F.unix_seconds("earliest")).drop("latest", "earliest")


@query(f"with {MEMBERS}, f as (select story_id, section, min(ord) as o from mem where section <> '' group by all) select story_id, string_agg(section, ',' order by o, section) as sections from f group by story_id")
def story_sections(spark, d) -> DataFrame:
    return stories.first_seen(members(spark, d), "section").select("story_id", F.array_join("sections", ",").alias("sections"))


@query(f"with {MEMBERS}, f as (select story_id, source_name, min(ord) as o from mem group by all) select story_id, string_agg(source_name, ',' order by o, source_name) as sources from f group by story_id")
def story_sources(spark, d) -> DataFrame:
    return stories.first_seen(members(spark, d), "source_name").select("story_id", F.array_join("source_names", ",").alias("sources"))


_PRIMARY = "row_number() over (partition by story_id order by coalesce(tier, 2), -length(coalesce(nullif(body, ''), summary, '')), title, article_id) = 1"


@query(f"with {MEMBERS} select story_id, article_id as primary_id, title as primary_title from mem qualify {_PRIMARY}")
def story_primary(spark, d) -> DataFrame:
    return stories.primary_of(members(spark, d)).select("story_id", "primary_id", "primary_title")


_SECTION_MAP = "map {" + ", ".join(f"'{k}': {v}" for k, v in V.SECTION_WEIGHT.items()) + "}"
_SCORES = f"""
weighted as (select story_id, published, tier, source_name, round(cast(coalesce(map {{1: 3.0, 2: 2.0, 3: 1.0}}[tier], {V.OTHER_TIER}) as double) * cast(coalesce({_SECTION_MAP}[coalesce(nullif(section, ''), 'general')], 1.0) as double)
  * case when row_number() over (partition by story_id, source_id order by ord, article_id) = 1 then 1.0 else 0.15 end, 6) as w from mem),
per as (select story_id, sum(w) as base, count(distinct source_name) as outlet_count, {RUN_SECONDS} - epoch(max(published)) as age, max(case when coalesce(tier, 2) = 1 then 1 else 0 end) as any1 from weighted group by story_id),
prim as (select story_id, length(coalesce(nullif(body, ''), summary, '')) as n from mem qualify {_PRIMARY}),
scores as (select story_id, round(base + 2.6 * (outlet_count - 1) + case when age is null then 0 when age <= 14400 then 2.0 when age <= 36000 then 1.2 when age <= 64800 then 0.6 else 0 end + 0.8 * least(n / 2500, 1.0) + 1.5 * any1, 6) as score, outlet_count from per join prim using (story_id))"""
_RANKS = "ranks as (select x.*, s.edition, row_number() over (partition by s.edition order by x.score desc, x.outlet_count desc, x.story_id) as rank from scores x join (select story_id, edition from stories) s using (story_id))"


@query(f"with {MEMBERS}, {_SCORES} select story_id, cast(score as double) as score, outlet_count from scores")
def story_scores(spark, d) -> DataFrame:
    return stories.story_scores(members(spark, d), RUN)


def _ranking(spark, d) -> DataFrame:
    scored = stories.story_scores(members(spark, d), RUN).join(table(spark, d, "stories").select("story_id", "edition"), "story_id")
    return stories.ranked(scored, ("edition",))


@query(f"with {MEMBERS}, {_SCORES}, {_RANKS} select edition, story_id, rank from ranks")
def edition_ranks(spark, d) -> DataFrame:
    return _ranking(spark, d).select("edition", "story_id", "rank")


@query(f"with {MEMBERS}, {_SCORES}, {_RANKS} select edition, story_id, rank from ranks where rank <= 28")
def top_stories(spark, d) -> DataFrame:
    return stories.top_stories(_ranking(spark, d)).select("edition", "story_id", "rank")


@query(f"with {MEMBERS}, {_SCORES}, {_RANKS} select edition, story_id, rank from ranks where rank between 29 and 88")
def tail_stories(spark, d) -> DataFrame:
    """The listed rest after the analysed stories of each edition; editions of fewer stories have none."""
    return stories.tail_stories(_ranking(spark, d)).select("edition", "story_id", "rank")


@query(f"with {MEMBERS}, {_SCORES}, {_RANKS} select edition, 'S' || rank as sid, story_id, cast((rank - 1) // 5 as integer) as batch from ranks where rank <= 28")
def micro_batches(spark, d) -> DataFrame:
    return stories.micro_batches(stories.top_stories(_ranking(spark, d))).select("edition", "sid", "story_id", "batch")


@query(f"with {MEMBERS}, {_SCORES} select count(*) filter (outlet_count >= 3) as major_count, count(*) as total from scores")
def major_count(spark, d) -> DataFrame:
    return stories.story_aggregates(members(spark, d)).agg(F.count_if(F.col("outlet_count") >= 3).alias("major_count"), F.count("*").alias("total"))


def _category_sql() -> str:
    points, hits = [], []
    for name, (strong, weak) in V.CATEGORY_SECTIONS.items():
        some = lambda names: f"max(case when section in ({', '.join(map(repr, names))}) then 1 else 0 end)" if names else "0"
        points.append(f"{V.STRONG_POINTS} * {some(strong)} + {V.WEAK_POINTS} * {some(weak)} as \"s:{name}\"")
        found = []
        for word in map(T.normal_python, V.DEFAULT_KEYWORDS[name]):
            found.append(rf"(case when regexp_matches(text, '(^|[^a-z0-9]){word}(e?s)?($|[^a-z0-9])') then 1 else 0 end)" if word.isascii() else f"(case when contains(text, '{word}') then 1 else 0 end)")
        hits.append(f"round(cast(\"s:{name}\" + {V.KEYWORD_POINTS} * ({' + '.join(found)}) as double), 6)")
    best = "greatest(" + ", ".join(hits) + ")"
    arms = " ".join(f"when {h} = {best} then '{name}'" for h, name in zip(hits, V.CATEGORY_SECTIONS))
    return f"""numbered as (select *, row_number() over (partition by story_id order by ord, article_id) as r from mem),
    texts as (select *, {_normal("titles")} as text from (select story_id, {', '.join(points)}, string_agg(case when r <= {V.KEYWORD_TITLES} then title end, ' ' order by r) as titles from numbered group by story_id)),
    named as (select story_id, case when {best} <= 0 then 'Other' {arms} end as category from texts)"""


@query(f"with {MEMBERS}, {_category_sql()} select story_id, category from named")
def story_categories(spark, d) -> DataFrame:
    return stories.categories(members(spark, d))


@query(f"with {MEMBERS}, {_category_sql()} select category, list_position({_list(V.CATEGORIES)}, category) - 1 as pos, count(*) as n from named group by category")
def category_counts(spark, d) -> DataFrame:
    return stories.category_counts(stories.categories(members(spark, d)))


@query(f"with {MEMBERS}, b as (select source_name, count(*) as n from mem group by 1 order by n desc, source_name limit 8) select source_name, n, cast(round_even(100.0 * n / max(n) over (), 0) as integer) as pct from b")
def busiest_outlets(spark, d) -> DataFrame:
    return stories.busiest_outlets(members(spark, d))


@query(f"with {MEMBERS} select source_name, count(*) over (partition by source_name) as n, story_id, article_id from mem")
def coverage_index(spark, d) -> DataFrame:
    return stories.coverage_index(members(spark, d))


@query(f"with {MEMBERS}, n as (select *, row_number() over (partition by story_id order by ord, article_id) as r from mem) select story_id, string_agg(title, ' ' order by r) as text from n where r <= 6 group by story_id")
def story_texts(spark, d) -> DataFrame:
    return stories.story_texts(members(spark, d))


# ---------------------------------------------------------------- entities and links

_MENTIONS = f"mentions as (select distinct edition, 'S' || story_id as sid, e as entity from (select s.edition, story_id, unnest(list_distinct({_meaningful('title')})) as e from (select mem.story_id, mem.title from mem) join (select story_id, edition from stories) s using (story_id)) where length(e) >= 5)"


def _mentions(spark, d) -> DataFrame:
    rows = members(spark, d).drop("edition").join(table(spark, d, "stories").select("story_id", "edition"), "story_id")
    rows = rows.select("edition", F.concat(F.lit("S"), F.col("story_id")).alias("sid"), F.explode(T.tokens(F.col("title"))).alias("entity"))
    return rows.filter(F.length("entity") >= 5)


@query(f"with {MEMBERS}, {_MENTIONS} select edition, entity, array_to_string(list_sort(list(sid)), ',') as story_ids, count(*) as n from mentions group by edition, entity having count(*) >= 2")
def entity_graph(spark, d) -> DataFrame:
    return entities.entity_graph(_mentions(spark, d))


def _squash(x: str) -> str:
    s = rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\x{{600}}-\x{{6ff}}]', '', 'g'), '([ae])y', '\1i', 'g'), 'ei', 'i', 'g')"
    return f"(select array_to_string(list_filter(l, lambda x, i: i = 1 or l[i - 1] <> x), '') from (select string_split({s}, '') as l))"


@query(f"""with n as (select distinct source_name as entity from articles where source_name is not null union select distinct 'unit ' || name_en from sources),
f as materialized (select entity, {_squash('entity')} as f from n), o as materialized (select distinct {_squash('name_en')} as o from sources)
select entity from f where not exists (select 1 from o where length(o) >= 4 and length(f) >= 4 and (starts_with(o, f) or starts_with(f, o)))""")
def outlet_names_dropped(spark, d) -> DataFrame:
    s = table(spark, d, "sources")
    names = table(spark, d, "articles").select(F.col("source_name").alias("entity")).filter("entity is not null").union(s.select(F.concat(F.lit("unit "), F.col("name_en")))).distinct()
    return entities.not_outlets(names, s.select(F.col("name_en").alias("name"))).select("entity")


_TITLED = "array_to_string(list_transform(string_split(lower(c), ''), lambda ch, i: case when i = 1 or not regexp_matches(lower(c)[i - 1], '[a-z]') then upper(ch) else ch end), '')"


@query(rf"""with {MEMBERS}, {_MENTIONS}, n as (select distinct entity as name from mentions union select name_en from sources union select n_name from nation union select source_name from articles where source_name is not null),
c as (select name, trim(regexp_replace(name, '\s+', ' ', 'g'), ' ') as c from n)
select name, case when c = '' or lower(c) in ('government', 'ministry', 'state', 'council', 'country', 'officials') then null when lower(c) = 'harbour' then 'The Harbour' when regexp_full_match(c, '[\x00-\x7F]*') then {_TITLED} else c end as entity from c""")
def normal_entities(spark, d) -> DataFrame:
    """Canonical names of the entities of all stories, of sources as they are spelled, and of nations."""
    lexicon = V.Lexicon(entities={"harbour": "The Harbour"})
    names = _mentions(spark, d).select(F.col("entity").alias("name")).union(table(spark, d, "sources").select("name_en")).union(table(spark, d, "nation").select("n_name"))
    names = names.union(table(spark, d, "articles").select("source_name").filter("source_name is not null")).distinct()
    return names.select("name", entities.normal_entity(F.col("name"), lexicon).alias("entity"))


@query("with r as (select cast(ts as date) as date, event_type || '/' || user_id as entity from events), c as (select entity, count(distinct date) as days from r group by entity having count(distinct date) >= 2) select entity, days from c order by days desc, entity limit 12")
def recurring_entities(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select(F.to_date("ts").alias("date"), F.concat_ws("/", "event_type", "user_id").alias("entity"))
    return entities.recurring_entities(rows)


_PHRASE = r"' ' || trim(regexp_replace(lower({}), '[^a-z0-9\x{{600}}-\x{{6ff}}]+', ' ', 'g')) || ' '"


@query(f"""with t as materialized (select {_PHRASE.format("coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(body, '')")} as hay from articles),
e as materialized (select distinct e as entity, {_PHRASE.format('e')} as needle from (select n_name as e from nation union select section from articles where section is not null union select 'the ' || section from articles where section is not null))
select entity from e where trim(needle) <> '' and exists (select 1 from t where contains(hay, needle) or contains(hay, regexp_replace(needle, '^ (the|a|an) ', ' ')))""")
def mentioned_entities(spark, d) -> DataFrame:
    a = table(spark, d, "articles")
    sections = a.select("section").filter("section is not null").distinct()
    names = table(spark, d, "nation").select(F.col("n_name").alias("entity")).union(sections).union(sections.select(F.concat(F.lit("the "), "section")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return entities.mentioned(names, a.select(F.concat_ws(" ", empty("title"), empty("summary"), empty("body")).alias("text")))


_LINKS = f"""{MEMBERS},
ordered as (select edition, story_id, lead(story_id) over (partition by edition order by story_id) as next, category from stories),
links as (select case story_id % 4 when 0 then 'Actor' when 1 then 'timeline ' when 2 then 'rumour' else 'pattern' end as type, ' s' || story_id as src, 'S' || case when story_id % 31 = 0 then story_id else next end as dst, case when story_id % 6 = 0 then ' ' else category end as evidence from ordered),
valid as (select lower(trim(type)) as type, upper(trim(src)) as src, upper(trim(dst)) as dst, trim(evidence) as evidence from links
  where lower(trim(type)) in ('same-thread', 'cause-effect', 'actor', 'contradiction', 'pattern', 'timeline') and trim(evidence) <> '' and upper(trim(src)) <> upper(trim(dst))
  and upper(trim(src)) in (select 'S' || story_id from stories) and upper(trim(dst)) in (select 'S' || story_id from stories)),
loose as (select lower(trim(type)) as type, upper(trim(src)) as src, upper(trim(dst)) as dst, trim(evidence) as evidence from links
  where trim(evidence) <> '' and upper(trim(src)) in (select 'S' || story_id from stories) and upper(trim(dst)) in (select 'S' || story_id from stories)),
t as (select 'S' || story_id as sid, title from mem qualify {_PRIMARY})"""


def _links(spark, d) -> tuple[DataFrame, DataFrame]:
    """Links of each story to the next of its edition, some of them faulty, and the ids of all stories."""
    from pyspark.sql import Window as W

    k = F.col("story_id")
    rows = table(spark, d, "stories").select("story_id", "category", F.lead("story_id").over(W.partitionBy("edition").orderBy("story_id")).alias("next"))
    kind = F.when(k % 4 == 0, "Actor").when(k % 4 == 1, "timeline ").when(k % 4 == 2, "rumour").otherwise("pattern")
    raw = rows.select(kind.alias("type"), F.concat(F.lit(" s"), k).alias("src"), F.concat(F.lit("S"), F.when(k % 31 == 0, k).otherwise(F.col("next"))).alias("dst"), F.when(k % 6 == 0, " ").otherwise(F.col("category")).alias("evidence"))
    return raw, table(spark, d, "stories").select(F.concat(F.lit("S"), "story_id").alias("sid"))


def _titled(spark, d) -> DataFrame:
    return stories.primary_of(members(spark, d)).select(F.concat(F.lit("S"), "story_id").alias("sid"), F.col("primary_title").alias("title"))


@query(f"with {_LINKS} select * from valid")
def valid_links(spark, d) -> DataFrame:
    return entities.valid_links(*_links(spark, d))


@query(f"with {_LINKS} select * from loose")
def renderable_links(spark, d) -> DataFrame:
    return entities.valid_links(*_links(spark, d), strict=False)


@query(f"with {_LINKS} select edition, type, count(*) as n, string_agg(src || '>' || dst, ',' order by src || '>' || dst) as edges from valid join (select 'S' || story_id as src, edition from stories) using (src) group by edition, type")
def links_by_type(spark, d) -> DataFrame:
    editions = table(spark, d, "stories").select(F.concat(F.lit("S"), "story_id").alias("src"), "edition")
    return entities.links_by_type(entities.valid_links(*_links(spark, d)).join(editions, "src"), ("edition",))


@query(f"with {_LINKS} select src as sid, type, dst as other from valid union all select dst, type, src from valid")
def links_by_story(spark, d) -> DataFrame:
    return entities.links_by_story(entities.valid_links(*_links(spark, d)))


@query(f"with {_LINKS} select src, coalesce(a.title, src) as src_title, dst, coalesce(b.title, dst) as dst_title, type from valid left join t a on a.sid = src left join t b on b.sid = dst")
def link_titles(spark, d) -> DataFrame:
    return entities.link_titles(entities.valid_links(*_links(spark, d)), _titled(spark, d))


# ---------------------------------------------------------------- memory and caches

_DAYS = "days as (select cast(o_orderdate as date) as date, count(*) as n from orders group by 1)"


def _days(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))


@query(f"with {_DAYS}, old as (select date, n from days where day(date) <> 15), new as (select date, n + 1000 as n from days where day(date) >= 14) select date, n from (select * from old where date not in (select date from new) union all select * from new) order by date desc limit 30")
def memory_upsert(spark, d) -> DataFrame:
    days = _days(spark, d)
    return memory.upsert(days.filter(F.dayofmonth("date") != 15), days.filter(F.dayofmonth("date") >= 14).withColumn("n", F.col("n") + 1000))


@query(f"with {_DAYS} select date, n from days where date <> date '1998-07-30' order by date desc limit 7")
def memory_recall(spark, d) -> DataFrame:
    return memory.recall(_days(spark, d), 7, "1998-07-30")


@query("""with l as (select cast(ts as date) as date, cast(ts as date) || ': ' || count(*) || ' events of ' || count(distinct user_id) || ' users' as line from events group by 1),
s as (select *, sum(length(line) + 1) over (order by date desc) - 1 as size from l) select string_agg(line, chr(10) order by date) as context from s where size <= 600""")
def context_budget(spark, d) -> DataFrame:
    per = table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"))
    return memory.context(per.select("date", F.concat(F.col("date").cast("string"), F.lit(": "), F.col("n"), F.lit(" events of "), F.col("u"), F.lit(" users")).alias("line")), 600)


_CACHE = """
urls as (select story_id, string_agg(url, ',' order by url) as urls from mem group by story_id),
wanted as (select s.story_id, sha1(s.story_key || '|none|rules|en|' || u.urls) as key from stories s join urls u using (story_id)),
cache as (select key, case when story_id % 3 = 0 then '' else 'done' end as payload from wanted where story_id % 2 = 0)"""


def _cache(spark, d) -> tuple[DataFrame, DataFrame]:
    urls = members(spark, d).groupBy("story_id").agg(F.collect_list("url").alias("urls"))
    key = memory.cache_key(F.col("story_key"), F.lit("none"), F.lit("rules"), F.lit("en"), F.col("urls"))
    wanted = table(spark, d, "stories").join(urls, "story_id").select("story_id", key.alias("key"))
    cache = wanted.filter("story_id % 2 = 0").select("key", F.when(F.col("story_id") % 3 == 0, "").otherwise("done").alias("payload"))
    return wanted, cache


@query(f"with {MEMBERS}, {_CACHE} select w.story_id, c.payload from wanted w join cache c using (key) where c.payload <> ''")
def cache_hits(spark, d) -> DataFrame:
    return memory.split_cached(*_cache(spark, d))[0].select("story_id", "payload")


@query(f"with {MEMBERS}, {_CACHE} select story_id, key from wanted where key not in (select key from cache where payload <> '')")
def cache_pending(spark, d) -> DataFrame:
    return memory.split_cached(*_cache(spark, d))[1].select("story_id", "key")


@query("with c as (select o_orderkey as key, o_orderdate as inserted_at from orders) select key from c order by inserted_at desc, key limit 3000")
def cache_trimmed(spark, d) -> DataFrame:
    return memory.trim_cache(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("inserted_at")), 100, 3000).select("key")


@query("""with a as (select upper(trim(id)) as sid, arg_max(v, ord) as v from (select ' s' || story_id as id, story_key as v, 1 as ord from stories where story_id % 2 = 1 union all select 's' || story_id || ' ', category, 2 from stories where story_id % 3 = 1 and category is not null) group by 1)
select 'S' || story_id as sid, coalesce(a.v, story_key) as answer, a.v is null as is_missing from stories left join a on a.sid = 'S' || story_id""")
def answer_join(spark, d) -> DataFrame:
    s = table(spark, d, "stories")
    batch = s.select(F.concat(F.lit("S"), "story_id").alias("sid"), F.col("story_key").alias("own"))
    early = s.filter("story_id % 2 = 1").select(F.concat(F.lit(" s"), "story_id").alias("id"), F.col("story_key").alias("answer"), F.lit(1).alias("ord"))
    late = s.filter("story_id % 3 = 1 and category is not null").select(F.concat(F.lit("s"), "story_id", F.lit(" ")).alias("id"), F.col("category").alias("answer"), F.lit(2).alias("ord"))
    return memory.store_answers(batch, early.union(late), "own", "answer").select("sid", "answer", "is_missing")


# ---------------------------------------------------------------- editions


def _cards(spark, d) -> DataFrame:
    m = members(spark, d)
    return stories.primary_of(m).join(stories.categories(m), "story_id").join(stories.story_aggregates(m).select("story_id", "outlet_count"), "story_id")


@query(f"""with {MEMBERS}, {_category_sql()}, prim as (select story_id, title, summary, source_name from mem qualify {_PRIMARY})
select story_id from prim join named using (story_id) where category = 'Economy & Business' and contains(lower(title || ' ' || summary || ' ' || source_name || ' ' || category), 'survey')""")
def search_filter(spark, d) -> DataFrame:
    cards = _cards(spark, d).join(members(spark, d).select("story_id", F.col("article_id").alias("primary_id"), "title", "summary", F.col("source_name").alias("sources")), ["story_id", "primary_id"])
    return digest.search(cards, "Survey", "Economy & Business").select("story_id")


@query("""with p as (select 'edition-' || o_orderkey as name, cast(o_totalprice as varchar) as content from orders where o_orderkey % 5 <> 0),
w as (select 'edition-' || o_orderkey as name, case when o_orderkey % 7 = 0 then 'x' else cast(o_totalprice as varchar) end as content from orders where o_orderkey % 3 <> 0)
select name, case when p.content is null then 'insert' when w.content is null then 'delete' else 'update' end as change from p full join w using (name) where p.content is distinct from w.content""")
def manifest_changes(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("edition-"), F.col("o_orderkey")).alias("name"), F.col("o_totalprice").cast("string").alias("content"), F.col("o_orderkey").alias("k"))
    wanted = o.filter("k % 3 <> 0").select("name", F.when(F.col("k") % 7 == 0, "x").otherwise(F.col("content")).alias("content"))
    return digest.manifest_changes(o.filter("k % 5 <> 0").select("name", "content"), wanted)


@query("""with p as (select o_orderkey as k, o_orderstatus as v from orders where o_orderkey % 5 <> 0), w as (select o_orderkey as k, o_orderstatus as v from orders where o_orderkey % 3 <> 0)
select *, 'published' as side from (select * from p except all select * from w) union all select *, 'wanted' as side from (select * from w except all select * from p)""")
def stale_rows(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return digest.stale_rows(o.filter("k % 5 <> 0"), o.filter("k % 3 <> 0"))


_OTHERS = f"oth as (select mem.story_id, string_agg(mem.title, '; ' order by mem.ord, mem.article_id) filter (q <= 4) as others from (select mem.*, row_number() over (partition by mem.story_id order by mem.ord, mem.article_id) as q from mem join prim0 using (story_id) where mem.article_id <> prim0.article_id) mem group by mem.story_id)"


@query(f"""with {MEMBERS}, prim0 as (select * from mem qualify {_PRIMARY}), {_OTHERS},
src as (select story_id, string_agg(source_name, ', ' order by o, source_name) as sources, count(*) as outlets from (select story_id, source_name, min(ord) as o from mem group by all) group by story_id),
sec as (select story_id, string_agg(section, ',' order by o, section) as tags from (select *, row_number() over (partition by story_id order by o, section) as k from (select story_id, section, min(ord) as o from mem where section <> '' group by story_id, section)) where k <= 4 group by story_id),
txt as (select story_id, lang, title, coalesce(nullif(body, ''), summary) as t, {_sentences("coalesce(nullif(body, ''), summary)")} as lead from prim0),
cut as (select story_id, lang, title, coalesce(nullif({_truncated("lead", 420)}, ''), title) as short from txt)
select cut.story_id, case when lang = 'en' then title else '' end as headline_en, case when lang = 'ar' then title else '' end as headline_ar, short as summary_en, case when lang = 'ar' then short else '' end as summary_ar,
'low' as confidence, coalesce(tags, '') as tags, 'Carried by ' || outlets || ' outlet(s): ' || sources || '.' as why_it_matters_en, coalesce('Also: ' || others, '') as between_the_lines_en
from cut join src using (story_id) left join sec using (story_id) left join oth using (story_id)""")
def extractive_analyses(spark, d) -> DataFrame:
    rows = digest.extractive_analysis(members(spark, d))
    return rows.select("story_id", "headline_en", "headline_ar", "summary_en", "summary_ar", "confidence", F.array_join("tags", ",").alias("tags"), "why_it_matters_en", "between_the_lines_en")


@query()
def extractive_synthesis(spark, d) -> DataFrame:
    m = members(spark, d)
    names = _mentions(spark, d).groupBy(F.substring("sid", 2, 20).try_cast("bigint").alias("story_id")).agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    rows = _ranking(spark, d).join(stories.primary_of(m).select("story_id", F.col("primary_title").alias("title")), "story_id").join(names, "story_id", "left")
    return digest.extractive_synthesis(rows.select("edition", "rank", "title", "outlet_count", F.coalesce("entities", F.array().cast("array<string>")).alias("entities")))


@query()
def edition_json(spark, d) -> DataFrame:
    s = table(spark, d, "stories").select("edition", "story_id", "story_key", "score", F.coalesce("category", F.lit("Other")).alias("category"), "outlet_count")
    return digest.edition_json(s, members(spark, d))


@query()
def edition_markdown(spark, d) -> DataFrame:
    m = members(spark, d)
    rows = _ranking(spark, d).join(stories.primary_of(m).select("story_id", F.col("primary_title").alias("title")), "story_id").join(stories.categories(m), "story_id")
    return digest.edition_markdown(rows.select("edition", "rank", "title", "outlet_count", "category"))


# ---------------------------------------------------------------- markup, feeds, streams


def _pages(spark, d) -> DataFrame:
    """A list page of each source, with links to its articles, and a page of each article."""
    a = articles(spark, d).filter("title <> ''")
    item = F.concat(F.lit('<li><a href="'), T.escape_html(F.col("url")), F.lit('">'), T.escape_html(F.col("title")), F.lit("</a></li>"))
    return a.select("article_id", "source_id", "url", F.concat(F.lit("<html><head><title>x</title><script>var a='<p>no</p>'</script></head><body><nav><a href='/'>Home</a></nav><ul>"), item, F.lit("</ul><article><p>"), F.regexp_replace(T.escape_html(F.col("body")), "\n", "</p><p>"), F.lit("</p></article></body></html>")).alias("html"))


@query()
def html_texts(spark, d) -> DataFrame:
    from storyloom.functions.markup import html_to_text

    return _pages(spark, d).select("article_id", html_to_text("html").alias("text"))


@query(rf"with {ARTICLES}, t as (select article_id, url, trim(regexp_replace(title, '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g'), ' ') as text from art where title <> '') select * from t where regexp_matches(url, '{U.ARTICLE_URL}') and length(text) >= 18")
def html_links(spark, d) -> DataFrame:
    from storyloom.functions.markup import html_links as links

    rows = _pages(spark, d).select("article_id", F.explode(links("html", "url")).alias("l"))
    return rows.select("article_id", "l.url", "l.text").filter(U.is_article_url(F.col("url")) & (F.length("text") >= 18))


@query()
def html_bodies(spark, d) -> DataFrame:
    from storyloom.functions.markup import html_article

    return _pages(spark, d).select("article_id", html_article("html").alias("body"))


@query()
def feed_entries(spark, d) -> DataFrame:
    """Entries of RSS documents made of the articles, read back."""
    from storyloom.functions.markup import parse_feed

    a = table(spark, d, "articles").filter("title is not null and url is not null and source_id is not null")
    item = F.concat(F.lit("<item><title>"), T.escape_html(F.col("title")), F.lit("</title><link>"), T.escape_html(F.col("url")), F.lit("</link><pubDate>"), T.escape_html(F.col("published")), F.lit("</pubDate></item>"))
    feeds = a.select("article_id", "source_id", "url", F.concat(F.lit("<?xml version='1.0'?><rss><channel>"), item, F.lit("</channel></rss>")).alias("xml"))
    return feeds.select("article_id", F.explode(parse_feed("xml", "url")).alias("e")).select("article_id", "e.title", "e.url", "e.published")


@query("""select event_id, '{"k": ' || json_extract_string(props, '$.k') || '}' as json from events""")
def json_recovered(spark, d) -> DataFrame:
    from storyloom.functions.markup import recover_json

    e = table(spark, d, "events").select("event_id", F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" done")).alias("answer"))
    return e.select("event_id", recover_json("answer").alias("json"))


@query("select event_type, user_id, count(*) as n from (select distinct event_type, user_id, value from events) group by all")
def stream_dedup(spark, d) -> DataFrame:
    """Events as a stream: the first of each (type, user, value) within the watermark, counted; the table spans less than the delay."""
    import uuid

    from storyloom.operators.memory import remove_folder
    from storyloom.session import checkpoint, shared_folder
    from storyloom.streaming import ingest as S

    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    timed, _ = S.with_event_time(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "40 days")
    S.run_available(S.first_within_watermark(timed, ["event_type", "user_id", "value"]), f"{out}/data", f"{out}/checkpoint")
    counts = checkpoint(spark.read.parquet(f"{out}/data").groupBy("event_type", "user_id").agg(F.count("*").alias("n")))
    remove_folder(spark, out)
    return counts


@query(f"with {MEMBERS}, {_MENTIONS}, g as (select edition, entity, string_agg(sid, ',' order by sid) as ids, count(*) as n from mentions group by edition, entity having count(*) >= 2) select edition, string_agg(entity || ': ' || ids, chr(10) order by -n, entity) as entities from g group by edition")
def entity_context(spark, d) -> DataFrame:
    """The entity graph of each edition as text for a prompt."""
    from storyloom.operators.enrich import link_context

    none = spark.createDataFrame([], "edition date, type string, src string, dst string, evidence string")
    return link_context(entities.entity_graph(_mentions(spark, d)), none)[0]


@query(f"with {_LINKS}, e as (select 'S' || story_id as src, edition from stories) select edition, string_agg(src || '>' || dst || ' (' || type || ') ' || evidence, chr(10) order by src, dst, type) as links from valid join e using (src) group by edition")
def link_context(spark, d) -> DataFrame:
    """The links of each edition as text for a prompt."""
    from storyloom.operators import enrich

    editions = table(spark, d, "stories").select(F.concat(F.lit("S"), "story_id").alias("src"), "edition")
    none = spark.createDataFrame([], "edition date, entity string, story_ids string, n bigint")
    return enrich.link_context(none, entities.valid_links(*_links(spark, d)).join(editions, "src"))[1]


# ---------------------------------------------------------------- times and lists


@query(f"""with {ARTICLES}, t as (select article_id, published, greatest({RUN_SECONDS} - cast(floor(epoch(published)) as bigint), 0) as s, cast(floor(epoch(published)) as bigint) + 10800 as l from art)
select article_id, case when published is null then 'time unknown' else strftime(make_timestamp(l * 1000000), '%Y-%m-%d %H:%M') end as local,
case when published is null then 'time unknown' when s < 3600 then (s // 60) || 'm ago' when s < 86400 then (s // 3600) || 'h ago' else (s // 86400) || 'd ago' end as age from t""")
def article_times(spark, d) -> DataFrame:
    return articles(spark, d).select("article_id", D.local_text(F.col("published")).alias("local"), D.age_text(F.col("published"), F.lit(RUN)).alias("age"))


@query("select distinct edition, strftime(edition, '%A ') || day(edition) || strftime(edition, ' %B %Y') as heading from stories where edition is not null")
def edition_headings(spark, d) -> DataFrame:
    return table(spark, d, "stories").select("edition").filter("edition is not null").distinct().select("edition", D.long_date(F.col("edition")).alias("heading"))


@query("""with u as (select source_id, ord, trim(section) as section from (select source_id, feed_ord as ord, section from feeds union all select source_id, feed_ord + 100, upper(section) from feeds) where trim(section) <> ''),
f as (select source_id, section, ord from u qualify row_number() over (partition by source_id, lower(section) order by ord) = 1)
select source_id, string_agg(section, ',' order by ord) as sections from f group by source_id""")
def feed_sections(spark, d) -> DataFrame:
    f = table(spark, d, "feeds").select("source_id", F.col("feed_ord").alias("ord"), "section")
    both = f.union(f.select("source_id", F.col("ord") + 100, F.upper("section")))
    lists = both.filter("trim(section) <> ''").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section"))), lambda x: x["section"]).alias("all"))
    return lists.select("source_id", F.array_join(digest.distinct_ignoring_case(F.col("all")), ",").alias("sections"))


# ---------------------------------------------------------------- a whole run

_RUN_OPTIONS = edition.RunOptions(run=RUN, threading="graph", compatibility=False, fetch_bodies=False)
# the run's articles under the names of the views, then its stories as members
_RUN_ARTICLES = ARTICLES.replace("art as (", "art0 as (") + f""",
once as (select * from art0 where source_id in (select source_id from sources where is_enabled) qualify row_number() over (partition by source_id, split_part(url, '?', 1) order by feed_ord nulls first, item_ord nulls first, article_id) = 1),
newest as (select * from once qualify row_number() over (partition by source_id order by published desc nulls first, article_id) <= 120),
art as (select * replace (date '2026-06-30' as edition) from newest where published is null or floor(epoch(published)) >= {RUN_SECONDS} - 26 * 3600)"""
_RUN_MEMBERS = f"""{_RUN_ARTICLES}, {TOKENS}, pairs as (select a.article_id as src, b.article_id as dst from tok a join tok b on a.article_id < b.article_id where {_SCORE} >= 0.5 and len(list_intersect(a.dist, b.dist)) >= 2 and not {_VETO}), both_ways as (select src, dst from pairs union all select dst, src from pairs),
walk as (select article_id, article_id as other from tok union select w.article_id, e.dst from walk w join both_ways e on e.src = w.other),
lab as (select article_id, min(other) as story_id from walk group by article_id),
mem as (select * from (select story_id, row_number() over (partition by story_id order by published desc nulls first, article_id) as ord, art.* from lab join art using (article_id)) qualify row_number() over (partition by story_id, url order by ord, article_id) = 1)"""
_RUN_RANKS = f"{_SCORES}, {_category_sql()}, ranked as (select story_id, cast(row_number() over (order by score desc, outlet_count desc, story_id) as integer) as rank, cast(score as double) as score, outlet_count, category from scores join named using (story_id))"


def _run_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    from storyloom.session import checkpoint

    kept = checkpoint(edition.in_window(articles(spark, d), table(spark, d, "sources"), _RUN_OPTIONS))
    return kept, edition.rank_stories(checkpoint(edition.build_stories(kept, _RUN_OPTIONS)), _RUN_OPTIONS)


@query(f"with recursive {_RUN_MEMBERS}, {_RUN_RANKS} select * from ranked")
def run_edition_stories(spark, d) -> DataFrame:
    """The stories of one run: window, addresses, caps, threading, scores, categories, ranks."""
    return _run_tables(spark, d)[1]


@query(f"""with recursive {_RUN_MEMBERS}, {_RUN_RANKS} select (select count(*) from art) as total_articles, (select count(distinct source_id) from art) as outlets_reporting, count(*) as total_stories, count(*) filter (outlet_count >= 3) as major_stories,
least(count(*), 28) as analysed_stories, {RUN_SECONDS - 26 * 3600}::bigint as window_start_s, {RUN_SECONDS}::bigint as window_end_s from ranked""")
def run_edition_stats(spark, d) -> DataFrame:
    return edition.run_stats(*_run_tables(spark, d), _RUN_OPTIONS)


@query(f"with {MEMBERS} select story_id, article_id from mem qualify row_number() over (partition by story_id, url order by ord, article_id) = 1")
def unique_story_members(spark, d) -> DataFrame:
    return stories.unique_members(members(spark, d)).select("story_id", "article_id")


@query(f"with {MEMBERS} select story_id, article_id, row_number() over (partition by story_id order by coalesce(tier, 2), source_name nulls first, title nulls first, article_id) as pos from mem")
def reference_lists(spark, d) -> DataFrame:
    return digest.reference_order(members(spark, d), "story_id").select("story_id", "article_id", "pos")
