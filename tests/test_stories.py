import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from storyloom.functions.text import normal_python, stem_word
from storyloom.operators import clustering, digest, similarity, stories
from storyloom.plans import reference
from storyloom.vocab.words import GENERIC, NUMBER_WORDS, STOPWORDS, Lexicon

STOP = {*STOPWORDS, *map(stem_word, STOPWORDS)}
COMMON = {*GENERIC, *map(stem_word, GENERIC)}


def tokens(title):
    words = {stem_word(NUMBER_WORDS.get(w, w)) for w in normal_python(title).split()}
    return {w for w in words if w not in STOP and (len(w) > 1 or w.isdigit())}


def headline(lang, title, url=None):
    return clustering.Headline(frozenset(tokens(title)), frozenset(tokens(title) - COMMON), lang, url)


def threads(titles):
    return [sorted(c) for c in clustering.thread([headline(*t) for t in titles])]


def test_merges_and_vetoes():
    assert threads([("en", "Fire destroys harbour warehouse in Qasvek"), ("en", "Harbour warehouse in Qasvek destroyed by fire"), ("en", "Gold prices climb")]) == [[0, 1], [2]]
    assert threads([("en", "Oil prices rise again"), ("en", "Gold prices rise again")]) in ([[0], [1]], [[0, 1]])
    for a, b in (("One killed in Qasvek tunnel blaze", "Two killed in Qasvek tunnel blaze"), ("Three injured in Qasvek tunnel blaze", "Nine injured in Qasvek tunnel blaze"), ("Guard killed in Qasvek tunnel blaze", "Guard injured in Qasvek tunnel blaze")):
        assert threads([("en", a), ("en", b)]) == [[0], [1]]
    assert threads([("en", "Two killed in Qasvek tunnel blaze"), ("en", "Blaze in Qasvek tunnel: two killed")]) == [[0, 1]]


def words(text, lang):
    return clustering.Headline(frozenset(text.split()), frozenset(text.split()), lang)


def test_bridge_joins_languages_only():
    a, b, far = words("qasvek harbour 12", "ar"), words("qasvek harbour fire ship 12", "en"), words("x y", "en")
    assert [sorted(c) for c in clustering.thread([a, b, far], threshold=0.9999)] == [[0, 1], [2]]
    assert threads([("ar", "ميناء قصفيك يفتح"), ("en", "Qasvek harbour opens")]) == [[0], [1]]
    # one shared word is not enough, and one language never bridges
    assert [sorted(c) for c in clustering.thread([a, words("qasvek fire ship", "en")])] == [[0], [1]]
    assert [sorted(c) for c in clustering.thread([words("a b c d e f g", "en"), words("a b x y z v w", "en")])] == [[0], [1]]
    # all that fit are folded into the best of them
    many = [words("a b c d e f g h", "ar"), words("a b i j k", "en"), words("c d e l m n o p", "fr")]
    assert [sorted(c) for c in clustering.thread(many)] == [[0, 1, 2]]


def test_articles_of_one_address_count_once():
    rows = [("en", "Fire destroys harbour warehouse in Qasvek", "u1"), ("en", "Harbour warehouse in Qasvek destroyed by fire", "u1"), ("en", "Qasvek harbour warehouse fire", "u2")]
    assert threads(rows) == [[0, 2]]


def test_shared_boilerplate_and_single_anchors_stay_apart():
    assert threads([("en", "Kuwait oil price rises to nine florins a barrel"), ("en", "Kuwait gold price falls ahead of harbour data")]) == [[0], [1]]
    assert threads([("en", "Two killed in blaze at Qasvek mill"), ("en", "Blaze at Qasvek mill put out")]) == [[0, 1]]


def test_every_article_once():
    rng = random.Random(2)
    items = [words(" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(rng.randint(1, 6))), rng.choice(["ar", "en"])) for _ in range(200)]
    assert sorted(itertools.chain(*clustering.thread(items))) == list(range(200))


def _titles(spark):
    rng = random.Random(4)
    words = "harbour pearl tunnel museum ferry tribunal silo camel dust cable falcon quay lantern".split()
    rows = [(dt.date(2026, 1, 1 + i % 3), i, rng.choice(["ar", "en"]), " ".join(rng.sample(words, rng.randint(0, 7)))) for i in range(120)]
    return spark.createDataFrame(rows, "edition date, article_id bigint, lang string, title string"), rows


def test_edges_equal_brute_force(spark):
    frame, rows = _titles(spark)
    classes, membership = similarity.headline_classes(similarity.tokenised(frame))
    of = {r["article_id"]: r["class_id"] for r in membership.collect()}
    got = {(r["src"], r["dst"]): r["score"] for r in similarity.same_story_edges(classes).collect()}
    want = {}
    for (e, a, k, s), (f, b, l, t) in itertools.combinations(rows, 2):
        x, y = tokens(s), tokens(t)
        if e == f and x and y and len(x & y) / min(len(x), len(y)) >= 0.5 and len((x & y) - COMMON) >= 2:
            if of[a] == of[b]:
                assert x == y and k == l
            else:
                want[tuple(sorted((of[a], of[b])))] = round(len(x & y) / min(len(x), len(y)), 6)
    assert got == want and want and set(of) == {a for _, a, _, s in rows if tokens(s)}


def test_copies_are_one_class(spark):
    """A line carried a hundred thousand times gives no pairs of copies."""
    wire = spark.range(100_000).select(F.lit(dt.date(2026, 1, 1)).alias("edition"), F.col("id").alias("article_id"), F.lit("en").alias("lang"), F.lit("Harbour ferry collides with pearl silo").alias("title"))
    other = spark.createDataFrame([(dt.date(2026, 1, 1), 200_000, "en", "Ferry collides with silo at harbour"), (dt.date(2026, 1, 1), 200_001, "en", "Rain"), (dt.date(2026, 1, 1), 200_002, "en", "Rain")], wire.schema)
    classes, membership = similarity.headline_classes(similarity.tokenised(wire.union(other)))
    edges = similarity.same_story_edges(classes)
    assert classes.count() == 3 and edges.count() == 1
    found = clustering.graph_stories(classes, membership, edges)
    sizes = sorted(r["count"] for r in found.groupBy("story_id").count().collect())
    assert sizes == [1, 1, 100_001]


def test_copies_without_an_edition_are_not_linked(spark, small, tmp_path):
    """As in the SQL, articles without a fetch time are of no day, and nothing of theirs is one story."""
    import duckdb

    some = spark.read.parquet(f"{small}/articles.parquet").filter("fetched_at is not null").limit(1)
    copies = some.crossJoin(spark.range(4)).withColumn("article_id", F.col("id")).withColumn("title", F.lit("Harbour ferry collides with pearl silo"))
    rows = copies.withColumn("fetched_at", F.when(F.col("id") < 2, F.col("fetched_at"))).drop("id")
    rows.write.parquet(f"{tmp_path}/articles.parquet")
    got = {tuple(r) for r in reference.stories_graph(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"create view articles as select * from '{tmp_path}/articles.parquet/*.parquet'")
    assert got == set(db.execute(reference.SQL["stories_graph"]).fetchall()) == {(0, 0), (1, 0), (2, 2), (3, 3)}


def test_best_pair_equals_brute_force(spark):
    rng = random.Random(8)
    groups = {g: [frozenset(rng.sample("abcdefghijklmnopqrst", rng.randint(0, 5 if g % 2 else 9))) for _ in range(rng.randint(1, 6))] for g in range(60)}
    rows = [(g, i, sorted(s)) for g, sets in groups.items() for i, s in enumerate(sets)]
    got = {r["edition"]: round(r["best"], 6) for r in similarity.best_pair(spark.createDataFrame(rows, "edition int, article_id int, toks array<string>")).collect()}
    score = lambda a, b: max(len(a & b) / len(a | b), 0.9 * len(a & b) / min(len(a), len(b))) if a and b else 0.0
    assert got == {g: round(max(score(a, b) for a, b in itertools.combinations(sets, 2)), 6) for g, sets in groups.items() if len(sets) > 1}


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    nodes = spark.createDataFrame([(i,) for i in range(150)], "article_id bigint")
    got = {r["article_id"]: r["story_id"] for r in clustering.components(nodes, spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in range(150)}


def test_components_take_few_jobs(spark):
    """The driver's memory grows with every job: a long chain is put together without rounds of joins, or in a few where it does not fit one task."""
    n = 3000
    order = list(range(n))
    random.Random(7).shuffle(order)
    # a chain in shuffled order, a star whose centre is its largest id, an id without edges
    edges = [*zip(order, order[1:]), *((n + i, n + 500) for i in range(500))]
    nodes = spark.range(n + 502).withColumnRenamed("id", "article_id")
    want = {i: 0 if i < n else n if i <= n + 500 else i for i in range(n + 502)}
    frame = spark.createDataFrame(edges, "src bigint, dst bigint").repartition(7)
    tracker = spark.sparkContext.statusTracker()
    for most, jobs in ((clustering.ONE_TASK, 12), (40, 90)):
        spark.sparkContext.setJobGroup(f"components {most}", "")
        got = {r["article_id"]: r["story_id"] for r in clustering.components(nodes, frame, one_task=most).collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == want and 0 < len(tracker.getJobIdsForGroup(f"components {most}")) <= jobs


MEMBER = "story_id bigint, ord int, article_id bigint, source_id string, source_name string, lang string, title string, url string, section string, summary string, body string, published timestamp, tier int"


def test_aggregates_with_nulls(spark):
    when = dt.datetime(2026, 1, 1, 8)
    rows = [
        (1, 0, 10, "a", "A", "en", "Council meets", "u1", "sport", "s", "body text", when, 2),
        (1, 1, 11, "a", "A", "ar", "Council", "u1", None, "", "", None, None),
        (1, 2, 12, "b", "B", "ar", None, "u2", "", None, None, when, 1),
        (2, 0, 13, None, None, None, None, None, None, None, None, None, None),
    ]
    m = spark.createDataFrame(rows, MEMBER)
    agg = {r["story_id"]: r for r in stories.story_aggregates(m).collect()}
    assert (agg[1]["outlet_count"], agg[1]["langs"], agg[2]["outlet_count"]) == (2, "ar,en", 0)
    assert {r["story_id"]: r["primary_id"] for r in stories.primary_of(m).collect()} == {1: 12, 2: 13}
    assert stories.unique_members(m).count() == 3
    assert {r["category"] for r in stories.categories(m).collect()} == {"Sport", "Other"}
    scores = {r["story_id"]: r["score"] for r in stories.story_scores(m, when).collect()}
    assert scores[1] == round(2 * 0.5 + 1.5 * 0.15 + 3 + 2.6 + 2.0 + 0 + 1.5, 6)
    assert stories.story_aggregates(m.limit(0)).count() == 0


def test_exact_stories_run_on_editions(spark):
    frame, rows = _titles(spark)
    times = frame.select("article_id", F.lit(None).cast("timestamp").alias("published"), F.col("article_id").alias("pos"), F.lit(None).cast("string").alias("url"))
    got = clustering.exact_stories(similarity.tokenised(frame, Lexicon()), times).collect()
    assert len({r["article_id"] for r in got}) == len(got) == sum(bool(tokens(t)) for *_, t in rows)


def test_synthesis_of_every_edition(spark):
    rows = [("2026-01-01", 2, "b", 1, ["Water", "x"]), ("2026-01-01", 1, "a", 3, ["water", "y", " "]), ("2026-01-02", 1, "c", 4, []), (None, 1, "d", 1, [f"e{i}" for i in range(9)])]
    frame = spark.createDataFrame(rows, "edition string, rank int, title string, outlet_count int, entities array<string>")
    got = {r["edition"]: (r["editor_note_en"], r["story_of_the_day"], r["entities"]) for r in digest.extractive_synthesis(frame).collect()}
    note = "{} stories, {} carried by three outlets or more."
    assert got == {"2026-01-01": (note.format(2, 1), "a", "Water, x, y"), "2026-01-02": (note.format(1, 1), "c", ""), None: (note.format(1, 0), "d", "e0, e1, e2, e3, e4, e5, e6, e7")}


def test_synthesis_query_covers_the_editions_of_the_markdown(spark, small):
    editions = lambda q: sorted(repr(r[0]) for r in q(spark, small).select("edition").collect())
    assert editions(reference.extractive_synthesis) == editions(reference.edition_markdown)


def test_categories(spark):
    """Written by hand: sections count once for a story, keywords of every language are normal forms."""
    member = lambda story, ord_, title, section: (story, ord_, 100 * story + ord_, "a", "A", "en", title, f"u{ord_}", section, "", "", None, 1)
    rows = [
        *[member(1, i, "Rain today", "local") for i in range(6)], member(1, 6, "Rain today", "sport"),  # 0.4 once against 1.5
        member(2, 0, "حكم من محكمة في قصفيك", None), member(3, 0, "إدارة جديدة", ""), member(4, 0, "مكتبة ليلية", "x"),
        member(5, 0, "Council and museum", "culture"), member(6, 0, "Councils", None), member(7, 0, "councilman speaks", None),
        member(8, 0, "Rain", "front-page"), member(8, 1, "Rain", "opinion"), member(9, 0, None, None),
        *[member(10, i, "Rain", None) for i in range(6)], member(10, 6, "museum", None),
        member(11, 0, "Coast", None), member(11, 1, "guard", None),
    ]
    got = {r["story_id"]: r["category"] for r in stories.categories(spark.createDataFrame(rows, MEMBER)).collect()}
    assert got == {
        1: "Sport", 2: "Security & Courts", 3: "Government & Politics", 4: "Culture & Entertainment", 5: "Culture & Entertainment", 6: "Government & Politics",
        7: "Other", 8: "Government & Politics", 9: "Other", 10: "Other", 11: "Security & Courts",
    }


def test_one_story_holds_most_rows(spark):
    rows = [(1 if i % 3 else i, i, i, f"s{i % 40}", f"S{i % 40}", "en", f"Ferry {i} delayed", f"u{i}", "sport" if i % 7 else "local", "", "", None, i % 3 + 1) for i in range(6000)]
    m = spark.createDataFrame(rows, MEMBER)
    score = stories.story_scores(m, dt.datetime(2026, 1, 1)).filter("story_id = 1").collect()[0]
    assert score["outlet_count"] == 40
    assert stories.categories(m).filter("story_id = 1").collect()[0]["category"] == "Sport"


def test_extractive_analysis(spark):
    m = spark.createDataFrame([(1, 0, 10, "a", "A", "en", "Head", "u1", "sport", "", "One. Two! Three? Four.", None, 1), (1, 1, 11, "b", "B", "ar", "عنوان", "u2", "local", "s", "", None, 2), (2, 0, 12, "a", "A", "ar", "عنوان", "u3", "", None, None, None, 1)], MEMBER)
    got = {r["story_id"]: r for r in digest.extractive_analysis(m).collect()}
    assert (got[1]["headline_en"], got[1]["headline_ar"], got[1]["summary_en"], got[1]["summary_ar"]) == ("Head", "", "One. Two! Three?", "")
    assert (got[1]["confidence"], got[1]["tags"], got[1]["between_the_lines_en"]) == ("low", ["sport", "local"], "Also: عنوان")
    assert (got[2]["summary_en"], got[2]["summary_ar"], got[2]["tags"]) == ("عنوان", "عنوان", [])
