import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from storyloom.llm import repeated_lines as R
from storyloom.llm import survivors as S

ARTICLE = "article_id bigint, source_id string, title string, summary string, body string, published string, fetched_at timestamp, tier int, line_no string, url string"


def article(i, source="a", body=None, published=None, tier=None):
    return (i, source, None, None, body, published, None, tier, "clash", "u")


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("a", "Asia/Kuwait")], "source_id string, time_zone string")


def test_survivors(spark, sources):
    rows = [article(1, body=" x ", tier=2), article(2, body="yy", tier=None, published="2026-01-01"), article(3, body="yy", tier=2, published="2025-12-31T21:00:00.9Z"), article(4, body="  "), article(5), article(6, tier=1), article(3, body="yy", tier=2, published="2025-12-31T21:00:00.9Z")]
    a = spark.createDataFrame(rows, ARTICLE)
    pairs = [(1, 1), (1, 2), (1, 3), (1, 3), (2, 4), (2, 5), (3, 6), (3, 6), (4, 6), (4, 99), (None, 1), (5, None)]
    m = spark.createDataFrame([(s, x, 0) for s, x in pairs], "story_id bigint, article_id bigint, tier int")
    got = {tuple(r) for r in S.survivors_found(m, a, sources).collect()}
    assert got == {(1, "record", 3), (1, "body", 2), (1, "published", 2), (2, "record", 4)}
    assert S.survivors_found(m.limit(0), a, sources).count() == S.survivors_found(m, a.limit(0), sources).count() == 0
    record = S.survivor_records(m, a, sources).filter("story_id = 1").collect()[0]
    assert (record["record"], record["body_text"]) == (3, "yy")


def test_one_story_holds_most_rows(spark, sources):
    a = spark.createDataFrame([article(i, body="b" * (i % 50)) for i in range(3000)], ARTICLE)
    m = spark.createDataFrame([(1 if i < 2000 else i // 2, i) for i in range(3000)], "story_id bigint, article_id bigint")
    got = {(r[0], r[1]): r[2] for r in S.survivors_found(m, a, sources).collect()}
    assert got[1, "body"] == 49 and len({k[0] for k in got}) == 501


def brute(rows, least=5, share=0.02):
    import re

    norm = lambda x: re.sub(r"\s+", " ", re.sub(r"[0-9٠-٩]+", "0", x.lower())).strip()
    bodies = {(s, i): b for i, s, _, _, b, *_ in rows if b and b.strip()}
    count, total, out = defaultdict(set), defaultdict(set), set()
    for (s, i), b in bodies.items():
        total[s].add(i)
        for line in b.split("\n"):
            count[s, norm(line)].add(i)
    for (s, i), b in bodies.items():
        for k, line in enumerate(b.split("\n"), 1):
            n = len(count[s, norm(line)])
            if norm(line) and n >= least and n >= share * len(total[s]):
                out.add((i, k))
    return out


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(700):
        lines = [rng.choice(["Share  12", "share 9 ", "شارك ٣", "", "  ", " Legal note"]) if rng.random() < 0.03 else f"text {rng.randrange(400)} {'abc'[i % 3]}{rng.randrange(60)}x" for _ in range(rng.randint(1, 6))]
        rows.append(article(i, rng.choice("aaab"), "\n".join(lines)))
    rows += [article(1000 + i, "a", "same\nsame\ntext") for i in range(12)] + [article(2000, "a", None), article(2001, "a", " \n "), article(2002, None, "x"), article(None, "a", "x"), rows[0]]
    frame = spark.createDataFrame(rows, ARTICLE)
    got = {tuple(r) for r in R.repeated_lines_found(frame).collect()}
    assert got == brute([r for r in rows if r[0] is not None and r[1] is not None]) and got
    assert R.repeated_lines_found(frame.limit(0)).count() == 0


def test_republished_articles_are_no_boilerplate(spark, sources):
    """One press release, carried by a source twelve times over many days with changing frames, stays; what frames all articles goes."""
    rng = random.Random(5)
    release = ["The harbour office announced a new timetable for all its ferries.", "It will hold from the first of May, a spokesman said on Monday.", "Tickets are sold at the old prices until then."]
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    rows = []
    for i in range(60):
        own = release if i < 12 else [f"Own text {word()} of an article about {word()} things in the town.", f"And a second line, {word()}."]
        rows.append(article(i, "a", "\n".join([f"Share {i}", *own, "Legal note of the paper, all rights reserved by its owner and by nobody else.", *(["By our desk"] if i % 2 else [])]), f"2026-01-{i % 28 + 1:02d}"))
    rows += [article(100, "a", None), article(101, "a", " \n "), article(102, None, "x"), article(103, "b", "only")]
    frame = spark.createDataFrame(rows, ARTICLE)
    clean = {r["article_id"]: r for r in R.bodies_without_repeated_lines(frame, sources).collect()}
    assert all(clean[i]["body"] == "\n".join(release) for i in range(12))
    assert all("Legal" not in clean[i]["body"] and "Own text" in clean[i]["body"] for i in range(12, 60))
    assert clean[100]["body"] is None and clean[101]["body"] == " \n " and clean[103]["n_removed"] == 0
    # by articles alone the release counts as repeated
    assert (0, 2) in {tuple(r) for r in R.repeated_lines_found(frame).collect()}
    # lines of one day are no boilerplate of the source
    same_day = frame.withColumn("published", F.lit("2026-01-01"))
    assert R.boilerplate_lines(same_day, sources).count() == 0
    assert R.bodies_without_repeated_lines(frame.limit(0), sources).count() == 0
