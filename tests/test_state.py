import datetime as dt
import json

from pyspark.sql import functions as F

from storyloom.operators import entities, ingest, memory
from storyloom.operators.enrich import Breaker, Deadline, Engine, Pacer, candidates, retry_after
from storyloom.sources import sinks
from storyloom.streaming import ingest as S


def test_upsert_is_idempotent_and_bounded(spark):
    old = spark.createDataFrame([(f"2026-01-{i:02d}", i) for i in range(1, 31)], "date string, n int")
    fresh = spark.createDataFrame([("2026-01-30", 99), ("2026-02-01", 100), (None, 1)], "date string, n int")
    once = memory.upsert(old, fresh)
    twice = memory.upsert(once, fresh)
    assert once.count() == 30 and {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()}
    assert once.filter("date = '2026-01-30'").collect()[0]["n"] == 99 and once.filter("date = '2026-01-01'").count() == 0
    assert memory.recall(once, 2, "2026-02-01").count() == 2


def test_one_of_several_records_of_a_date_is_the_same_always(spark):
    old = spark.createDataFrame([], "date string, n int")
    for order in ([1, 3, 2], [3, 2, 1]):
        assert [r["n"] for r in memory.upsert(old, spark.createDataFrame([("2026-01-01", n) for n in order], "date string, n int")).collect()] == [3]


def test_truthy(spark):
    rows = spark.createDataFrame([("1", " ", 0, [], "kept"), ("2", "x", 4, ["a"], "kept")], "date string, note string, n int, names array<string>, other string")
    assert [tuple(r) for r in memory.truthy(rows, ["note", "n", "names"]).orderBy("date").collect()] == [("1", None, None, None), ("2", "x", 4, ["a"])]


def test_a_writer_that_died_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    memory.replace_table(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert memory.read_state(spark, path).count() == 3
    memory.replace_table(memory.read_state(spark, path), path)
    assert memory.read_state(spark, path).count() == 3 and not (tmp_path / "t.old").exists()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("junk")
    assert memory.load_cache(spark, str(tmp_path / "bad"), "key string").count() == memory.load_cache(spark, str(tmp_path / "none"), "key string").count() == 0


def test_replace_table_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    memory.replace_table(spark.range(3), path)
    memory.replace_table(spark.read.parquet(path).withColumn("id", F.col("id") + 1), path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_context_and_jsonl(spark, tmp_path):
    lines = spark.createDataFrame([("1", "old  line"), ("2", "mid"), ("3", "new"), ("4", "")], "date string, line string")
    assert memory.context(lines, 7).collect()[0]["context"] == "mid\nnew"
    f = tmp_path / "m.jsonl"
    f.write_text('{"date":"2026-01-01","n":1}\n{broken\n\n{"n":2}\n')
    assert memory.load_jsonl(spark, str(f), "date string, n int").count() == 1
    assert memory.load_jsonl(spark, str(tmp_path / "none"), "date string, n int").count() == 0


def test_links(spark):
    ids = spark.createDataFrame([("S1",), ("S2",)], "sid string")
    raw = spark.createDataFrame([("Actor", "s1", "S2", "x"), ("actor", "S1", "S1", "x"), ("odd", "S1", "S2", "x"), ("actor", "S1", "S9", "x"), ("actor", "S1", "S2", " "), (None, None, None, None)], "type string, src string, dst string, evidence string")
    assert [tuple(r) for r in entities.valid_links(raw, ids).collect()] == [("actor", "S1", "S2", "x")]
    assert entities.valid_links(raw, ids, strict=False).count() == 3
    assert entities.links_by_story(entities.valid_links(raw, ids)).count() == 2


def test_outlet_names(spark):
    names = spark.createDataFrame([("Harbour Ledger",), ("harbourledger.com",), ("Harbour",), ("Ledge",), ("Oil",), (None,)], "entity string")
    outlets = spark.createDataFrame([("Harbour Ledger",)], "name string")
    assert {r["entity"] for r in entities.not_outlets(names, outlets).collect()} == {"Ledge", "Oil", None}


def test_ingest_empty(spark):
    rows = spark.createDataFrame([], "article_id bigint, source_id string, url string, feed_ord int, item_ord int, published timestamp")
    assert ingest.first_by_url(rows).count() == ingest.newest_per_source(rows).count() == 0


def test_engine_splits_fails_over_and_paces():
    now = [0.0]
    slept = []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pacer = Pacer(floor=1.0, ceiling=4.0, clock=lambda: now[0], sleep=sleep)
    pacer.wait(), pacer.wait()
    pacer.throttled(), pacer.throttled(), pacer.throttled()
    assert slept == [1.0] and pacer.gap == 4.0
    breaker = Breaker(clock=lambda: now[0])
    for _ in range(3):
        breaker.failed()
    assert not breaker.allows()
    now[0] += 46
    assert breaker.allows() and Deadline(0).remaining() == float("inf")
    assert retry_after("3", 0) == 3.0 and retry_after("junk", 0) is None

    def answer(provider, prompt):
        if provider == "down":
            raise RuntimeError
        ids = [x for x in ("S1", "S2", "S3") if f"[{x}]" in prompt]
        return "no json" if len(ids) > 1 else "```json\n" + json.dumps({"stories": [{"id": ids[0].lower(), "summary_en": "x"}]}) + "\n```"

    engine = Engine(answer, ["down", "up"])
    got = engine.analyse([{"sid": f"S{i}", "title": "t", "text": "x"} for i in (1, 2, 3)], 1)
    assert set(got) == {"S1", "S2", "S3"} and engine.counts["splits"] == 2 and engine.counts["missing"] == 0


def test_sinks_change_once(spark, tmp_path):
    assert sinks.mirror({"2026-01-01.md": "a"}, str(tmp_path)) == ["write 2026-01-01.md"]
    assert sinks.mirror({"2026-01-01.md": "a"}, str(tmp_path)) == []
    assert sinks.mirror({}, str(tmp_path)) == ["remove 2026-01-01.md"]
    marker = str(tmp_path / "s" / "run.json")
    assert not sinks.is_done(marker, "2026-01-01")
    sinks.write_marker(marker, "2026-01-01", 3, None)
    assert sinks.write_marker(marker, "2026-01-01", 3, "08:00")["attempts"] == 2 and sinks.is_done(marker, "2026-01-01")
    (tmp_path / "2026-01-02.html").write_text('<p class="stats">3 <b>stories</b></p>')
    (tmp_path / "draft.html").write_text("x")
    assert [tuple(r)[1:] for r in sinks.find_editions(spark, str(tmp_path)).collect()] == [("2026-01-02.html", "3 stories")]


def test_synthesis_is_asked_again_for_fewer_stories():
    asked = []

    def answer(provider, prompt):
        asked.append(prompt.count("[S"))
        return "{}" if len(asked) == 1 else '{"editor_note_en": "note"}'

    stories_ = [{"sid": f"S{i}", "title": "t"} for i in range(20)]
    assert Engine(answer, ["p"]).synthesise(stories_, "before")["_stories"] == 12 and asked == [20, 12]
    assert Engine(lambda p, q: "no", ["p"]).synthesise(stories_, fallback=lambda: {"n": 1}) == {"n": 1, "_source": "extractive"}
    assert Engine(lambda p, q: "no", ["p"]).synthesise([])["_source"] == "extractive"
    assert candidates([("a", "x"), ("b", "y"), ("a", "x")]) == [("a", "x"), ("b", "y")]


def test_keyed_store_with_a_time_to_live(spark, tmp_path):
    schema = "key string, payload string, at timestamp"
    day = lambda n: dt.datetime(2026, 1, n)
    parts = [("a", "one", day(1)), ("b", None, day(1))], [("a", None, day(2)), ("b", None, day(2)), ("c", "", day(2))], [("a", None, day(9))]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.cached_answers(S.stream_table(spark, str(tmp_path / "in"), schema, 10), 3 * 86400)
        S.run_available(stream, str(tmp_path / "out" / str(i)), str(tmp_path / "checkpoint"))
    read = lambda i: {r["key"]: (r["payload"], r["is_hit"]) for r in spark.read.parquet(str(tmp_path / "out" / str(i))).collect()}
    assert read(1) == {"a": ("one", True), "b": (None, False), "c": (None, False)}
    assert read(2) == {"a": (None, False)}
