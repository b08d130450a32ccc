import datetime as dt
import json

from storyloom.operators import digest
from storyloom.plans import edition
from storyloom.sources.feeds import FetchError, Reply
from storyloom.sources import sinks

RUN = dt.datetime(2026, 6, 30, 8, tzinfo=dt.timezone.utc)
CONFIG = """
[settings]
timezone = "UTC"
[[source]]
id = "ledger"
name_en = "Harbour Ledger"
lang = "en"
tier = 1
feeds = [{url = "https://ledger.example/feed", section = "local"}, {url = "https://ledger.example/gone"}]
[[source]]
id = "lantern"
name_en = "Lantern Post"
lang = "en"
feeds = [{url = "https://lantern.example/feed", section = "economy"}]
[[source]]
id = "quay"
name_en = "The Quay"
lang = "en"
type = "html"
optional = true
pages = [{url = "https://quay.example/", section = "local", exclude = "video"}]
[[source]]
id = "off"
enabled = false
feeds = [{url = "https://off.example/feed"}]
"""


def rss(host, *items):
    rows = "".join(f"<item><title>{t}</title><link>https://{host}/news/{n}</link><description>{s}</description><pubDate>{p}</pubDate></item>" for n, t, s, p in items)
    return f"<?xml version='1.0'?><rss><channel>{rows}</channel></rss>"


FRESH, OLD = "Mon, 29 Jun 2026 20:00:00 GMT", "Mon, 22 Jun 2026 20:00:00 GMT"
PARAGRAPH = "The ferry Silver Gull ran into a pearl silo in the harbour late in the evening, the port office said. "
PAGES = {
    "https://ledger.example/feed": rss("ledger.example", (1, "Silver Gull ferry hits pearl silo in harbour", "Nobody was hurt. The quay is closed.", FRESH), (2, "Museum opens night library", "", "2026-06-30T01:00:00Z"), (3, "Old news of the council", "", OLD)),
    "https://lantern.example/feed": rss("lantern.example", (1, "Pearl silo in harbour hit by Silver Gull ferry", "", "2026-06-29 21:00"), ("1?again", "Pearl silo in harbour hit by Silver Gull ferry", "", FRESH)),
    "https://quay.example/": "<nav><a href='/about'>About us, a long enough link</a></nav><a href='/news/777001'>Ferry Silver Gull hits harbour pearl silo</a><a href='/news/video/5'>A video of the harbour accident</a>",
    "https://ledger.example/news/1": f"<article><p>{PARAGRAPH}</p><p>{PARAGRAPH[:-2]} and towed away.</p><p>{'It was the third such accident of this year at the old quay, and the first with a silo. '}</p></article>",
}


def getter(pages):
    def get(url):
        if url not in pages:
            raise FetchError("not found", 404)
        return Reply(pages[url].encode(), "", "utf-8")

    return get  # a closure is sent to the workers by value


get = getter(PAGES)


def test_a_run_from_feeds_to_files(spark, tmp_path):
    (tmp_path / "sources.toml").write_text(CONFIG)
    options = edition.RunOptions(run=RUN, config=str(tmp_path / "sources.toml"), output=str(tmp_path / "out"), state=str(tmp_path / "state"), skip_if_done=True)
    done = edition.run_edition(spark, options, get)
    assert done["written"] == ["2026-06-30.html", "2026-06-30.json", "2026-06-30.md", "latest.md"]
    value = json.loads((tmp_path / "out" / "2026-06-30.json").read_text())
    assert (value["stats"]["total_articles"], value["stats"]["outlets_reporting"], value["stats"]["total_stories"], value["stats"]["major_stories"]) == (4, 3, 2, 1)
    first = value["stories"][0]
    assert first["outlet_count"] == 3 and first["rank"] == 1 and [r["source_name"] for r in first["references"]] == ["Harbour Ledger", "Lantern Post", "The Quay"]
    assert first["summary_en"].startswith("The ferry Silver Gull") and first["confidence"] == "low"
    assert value["health"] == [
        {"source_id": "lantern", "targets_ok": 1, "targets_total": 1, "articles": 1, "flag": "OK"},
        {"source_id": "ledger", "targets_ok": 1, "targets_total": 2, "articles": 2, "flag": "OK"},
        {"source_id": "quay", "targets_ok": 1, "targets_total": 1, "articles": 1, "flag": "OK"},
    ]
    text = (tmp_path / "out" / "latest.md").read_text()
    assert "# 2026-06-30" in text and "Museum opens night library" in text and "## At a glance" in text
    assert [r["stats"] for r in sinks.find_editions(spark, str(tmp_path / "out")).collect()] == ["4 articles, 3 outlets, 2 stories, 1 major"]
    assert spark.read.parquet(str(tmp_path / "state" / "memory")).collect()[0]["date"] == "2026-06-30"
    assert edition.run_edition(spark, options, get) == {"skipped": "done"}


def test_nothing_in_the_window(spark, tmp_path):
    (tmp_path / "s.toml").write_text('[[source]]\nid = "a"\nfeeds = [{url = "https://none.example"}]\n')
    assert edition.run_edition(spark, edition.RunOptions(run=RUN, config=str(tmp_path / "s.toml"), output=str(tmp_path / "o"), state=str(tmp_path / "t")), get) == {"skipped": "no articles"}
    assert not (tmp_path / "o").exists()


def test_pages_escape_what_they_show():
    story = {"rank": 1, "story_id": 1, "category": "Other", "score": 1.0, "outlet_count": 1, "title": "<b>*x*", "summary_en": "a|b", "confidence": "low", "references": [{"source_name": None, "title": "[t]", "url": "u?a&b"}]}
    value = {"date": "2026-01-01", "stats": {"total_articles": 1, "outlets_reporting": 1, "total_stories": 1, "major_stories": 0}, "categories": {"Other": 1}, "outlets": {"A": 1}, "synthesis": {}, "stories": [story, {**story, "confidence": None, "rank": 2}]}
    assert "<b>" not in digest.html_page(value) and "u?a&amp;b" in digest.html_page(value)
    assert r"\<b\>\*x\*" in digest.markdown_page(value) and "## Also" in digest.markdown_page(value)
    assert digest.site_index([("2026-01-01", "a"), ("2026-01-02", "b")]).index("2026-01-02") < digest.site_index([("2026-01-01", "a"), ("2026-01-02", "b")]).index("2026-01-01")
