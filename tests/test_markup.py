import gzip
import zlib

import pytest

from storyloom.functions import markup as M
from storyloom.sources import feeds
from storyloom.sources.config import load_config

RSS = """<?xml version="1.0" encoding="utf-8"?><rss><channel><item><title><![CDATA[A <b>title</b> here]]></title>
<link>/a/1</link><description>Text &amp; more</description><pubDate>Fri, 15 May 2026 21:41:38 GMT</pubDate></item>
<item><title>No link</title></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="x"/><link href="https://n.example/2"/><updated>2026-05-15T00:00:00Z</updated></entry></feed>'
HOSTILE = '<!DOCTYPE r [<!ENTITY x SYSTEM "file:///etc/passwd">]><rss><item><title>&x; ok &nbsp;</title><link>https://n.example/3</link></item></rss>'


def test_feeds():
    assert M.feed_entries(RSS, "https://n.example/feed") == [("A title here", "https://n.example/a/1", "Text & more", "Fri, 15 May 2026 21:41:38 GMT")]
    assert M.feed_entries(ATOM)[0][:2] == ("T", "https://n.example/2")
    assert [e[0] for e in M.feed_entries(HOSTILE)] == ["ok"]
    for junk in (None, "", "<html><body>x</body></html>", "<rss><channel/></rss>", "<<<"):
        assert M.feed_entries(junk) == []


def test_html():
    page = "<html><head><meta name='description' content='A description that is long enough to be used as text'></head><nav><a href='/n'>nav</a></nav><p>One<br>two</p><a href='/story/12345'><b>A long enough headline</b></a><a href='#x'>x</a></html>"
    assert M.plain_text(page) == "One\ntwo\nA long enough headlinex"
    assert M.page_links(page, "https://n.example/") == [("https://n.example/n", "nav"), ("https://n.example/story/12345", "A long enough headline")]
    assert M.scraped_links(M.page_links(page, "https://n.example/"), "https://n.example/") == [("https://n.example/story/12345", "A long enough headline")]
    assert M.article_body(page).startswith("A description")
    long = "This is a paragraph of the article that is certainly long enough to stay. "
    body = M.article_body(f"<article><p>{long * 3}</p><p>{long * 3}</p><p>short</p><li><a>{'a' * 30}</a><a>b</a></li></article><p>outside</p>")
    assert body == (long * 3).strip()
    assert M.plain_text("a &amp; b") == "a & b" and M.plain_text(None) == ""


@pytest.mark.parametrize("declared", ["windows-1256", None])
def test_charsets(declared):
    text = "أخبار اليوم"
    assert M.decode_bytes(text.encode("cp1256"), declared) == text
    assert M.decode_bytes(text.encode("utf-8")) == text
    assert M.decode_bytes(b"<meta charset='iso-8859-6'>" + text.encode("iso-8859-6")).endswith(text)
    assert M.declared_charset(b'<?xml encoding="nonsense-9"?>') is None


def test_blocks_and_noise():
    long = "A paragraph that is long enough to be one of the first three of them, surely."
    page = f"<nav><p>{long}</p></nav><figure><p>{long} fig</p></figure><p>{long}</p><li><p>inner wins over the item that holds it, and is long enough</p></li><p>Subscribe to the paper for more of all this, every single morning of it</p><h2>Too short</h2><button><p>{long} b</p></button><p>{long}</p>"
    assert [t for t, _ in M.text_blocks(page)] == [long, "inner wins over the item that holds it, and is long enough", "Subscribe to the paper for more of all this, every single morning of it", "Too short", long]
    assert M.article_body(page + "</nav></div>").split("\n\n") == [long, "inner wins over the item that holds it, and is long enough"]
    farm = "<p>" + "<a href='/x'>link</a> " * 20 + "</p>"
    assert M.article_body(farm) == "" and M.article_body(None) == ""
    assert M.plain_text("<b>a</b><figure>x</figure><p>b</p>") == "a\nb"


def test_entries_in_document_order():
    feed = "<rss><item><guid>https://n.example/g</guid><link>https://n.example/l</link><title>" + "word " * 100 + "</title><created>2026-01-01</created><subtitle>sub</subtitle></item></rss>"
    title, url, summary, published = M.feed_entries(feed)[0]
    assert (url, summary, published) == ("https://n.example/g", "sub", "2026-01-01") and len(title) <= 401 and title.endswith("word…")


def test_list_pages():
    links = [("https://n.example/news/1?x=1", "A headline that is long enough"), ("https://n.example/news/1?x=2", "The same page, another query"), ("https://other.example/news/2", "Another host with a long title"), ("https://n.example/news/3", "short"), ("https://n.example/about", "Not shaped like an article at all"), ("https://n.example/news/4", "!!!!!!!!!!!!!!!!!!!!!!!!"), ("https://n.example/news/sport/5", "A sports headline, long enough")]
    page = "https://n.example/"
    assert [u for u, _ in M.scraped_links(links, page)] == ["https://n.example/news/1?x=1", "https://n.example/news/sport/5"]
    assert [u for u, _ in M.scraped_links(links, page, include="sport")] == ["https://n.example/news/sport/5"]
    assert [u for u, _ in M.scraped_links(links, page, exclude="SPORT")] == ["https://n.example/news/1?x=1"]


def test_decompress_and_json():
    raw = b"hello"
    assert M.decompress(gzip.compress(raw), "gzip") == M.decompress(zlib.compress(raw), "deflate") == M.decompress(zlib.compress(raw)[2:-4], "deflate") == M.decompress(raw, "gzip") == raw
    assert M.json_object('x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert M.json_object("[1]") == '{"stories": [1]}' and M.json_object('so {broken {"b": {"c": 2}} end') == '{"b": {"c": 2}}' and M.json_object(None) is None


def test_feed_source_and_retries(spark, tmp_path):
    f = tmp_path / "feed.xml"
    f.write_text(RSS)
    rows = feeds.read_targets(spark, [("a", 0, str(f)), ("b", 0, str(tmp_path / "none"))])
    got = {r["source_id"]: r for r in rows.collect()}
    assert got["b"]["error"] and got["b"]["payload"] is None
    assert [r["title"] for r in feeds.entries(rows).collect()] == ["A title here"]
    assert feeds.fetch_json("u", get=lambda u, **k: feeds.Reply(b'{"a": 1}')) == {"a": 1}
    assert feeds.Reply("é".encode("cp1252"), "", "windows-1252").text() == feeds.Reply(gzip.compress("é".encode()), "gzip").text() == "é"
    with pytest.raises(feeds.FetchError):
        feeds.fetch_json("u", {"q": 1}, get=lambda u, data, headers: feeds.Reply(b"<html>"))
    calls, waits = [], []

    def get(url):
        calls.append(url)
        raise feeds.FetchError("busy", 503 if len(calls) < 3 else 404)

    with pytest.raises(feeds.FetchError):
        feeds.fetch("u", get, 5, waits.append)
    assert len(calls) == 3 and len(waits) == 2


def test_config(spark, tmp_path):
    path = tmp_path / "s.toml"
    path.write_text('[settings]\nwindow_hours = 30\n[[source]]\nid = "a"\nfeeds = [{url = "u"}, {url = "v", section = "x"}]\n[[source]]\nid = "b"\nenabled = false\n')
    sources, targets, settings = load_config(spark, str(path))
    assert (sources.count(), targets.count(), settings["window_hours"]) == (2, 2, 30)
    path.write_text("[settings]\nodd = 1\n")
    with pytest.raises(ValueError):
        load_config(spark, str(path))
