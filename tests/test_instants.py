import datetime as dt

import pytest

from storyloom.operators.instants import instants_found, normalised_published, with_instants

ZONES = [("kw", "Asia/Kuwait"), ("ny", "America/New_York"), ("de", "Europe/Berlin"), ("bad", "Nowhere/Town"), ("none", None)]


def utc(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp())


CASES = [
    ("kw", "2026-08-27 21:28:26", utc(2026, 8, 27, 18, 28, 26)),
    ("kw", "2026-08-27T21:28", utc(2026, 8, 27, 18, 28)),
    ("kw", "2026-10-16", utc(2026, 10, 15, 21)),
    ("kw", "1794218557013", 1794218557),
    ("kw", " 1784898433\n", 1784898433),
    ("kw", "2026-06-28T11:35:29.915560Z", utc(2026, 6, 28, 11, 35, 29)),
    ("ny", "2026-06-19T15:32:29.107+0330", utc(2026, 6, 19, 12, 2, 29)),
    ("ny", "2026-04-02T05:33:26-04:00", utc(2026, 4, 2, 9, 33, 26)),
    ("kw", "13 Nov 2026 05:47 EST", utc(2026, 11, 13, 10, 47)),
    ("kw", "Fri, 15 May 2026 21:41:38 GMT", utc(2026, 5, 15, 21, 41, 38)),
    ("kw", "Thu, 2 Apr 2026 18:31:13 +0300", utc(2026, 4, 2, 15, 31, 13)),
    ("de", "26.10.2026, 10:29", utc(2026, 10, 26, 9, 29)),
    ("kw", "02/05/2026 14:44", utc(2026, 5, 2, 11, 44)),
    ("ny", "02/05/2026 2:44 PM", utc(2026, 2, 5, 19, 44)),
    ("ny", "02/05/2026 12:05 AM", utc(2026, 2, 5, 5, 5)),
    ("kw", "Wednesday, November 11, 2026 8:12 PM", utc(2026, 11, 11, 17, 12)),
    ("de", "14 juin 2026 à 21h53", utc(2026, 6, 14, 19, 53)),
    ("de", "3. März 2026, 7:05 Uhr", utc(2026, 3, 3, 6, 5)),
    ("kw", "٢٤ سبتمبر ٢٠٢٦ - ١٢:٤٨", utc(2026, 9, 24, 9, 48)),
    ("kw", "<![CDATA[14/05/2026 17:55]]>", utc(2026, 5, 14, 14, 55)),
    # twice: the earlier instant; never: moved forward by the gap
    ("de", "2026-10-25 02:30", utc(2026, 10, 25, 0, 30)),
    ("de", "2026-03-29 02:30", utc(2026, 3, 29, 1, 30)),
    ("bad", "2026-01-01 00:00", utc(2026, 1, 1)),
    ("none", "2026-01-01 00:00", utc(2026, 1, 1)),
    ("missing", "2026-01-01 00:00", utc(2026, 1, 1)),
    (None, "2026-01-01 00:00", utc(2026, 1, 1)),
]
JUNK = [None, "", "  ", "-", "N/A", "yesterday", "31 Foo 2026", "0000-00-00 00:00:00", "2026-13-45T99:00:00", "30/02/2026 10:00", "2026-01-01 10:00 XYZ", "13:00 PM", "01/01/2026 13:00 PM", "x" * 20_000]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(ZONES, "source_id string, time_zone string")


def test_values(spark, sources):
    rows = spark.createDataFrame([(i, s, p, "extra") for i, (s, p, _) in enumerate(CASES)], "article_id bigint, source_id string, published string, time_zone string")
    got = {r["article_id"]: (r["utc_s"], r["time_zone"]) for r in with_instants(rows, sources).collect()}
    assert {i: got[i][0] for i in got} == {i: want for i, (_, _, want) in enumerate(CASES)}
    assert {x for _, x in got.values()} == {"extra"}


def test_junk_empty_and_canonical(spark, sources):
    schema = "article_id bigint, source_id string, published string"
    rows = spark.createDataFrame([(i, "kw", p) for i, p in enumerate(JUNK)], schema)
    assert instants_found(rows, sources).count() == 0
    assert instants_found(rows.limit(0), sources).count() == 0
    twice = spark.createDataFrame([(1, "kw", "2026-05-18T03:42:50Z"), (2, "kw", "2026-01-01"), (2, "kw", "2026-01-01"), (None, "kw", "2026-01-01")], schema)
    assert [tuple(r) for r in instants_found(twice, sources).collect()] == [(2, utc(2025, 12, 31, 21))]
    assert {tuple(r) for r in normalised_published(twice.limit(1), sources).select("published_utc").collect()} == {("2026-05-18T03:42:50Z",)}


def test_session_zone_does_not_matter(spark, sources):
    rows = spark.createDataFrame([(1, "de", "2026-07-01 12:00")], "article_id bigint, source_id string, published string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert instants_found(rows, sources).collect()[0]["utc_s"] == utc(2026, 7, 1, 10)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
