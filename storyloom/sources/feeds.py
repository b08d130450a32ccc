"""Feeds and list pages: one task for each target, a failing target gives its error and no rows (S-2, S-3, S-10, S-11).

What fetches an address is a parameter: a function from an address to a Reply. read_file reads paths and `file://` addresses,
http_get the web; tests and runs without a network pass their own.
"""

from __future__ import annotations

import importlib
import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from storyloom.functions.markup import decode_bytes, decompress, parse_feed, scrape_list
from storyloom.operators.enrich import retry_after
from storyloom.operators.ingest import first_by_url, newest_per_source
from storyloom.session import checkpoint

#: Answers worth another try.
RETRY_CODES = frozenset((408, 425, 429, 500, 502, 503, 504, 522, 524, 599))


@dataclass(frozen=True)
class Reply:
    """What an address gave: bytes, their content encoding, and the charset of their content type."""

    raw: bytes
    encoding: str = ""
    charset: str = ""

    def text(self) -> str:
        return decode_bytes(decompress(self.raw, self.encoding), self.charset or None)


Getter = Callable[[str], Reply]


class FetchError(Exception):
    """A target that could not be read; code: of the answer, retry_after: in seconds, if it said so."""

    def __init__(self, message: str, code: int = 0, retry_after: float | None = None) -> None:
        super().__init__(message)
        self.code, self.retry_after = code, retry_after


def read_file(url: str) -> Reply:
    """A local file."""
    try:
        return Reply(Path(url.removeprefix("file://")).read_bytes())
    except OSError as e:
        raise FetchError(str(e), 404) from e


def http_get(url: str, timeout: float = 25.0, data: bytes | None = None, headers: dict | None = None) -> Reply:
    """An address of the web; its failures carry their code and what they said of retrying."""
    request = urllib.request.Request(url, data, {"Accept-Encoding": "gzip, deflate", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return Reply(answer.read(), answer.headers.get("Content-Encoding") or "", answer.headers.get_content_charset() or "")
    except urllib.error.HTTPError as e:
        raise FetchError(f"{url}: {e.code}", e.code, retry_after(e.headers.get("Retry-After"), time.time())) from e
    except (urllib.error.URLError, TimeoutError, OSError) as e:
        raise FetchError(f"{url}: {e}", 599) from e


def fetch(url: str, get: Getter = read_file, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """`get` with retries: only for the codes above, waiting 0.8 s times a power of two and some jitter, or as told up to 30 s."""
    for attempt in range(retries + 1):
        try:
            return get(url)
        except Exception as e:  # noqa: BLE001 - getters may raise errors of their own; without a code none is worth another try
            told = getattr(e, "retry_after", None)
            if attempt == retries or getattr(e, "code", 0) not in RETRY_CODES or (told or 0) > 30:
                raise
            sleep(told if told is not None else 2**attempt * 0.8 + random.uniform(0, 0.6))
    raise AssertionError


def fetch_text(url: str, get: Getter = http_get) -> str:
    return fetch(url, get).text()


def fetch_json(url: str, body: object = None, get: Callable[..., Reply] = http_get) -> object:
    """The JSON value of an address, of a POST where a body is given; an answer that is none is a FetchError."""
    more = {} if body is None else {"data": json.dumps(body).encode(), "headers": {"Content-Type": "application/json"}}
    reply = fetch(url, lambda u: get(u, **more))
    try:
        return json.loads(reply.text())
    except ValueError as e:
        raise FetchError(f"{url}: no JSON") from e


def _payload(url: str, get: Getter) -> tuple[str | None, str | None]:
    """(text, error) of a target."""
    try:
        return fetch(url, get).text(), None
    except Exception as e:  # noqa: BLE001 - one failing target must not end the run
        return None, str(e)[:200] or type(e).__name__


class _Target(InputPartition):
    def __init__(self, row: tuple) -> None:
        self.row = row


class FeedReader(DataSourceReader):
    def __init__(self, targets: list[tuple], getter: str) -> None:
        self.targets, self.getter = targets, getter

    def partitions(self) -> list[InputPartition]:
        return [_Target(t) for t in self.targets]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.getter.partition(":")
        source_id, feed_ord, url = partition.row
        yield source_id, feed_ord, url, *_payload(url, getattr(importlib.import_module(module), name))


class FeedSource(DataSource):
    """spark.read.format("storyloom_feeds").option("targets", json of [[source_id, feed_ord, url], ...]).option("getter", "module:function")."""

    @classmethod
    def name(cls) -> str:
        return "storyloom_feeds"

    def schema(self) -> str:
        return "source_id string, feed_ord int, url string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader([tuple(t) for t in json.loads(self.options.get("targets", "[]"))], self.options.get("getter", f"{__name__}:read_file"))


def read_targets(spark: SparkSession, targets: list[tuple[str, int, str]], getter: str = f"{__name__}:read_file") -> DataFrame:
    """(source_id, feed_ord, url, payload, error) of all targets; those that fail have an error."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("storyloom_feeds").option("targets", json.dumps(targets)).option("getter", getter).load()


def fetched(targets: DataFrame, get: Getter = read_file, column: str = "url") -> DataFrame:
    """`targets` with payload and error of each address, fetched in parallel tasks by any function."""
    schema = targets.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [_payload(u, get) if u else (None, "no address") for u in batch[column]]
            yield batch.assign(payload=[g[0] for g in got], error=[g[1] for g in got])

    return targets.repartition(F.col(column)).mapInPandas(run, f"{schema}, payload string, error string")


def entries(payloads: DataFrame) -> DataFrame:
    """One row for each entry of each payload: (source_id, feed_ord, item_ord, title, url, summary, published)."""
    rows = payloads.filter("payload is not null").select("source_id", "feed_ord", F.posexplode(parse_feed("payload", "url")).alias("item_ord", "e"))
    return rows.select("source_id", "feed_ord", "item_ord", "e.title", "e.url", "e.summary", "e.published")


def listed(payloads: DataFrame) -> DataFrame:
    """The same of list pages: the links that look like articles; payloads with include and exclude."""
    rows = payloads.filter("payload is not null").select("source_id", "feed_ord", F.posexplode(scrape_list("payload", "url", "include", "exclude")).alias("item_ord", "e"))
    none = F.lit(None).cast("string")
    return rows.select("source_id", "feed_ord", "item_ord", F.col("e.text").alias("title"), "e.url", F.lit("").alias("summary"), none.alias("published"))


def collect(sources: DataFrame, feeds: DataFrame, get: Getter = read_file, per_source: int = 120) -> tuple[DataFrame, DataFrame]:
    """(articles, targets): feeds are parsed, list pages scraped, each source's addresses taken once and its newest articles kept (S-2, S-3, D-1, T-1).

    sources: of load_config; feeds: (source_id, feed_ord, url, section, include, exclude, is_enabled). targets: (source_id,
    feed_ord, error), null where the fetch did not fail. `published` stays the text that arrived.
    """
    kinds = sources.filter("is_enabled").select("source_id", "kind", "lang", "tier", F.col("name_en").alias("source_name"))
    got = fetched(feeds.filter("is_enabled").join(kinds, "source_id"), get)
    got = checkpoint(got)  # no address is asked twice
    rows = entries(got.filter("kind <> 'html'")).unionByName(listed(got.filter("kind = 'html'")))
    about = got.select("source_id", "feed_ord", "section", "lang", "tier", "source_name")
    rows = rows.join(about, ["source_id", "feed_ord"]).withColumn("article_id", F.xxhash64("source_id", "feed_ord", "item_ord", "url")).withColumn("body", F.lit(""))
    return newest_per_source(first_by_url(rows), per_source), got.select("source_id", "feed_ord", "error")
