"""The registry of sources from TOML, as tables (S-1)."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SOURCE = "source_id string, name_en string, name_ar string, homepage string, lang string, kind string, tier int, is_optional boolean, is_enabled boolean"
_FEED = "source_id string, feed_ord int, url string, section string, include string, exclude string, is_enabled boolean"
_SETTINGS = {"window_hours": 26, "max_analyze": 28, "major_outlets": 3, "timezone": "UTC"}


def load_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(sources, feeds, settings); defaults: tier 2, Arabic, rss, enabled; unknown settings and feed keys are errors."""
    data = tomllib.loads(Path(path).read_text("utf-8"))
    settings = dict(_SETTINGS)
    for key, value in data.get("settings", {}).items():
        if key not in settings:
            raise ValueError(f"unknown setting {key}")
        settings[key] = value
    sources, feeds = [], []
    for s in data.get("source", []):
        on = s.get("enabled", True)
        sources.append((s["id"], s.get("name_en", s["id"]), s.get("name_ar", s["id"]), s.get("homepage", ""), s.get("lang", "ar"), s.get("type", "rss"), s.get("tier", 2), s.get("optional", False), on))
        # list pages of html sources come after the feeds
        for i, f in enumerate([*s.get("feeds", []), *s.get("pages", [])]):
            if unknown := set(f) - {"url", "section", "include", "exclude"}:
                raise ValueError(f"unknown feed keys {sorted(unknown)}")
            feeds.append((s["id"], i, f["url"], f.get("section", "general"), f.get("include"), f.get("exclude"), on))
    return spark.createDataFrame(sources, _SOURCE), spark.createDataFrame(feeds, _FEED), settings
