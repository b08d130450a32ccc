"""Sinks: editions as partitioned tables and files, the run marker, idempotent mirrors (K-1, K-5, K-7, K-8)."""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_editions(stories: DataFrame, path: str) -> None:
    """Parquet by edition; a rerun replaces only the editions it holds."""
    stories.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edition").parquet(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    """One text file for each partition of the rows (documents of many editions stay distributed)."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_edition_files(directory: str, date: str, markdown: str, document: dict, page: str | None = None) -> list[str]:
    """<date>.md, <date>.json, <date>.html if given, and latest.md; each written beside and renamed."""
    files = {f"{date}.md": markdown, f"{date}.json": json.dumps(document, ensure_ascii=False, indent=1), "latest.md": markdown} | ({f"{date}.html": page} if page else {})
    Path(directory).mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        write_if_changed(os.path.join(directory, name), content)
    return sorted(files)


def write_if_changed(path: str, content: str) -> bool:
    """Whether the file had to be written."""
    raw = content.encode("utf-8")
    target = Path(path)
    if target.exists() and hashlib.sha256(target.read_bytes()).digest() == hashlib.sha256(raw).digest():
        return False
    beside = target.with_suffix(target.suffix + ".new")
    beside.write_bytes(raw)
    os.replace(beside, target)
    return True


def mirror(wanted: dict[str, str], directory: str, pattern: str = r"^\d{4}-\d{2}-\d{2}\.(md|json|html)$") -> list[str]:
    """Write what differs and remove editions that are no longer wanted; gives the changes, none on a second run."""
    Path(directory).mkdir(parents=True, exist_ok=True)
    changes = [f"write {n}" for n, content in sorted(wanted.items()) if write_if_changed(os.path.join(directory, n), content)]
    for name in sorted(os.listdir(directory)):
        if re.match(pattern, name) and name not in wanted:
            os.remove(os.path.join(directory, name))
            changes.append(f"remove {name}")
    return changes


def find_editions(spark: SparkSession, directory: str) -> DataFrame:
    """(edition, name, stats): dated pages of a folder, newest first, with the text of their stats line (S-18, F-24)."""
    pages = spark.read.text(f"{directory}/*.html", wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    dated = pages.filter(F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}\.html$"))
    stats = F.trim(F.regexp_replace(F.regexp_extract("value", r'(?s)class="stats"[^>]*>(.*?)</', 1), r"<[^>]*>", ""))
    return dated.select(F.substring("name", 1, 10).cast("date").alias("edition"), "name", stats.alias("stats")).orderBy(F.desc("edition"))


def read_marker(path: str) -> dict:
    """The last run's record; empty for a missing or corrupt file."""
    try:
        value = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return {}
    return value if isinstance(value, dict) else {}


def write_marker(path: str, date: str, stories: int, delivered_at: str | None) -> dict:
    """The run's record with its number of attempts for the date."""
    old = read_marker(path)
    record = {"date": date, "delivered_at": delivered_at, "stories": stories, "attempts": (old.get("attempts", 0) if old.get("date") == date else 0) + 1}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    write_if_changed(path, json.dumps(record))
    return record


def is_done(path: str, date: str) -> bool:
    """Whether the date was delivered (P-16)."""
    old = read_marker(path)
    return old.get("date") == date and bool(old.get("delivered_at"))
