"""Day-to-day memory: a small keyed table with upsert and retention, recall, bounded context; caches by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(memory: DataFrame, fresh: DataFrame, keep: int = 30) -> DataFrame:
    """Records by date: fresh ones replace those of their date, the newest `keep` stay (K-3, T-11).

    The newest are taken in every partition first, so that no task sees more than it keeps.

    Of several records of a date the greatest as JSON stays, whatever the order of rows. Records without a date are left out.
    """
    dated = fresh.filter("date is not null and cast(date as string) <> ''")
    row = F.struct(*[F.col(c) for c in fresh.columns])
    new = dated.groupBy(F.col("date").alias("__d")).agg(F.max_by(row, F.to_json(row)).alias("r")).select("r.*")
    whole = memory.join(new.select("date"), "date", "left_anti").unionByName(new, allowMissingColumns=True)
    return whole.orderBy(F.desc("date")).limit(keep)


def truthy(records: DataFrame, fields: list[str]) -> DataFrame:
    """Records with the date and the named fields only; blank texts, empty arrays, zero and false become null (P-4)."""
    kept = [F.col("date")]
    for name, kind in records.dtypes:
        if name in fields and name != "date":
            c = F.col(name)
            full = F.trim(c) != "" if kind == "string" else F.size(c) > 0 if kind.startswith(("array", "map")) else c if kind == "boolean" else c != 0 if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") else c.isNotNull()
            kept.append(F.when(full, c).alias(name))
    return records.select(*kept)


def recall(memory: DataFrame, days: int = 7, before: str | None = None) -> DataFrame:
    """The last `days` records, without the one of `before`; 0 days: all (T-10)."""
    rows = memory if before is None else memory.filter(F.col("date") != F.lit(before))
    return rows if days <= 0 else rows.orderBy(F.desc("date")).limit(days)


def context(lines: DataFrame, max_chars: int = 2400) -> DataFrame:
    """(context): the newest lines (date, line) that fit into max_chars with their line feeds, oldest first (T-9)."""
    clean = F.trim(F.regexp_replace("line", r"\s+", " "))
    clipped = F.when(F.length(clean) > max_chars, F.concat(F.substring(clean, 1, max_chars - 1), F.lit("…"))).otherwise(clean)
    rows = lines.select("date", clipped.alias("line")).filter("line <> ''")
    # a line has a character and a feed at least, so more than half as many lines as characters never fit
    rows = rows.orderBy(F.desc("date"), F.desc("line")).limit(max_chars // 2 + 1)
    size = F.sum(F.length("line") + 1).over(W.orderBy(F.desc("date"), F.desc("line")).rowsBetween(W.unboundedPreceding, 0)) - 1
    kept = rows.withColumn("__s", size).filter(F.col("__s") <= max_chars)
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "line"))), lambda s: s["line"]), "\n").alias("context"))


def cache_key(story_key, provider, model, language, urls):
    """Key of one story's analysis (J-4)."""
    return F.sha1(F.concat_ws("|", story_key, provider, model, language, F.array_join(F.array_sort(urls), ",")))


def split_cached(wanted: DataFrame, cache: DataFrame, key: str = "key", filled: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(hits with their payload, pending rows); an empty payload is no hit (J-4, P-12)."""
    full = cache.filter(F.col(filled).isNotNull() & (F.col(filled) != "")).select(key, filled)
    return wanted.join(full, key), wanted.join(full.select(key), key, "left_anti")


def trim_cache(cache: DataFrame, most: int = 4000, to: int = 3000) -> DataFrame:
    """The newest `to` entries once there are more than `most`; otherwise all (K-4). The newest are taken in every partition first."""
    n = cache.agg(F.count("*").alias("__n"))
    small = cache.crossJoin(n).filter(F.col("__n") <= most)
    newest = cache.orderBy(F.desc("inserted_at"), "key").limit(to).crossJoin(n).filter(F.col("__n") > most)
    return small.unionByName(newest).drop("__n")


def store_answers(batch: DataFrame, answers: DataFrame, fallback: str, value: str) -> DataFrame:
    """Batch rows (sid, ...) with the last answer of their id, compared without case and blanks, else the fallback column (J-5)."""
    last = answers.groupBy(F.upper(F.trim("id")).alias("sid")).agg(F.max_by(value, "ord").alias("__a"))
    rows = batch.join(last, "sid", "left")
    return rows.withColumn(value, F.coalesce("__a", fallback)).withColumn("is_missing", F.col("__a").isNull()).drop("__a")


def _hadoop(spark: SparkSession, path: str):
    """(Hadoop path class, file system) of a path, local or shared."""
    fs = spark._jvm.org.apache.hadoop.fs
    return fs.Path, fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    at, fs = _hadoop(spark, path)
    fs.delete(at(path), True)


def load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with a date from JSON lines; corrupt lines are left out, a missing file is empty (S-15)."""
    at, fs = _hadoop(spark, path)
    if not fs.exists(at(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter("date is not null and date <> ''")


def load_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache table; a missing or unreadable one is empty, so that a broken cache costs time but no run (S-16)."""
    at, fs = _hadoop(spark, path)
    try:
        if fs.exists(at(path)):
            rows = spark.read.schema(schema).parquet(path)
            rows.limit(1).count()
            return rows
    except Exception:  # noqa: BLE001 - any unreadable file counts as no cache
        pass
    return spark.createDataFrame([], schema)


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that replace_table wrote, or its last good copy where a writer died between its two renames."""
    at, fs = _hadoop(spark, path)
    for place in (path, f"{path}.old"):
        if fs.exists(at(place)):
            return spark.read.parquet(place)
    return None


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table and rename, so that a state table may be computed from itself (K-3).

    The old table is removed last: at every moment `path` or `path`.old is whole, see read_state.
    """
    staging, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    df.write.mode("overwrite").parquet(staging)
    at, fs = _hadoop(df.sparkSession, path)
    if fs.exists(at(path)):
        fs.delete(at(old), True)  # a whole table stands at `path`
        fs.rename(at(path), at(old))
    fs.rename(at(staging), at(path))
    fs.delete(at(old), True)
