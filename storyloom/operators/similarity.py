"""Similarity joins of headlines within an edition: candidates by an inverted index, exact by prefix filtering.

Headlines with the same tokens are one class (of one language, as languages decide bridges); pairs are formed between
classes and are never expanded into pairs of copies, so that a wire line carried a million times is one row. Two classes can
only share half of the smaller one's tokens if one of its rarest tokens is shared: the prefix of the smaller (tokens by
document frequency) is joined with all tokens of the larger, pairs are verified on the sets. Editions (days) are the blocks,
as a story never spans two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.functions.text import canonical_tokens, distinctive, jaccard, numbers_disagree, overlap
from storyloom.session import checkpoint
from storyloom.vocab.words import Lexicon


def tokenised(articles: DataFrame, lexicon: Lexicon | None = None, compatibility: bool = False) -> DataFrame:
    """(edition, article_id, lang, toks, dist): canonical and distinctive tokens of the titles. Rows without tokens are left to the
    consumers: a filter here would be pushed below the projection and make every title be read twice."""
    lexicon = lexicon or Lexicon()
    rows = articles.select("edition", "article_id", "lang", F.array_sort(canonical_tokens(F.col("title"), lexicon, compatibility)).alias("toks"))
    return rows.withColumn("dist", distinctive(F.col("toks"), lexicon.generic))


def headline_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, membership): classes (edition, class_id, lang, n, toks, dist) are the distinct token sets of an edition and language, named
    by their smallest article_id; membership (edition, article_id, class_id). Titles without tokens have no class. Titles are tokenised once, for both."""
    kept = checkpoint(rows).filter(F.size("toks") > 0)
    classes = kept.groupBy("edition", "lang", "toks").agg(F.min("article_id").alias("class_id"), F.count("*").alias("n"), F.first("dist").alias("dist"))
    classes = checkpoint(classes.select("edition", "class_id", "lang", "n", "toks", "dist"))
    keys = classes.select(F.col("edition").alias("__e"), F.col("lang").alias("__l"), F.col("toks").alias("__t"), "class_id")
    same = F.col("edition").eqNullSafe(F.col("__e")) & F.col("lang").eqNullSafe(F.col("__l")) & (F.col("toks") == F.col("__t"))
    return classes, kept.select("edition", "lang", "toks", "article_id").join(keys, same).select("edition", "article_id", "class_id")


def _candidates(rows: DataFrame, column: str, threshold: float, least: int) -> DataFrame:
    """(edition, a, b): pairs of ids, a before b in (size, id), that may share `least` tokens and the threshold's part of a's.

    Tokens are compared as 64-bit hashes; a pair that shares one by chance only is refuted where the sets are compared.
    """
    keyed = rows.select("edition", "class_id", F.transform(F.col(column), lambda t: F.xxhash64(t)).alias("set")).withColumn("n", F.size("set")).filter(F.col("n") >= max(least, 1))
    long = keyed.select("edition", "class_id", "n", F.explode("set").alias("token"))
    counted = long.withColumn("df", F.count("*").over(W.partitionBy("edition", "token")))
    # the rarest tokens of each class first; the arrays hold the tokens of one headline
    order = counted.groupBy("edition", "class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("sorted"))
    must = F.greatest(F.lit(max(least, 1)), F.ceil(F.col("n") * threshold)).cast("int")
    prefix = order.select("edition", F.col("class_id").alias("a"), F.col("n").alias("na"), F.explode(F.slice("sorted", F.lit(1), F.col("n") - must + 1)).alias("s"))
    prefix = prefix.filter("s.df > 1").select("edition", "a", "na", F.col("s.token").alias("token"))
    whole = long.select("edition", F.col("class_id").alias("b"), F.col("n").alias("nb"), "token")
    pairs = prefix.join(whole, ["edition", "token"]).filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    return pairs.select("edition", "a", "b").distinct()


def _verified(rows: DataFrame, pairs: DataFrame, keep: Column, score: Column) -> DataFrame:
    side = lambda x: rows.select("edition", F.col("class_id").alias(x), F.col("lang").alias(f"l{x}"), F.col("toks").alias(f"t{x}"), F.col("dist").alias(f"d{x}"))
    joined = pairs.join(side("a"), ["edition", "a"]).join(side("b"), ["edition", "b"]).filter(keep)
    return joined.select("edition", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.round(score, 6).alias("score"))


def same_story_edges(classes: DataFrame, threshold: float = 0.5, shared: int = 2, strict_language: bool = False, veto: bool | None = True) -> DataFrame:
    """(edition, src, dst, score): classes of one edition with an overlap of canonical tokens of at least `threshold` and
    `shared` distinctive tokens in common, unless their numbers disagree (J-1, J-2, P-5). veto: False looks at no numbers, None
    gives the pairs whose numbers disagree. Copies are linked by their class; see linked_copies."""
    score = overlap(F.col("ta"), F.col("tb"))
    keep = (score >= threshold) & (F.size(F.array_intersect("da", "db")) >= shared)
    if veto is not False:
        disagree = numbers_disagree(F.col("ta"), F.col("tb"))
        keep = keep & (disagree if veto is None else ~disagree)
    if strict_language:
        keep = keep & F.col("la").eqNullSafe(F.col("lb"))
    return _verified(classes, _candidates(classes, "toks", threshold, shared), keep, score)


def linked_copies(classes: DataFrame, shared: int = 2) -> DataFrame:
    """Classes whose own copies tell one story: those with enough distinctive tokens."""
    return classes.filter(F.size("dist") >= shared)


def bridge_edges(classes: DataFrame, threshold: float = 0.3, shared: int = 2) -> DataFrame:
    """(edition, src, dst, score): classes in different languages that share distinctive tokens (J-3, on single headlines)."""
    score = overlap(F.col("da"), F.col("db"))
    keep = (F.col("la") != F.col("lb")) & (score >= threshold) & (F.size(F.array_intersect("da", "db")) >= shared)
    return _verified(classes, _candidates(classes, "dist", threshold, shared), keep, score)


def best_pair(rows: DataFrame) -> DataFrame:
    """(edition, best): the largest of jaccard and 0.9 of the overlap between two rows (edition, article_id, toks) of a group with two rows or more (F-8).

    Two rows with the same tokens give 1, the most there is. Other groups are searched among the pairs that the prefix filter
    allows at half of the smaller set, and only where there are none, among all pairs that share a token.
    """
    kept = checkpoint(rows.select("edition", "article_id", F.array_sort("toks").alias("toks")))
    classes = checkpoint(kept.groupBy("edition", "toks").agg(F.min("article_id").alias("class_id"), F.count("*").alias("n")))
    groups = classes.groupBy("edition").agg(F.sum("n").alias("n"), F.max(((F.col("n") > 1) & (F.size("toks") > 0)).cast("int")).alias("copies")).filter("n > 1")
    exact = groups.filter("copies = 1").select("edition", F.lit(1.0).alias("best"))
    open_ = classes.join(groups.filter("copies = 0").select("edition"), "edition", "left_semi").filter(F.size("toks") > 0)

    def search(sets: DataFrame, threshold: float) -> DataFrame:
        side = lambda x: sets.select("edition", F.col("class_id").alias(x), F.col("toks").alias(f"t{x}"))
        pairs = _candidates(sets, "toks", threshold, 1).join(side("a"), ["edition", "a"]).join(side("b"), ["edition", "b"])
        return pairs.groupBy("edition").agg(F.max(F.greatest(jaccard(F.col("ta"), F.col("tb")), 0.9 * overlap(F.col("ta"), F.col("tb")))).alias("best"))

    # what the filter leaves out is below 0.5 in both measures, and 0.45 is the least that it finds at half
    near = checkpoint(search(open_, 0.5).filter("best >= 0.5"))
    far = search(open_.join(near.select("edition"), "edition", "left_anti"), 0.0)
    found = exact.unionByName(near).unionByName(far)
    return groups.select("edition").join(found, "edition", "left").select("edition", F.coalesce("best", F.lit(0.0)).alias("best"))
