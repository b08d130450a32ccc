"""Problem 1: values cut off by a field limit or a broken transfer.

1. Length histograms: per source and column, in characters and in bytes, over the values without terminal
   punctuation (and over those that end with dots) as well as over all values. A limit shows as a spike at the upper
   end: a length, or for cutters that go back to a word's end a narrow band of lengths, far above its surroundings.
2. Values at spike lengths without terminal punctuation are flagged; so is what a cutter or a broken transfer
   leaves at the end (half a character reference or tag, a replacement character, an ellipsis in brackets).
3. Flagged and unpunctuated values are held against the text they were taken from: if the body goes on inside the
   word or the sentence, the value was cut; if the body ends its sentence there, it was not. Without a body, corpus
   counts of how often the last two words end a sentence or a headline decide, and at spike lengths their benefit
   of the doubt is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.lookalikes import _CYR_LATIN, _CYRILLIC, _GREEK, _GREEK_LATIN

#: White space and invisible characters that are stripped from both ends, by code point.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x200E, 0x200F, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: The end of a value that the patterns below look at, in characters.
_TAIL = 80
#: Left by a cutter: an ellipsis in brackets, or words that invite to go on.
_MARK = r"(?i)(\[\s*(…|\.{2,})\s*\]?|\(\s*(…|\.{3})\s*\)|(read more|continue reading|lire la suite|weiterlesen|mehr lesen|اقرأ المزيد|المزيد|ادامه مطلب)\s*(…|\.{3}|»|›|→)?)$"
#: Left by a broken transfer: half a character reference, half a tag, a replacement character, an escape.
_BROKEN = r"(&(#[xX]?[0-9a-fA-F]{0,6}|[a-z]{2,7})?|<(/?[A-Za-z][^<>]{0,60})?|\x{fffd}+|\\(u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?)$"
_DOTS = r"(…|\.{2,})$"
#: Terminal punctuation, perhaps inside closing quotes or brackets.
_ENDED = r"[.!?؟。।۔]([\x22\x27»”’“›)\]]|\s)*$"
_WINDOW = 12


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _open_tag(text: Column) -> Column:
    """Whether a tag with an attribute is open at the end, however long it is."""
    last = F.substring_index(text, "<", -1)
    return F.contains(text, F.lit("<")) & ~F.contains(last, F.lit(">")) & F.contains(last, F.lit("=")) & last.rlike("^[A-Za-z]+\\s")


def _shape(articles: DataFrame, column: str = "summary") -> DataFrame:
    """Each non-blank value of a column with its lengths and the kind of its end."""
    rows = articles.select("article_id", "source_id", "title", F.col(column).alias("value"), "body").filter(F.col("article_id").isNotNull() & F.col(column).isNotNull())
    rows = rows.withColumn("text", _stripped(F.col("value"))).filter("text <> ''")
    end = F.right(F.col("text"), F.lit(_TAIL))
    kind = (
        F.when(end.rlike(_MARK), "mark")
        .when(end.rlike(_BROKEN) | _open_tag(F.col("text")), "broken")
        .when(end.rlike(_DOTS), "dots")
        .when(end.rlike(_ENDED), "ended")
        .otherwise("open")
    )
    return rows.withColumn("kind", kind).withColumn("chars", F.length("value")).withColumn("bytes", F.octet_length("value"))


def _is_title() -> Column:
    """Whether a value only repeats the title: a headline, which needs no full stop."""
    return F.lower(_stripped(F.coalesce("title", F.lit("")))) == F.lower(F.col("text"))


def find_spikes(histogram, least: int, factor: float) -> list[tuple[int, int, int]]:
    """(lo, hi, n) of the spikes of a histogram of lengths, the highest limit first.

    The densest window of _WINDOW lengths is a spike if it holds at least `least` values and `factor` times what an even spread of
    all others over the lengths in use would put there. It is taken out, and the rest is searched again, so that a source
    with several limits shows each. A window whose single length dominates is narrowed to it.
    """
    import numpy as np

    histogram, found = histogram.copy(), []
    while histogram.any():
        top, low = int(np.flatnonzero(histogram).max()), int(np.flatnonzero(histogram).min())
        sums = np.convolve(histogram, np.ones(_WINDOW), "valid") if len(histogram) >= _WINDOW else np.array([histogram.sum()])
        at = int(sums.argmax())
        n, all_ = float(sums[at]), float(histogram.sum())
        used = max(top - low + 1, _WINDOW)
        if n < least or n < factor * (all_ - n + 1) * _WINDOW / used:
            break
        window = histogram[at : at + _WINDOW]
        peak = int(window.argmax())
        if window[peak] >= 0.6 * n:
            found.append((at + peak, at + peak, int(window[peak])))
        else:
            found.append((at, min(at + _WINDOW - 1, top), int(n)))
        histogram[at : at + _WINDOW] = 0
    return sorted(found, reverse=True)


def length_spikes(articles: DataFrame, column: str = "summary", least: int = 8, factor: float = 6.0) -> DataFrame:
    """(source_id, unit, kind, lo, hi, n, share_above): limits that a source's values of a column show, in characters or bytes.

    One histogram for each source, unit and kind of end, see find_spikes; share_above is the share of the values that are longer: near
    0 where the spike is at the maximum. Histograms are aggregated before anything is gathered, and have as many bins as lengths.
    """
    rows = _shape(articles, column).filter(F.col("kind").isin("open", "dots", "mark")).filter("source_id is not null")
    if column != "title":
        rows = rows.filter(~_is_title())
    long = rows.select("source_id", "kind", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))).alias("unit", "length"))
    bins = long.groupBy("source_id", "unit", "kind", "length").agg(F.count("*").alias("n"))

    def search(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        histogram = np.zeros(int(pdf["length"].max()) + 1)
        np.add.at(histogram, pdf["length"].to_numpy(), pdf["n"].to_numpy())
        found = [(*keys, lo, hi, n, float(histogram[hi + 1 :].sum() / histogram.sum())) for lo, hi, n in find_spikes(histogram, least, factor)]
        return pd.DataFrame(found, columns=["source_id", "unit", "kind", "lo", "hi", "n", "share_above"])

    return bins.groupBy("source_id", "unit", "kind").applyInPandas(search, "source_id string, unit string, kind string, lo int, hi int, n bigint, share_above double")


def spikes_of_columns(articles: DataFrame) -> DataFrame:
    """length_spikes of titles, summaries and bodies: (column, ...)."""
    parts = [length_spikes(articles, c).withColumn("column", F.lit(c)) for c in ("title", "summary", "body")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _words(text: Column) -> Column:
    """Comparable words of a text: lower case, digits as 0, no punctuation."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9٠-٩۰-۹]+", "0"), r"[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]", "")
    return F.filter(F.split(F.regexp_replace(plain, r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda x: x != "")


def _last_two(words: Column) -> Column:
    return F.xxhash64(F.when(F.size(words) >= 2, F.concat_ws(" ", F.slice(words, -2, 2))))


def _endings(articles: DataFrame) -> DataFrame:
    """(pair, ends, inner): how often two words end a sentence or headline, or stand inside one, in titles and summaries."""
    shaped = _shape(articles)
    texts = articles.select(F.col("title").alias("t"), F.lit(True).alias("whole")).filter("t is not null").unionByName(shaped.select(F.col("text").alias("t"), (F.col("kind") == "ended").alias("whole")))
    pieces = F.filter(F.split("t", r"[.!?؟…]+[\x22»”“)\]]*(\s+|$)"), lambda x: F.trim(x) != "")
    parts = texts.select("whole", pieces.alias("pieces")).select("whole", F.size("pieces").alias("n"), F.posexplode("pieces").alias("pos", "s"))
    parts = parts.select("whole", (F.col("pos") == F.col("n") - 1).alias("last"), _words(F.col("s")).alias("w")).filter(F.size("w") >= 2)
    # a piece that is the rest of an unfinished text has no known end
    pairs = parts.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - 1),
                lambda i: F.struct(F.xxhash64(F.concat_ws(" ", F.slice("w", i, 2))).alias("pair"), (i == F.size("w") - 1).alias("end")),
            )
        ).alias("p"),
        (F.col("last") & ~F.col("whole")).alias("unknown"),
    )
    known = pairs.filter(~(F.col("unknown") & F.col("p.end")))
    return known.groupBy(F.col("p.pair").alias("pair")).agg(F.sum(F.col("p.end").cast("int")).alias("ends"), F.sum((~F.col("p.end")).cast("int")).alias("inner"))


def make_continuation() -> Callable[[str, str, str | None], str]:
    """How the body goes on where a value ends: word, sentence, end, or unknown."""
    import re
    import unicodedata

    drop = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0x640)}
    fold = drop | dict(zip(map(ord, "يىك" + _CYRILLIC + _GREEK), "ییک" + _CYR_LATIN + _GREEK_LATIN))
    junk = re.compile(r"(\[?\(?(…|\.{2,})\]?\)?|&#?\w*|<[^<>]*|�+|\\\w*)\s*$")
    spaces = re.compile(r"\s+")

    def plain(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text.replace("…", "\x01").replace("½", "\x02").replace("™", "\x03").replace("²", "\x04").replace("№", "\x05")).translate(fold)
        return text.replace("\x01", "…").lower()

    def continuation(value: str, kind: str, body: str | None) -> str:
        if not body or body.isspace():
            return "unknown"
        text = value.strip()
        if kind != "open":
            text = junk.sub("", text).rstrip()
        tail, short = spaces.sub(" ", plain(text))[-80:], False
        if len(tail) < 12:
            return "unknown"
        whole = spaces.sub(" ", plain(body.replace("\n", " \x00 ")))
        at = whole.find(tail)
        if at < 0:
            tail, short = tail[-40:], len(tail) > 40
            at = whole.find(tail)
        if at < 0:
            return "unknown"
        # the same words may stand in several places: the cut is one that goes on everywhere
        kinds = []
        while at >= 0:
            rest = whole[at + len(tail) : at + len(tail) + 3]
            if not rest or rest.startswith((" \x00", "\x00")) or rest[0] in ".!?؟":
                kinds.append("end")
            elif rest[0] in "»”\"“’'" and (len(rest) < 2 or rest[1] in ".!?؟ "):
                kinds.append("end" if len(rest) < 2 or rest[1] != " " else "sentence")
            else:
                kinds.append("word" if rest[0].isalnum() else "sentence")
            at = whole.find(tail, at + len(tail))
        if short and "word" not in kinds:
            return "unknown"  # so few characters may stand elsewhere in the body
        return "end" if "end" in kinds else kinds[0]

    return continuation


def _judge() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        continuation = make_continuation()
        for batch in batches:
            goes_on = [continuation(*x) for x in zip(batch["text"], batch["kind"], batch["body"])]
            yield batch.drop(columns=["body", "text"]).assign(goes_on=goes_on)

    return run


def judged_values(articles: DataFrame) -> DataFrame:
    """(article_id, source_id, kind, goes_on, at_spike, end_share, is_cut) of each non-blank summary.

    kind: mark, broken, dots, ended or open; goes_on: what the body does after the value's last words; at_spike:
    whether the length lies in a spike of its source; end_share: how often its last two words end a sentence.
    Repeated rows give repeated rows; null and blank summaries have none; a null source has no spikes; an empty
    table gives an empty result.
    """
    shaped = _shape(articles)
    doubtful = shaped.filter(F.col("kind").isin("open", "dots", "broken"))
    # values of one word have no pair; the hash of their id, which no pair has, spreads them over the join
    bare = F.regexp_replace("text", r"(\[?\(?(…|\.{2,})\]?\)?|&#?\w*|<[^<>]*|\x{fffd}+)\s*$", "")
    rows = doubtful.select("article_id", "source_id", "kind", "chars", "bytes", _is_title().alias("is_title"), F.col("text").rlike("[,،;؛:(–—-]$").alias("goes_on_mark"), F.coalesce(_last_two(_words(bare)), F.xxhash64("article_id")).alias("pair"), "text", "body")
    schema = "article_id bigint, source_id string, kind string, chars int, bytes int, is_title boolean, goes_on_mark boolean, pair bigint, goes_on string"
    rows = rows.mapInPandas(_judge(), schema)
    spikes = length_spikes(articles).filter("kind <> 'mark'").groupBy(F.col("source_id").alias("__s"), F.col("kind").alias("__k")).agg(F.collect_list(F.struct("unit", "lo", "hi")).alias("spikes"))
    rows = rows.join(spikes, (F.col("source_id") == F.col("__s")) & (F.col("kind") == F.col("__k")), "left")
    at_spike = F.coalesce(F.exists("spikes", lambda s: F.when(s["unit"] == "chars", F.col("chars").between(s["lo"], s["hi"])).otherwise(F.col("bytes").between(s["lo"], s["hi"]))), F.lit(False))
    rows = rows.withColumn("at_spike", at_spike).join(_endings(articles), "pair", "left")
    share = F.col("ends") / (F.col("ends") + F.col("inner"))
    # at a spike only a usual end of a sentence is believed; elsewhere only words that hardly ever end one are cut
    goes_on = F.col("goes_on").isin("word", "sentence") | F.col("goes_on_mark")
    open_cut = F.when(F.col("is_title") | (F.col("goes_on") == "end"), False).when(goes_on, True).otherwise(F.coalesce(share < F.when(F.col("at_spike"), 0.8).otherwise(0.15), F.lit(True)))
    dots_cut = F.when(F.col("goes_on") == "end", False).when(goes_on, True).otherwise(F.coalesce(share < F.when(F.col("at_spike"), 0.95).otherwise(0.1), F.lit(True)))
    judged = rows.select("article_id", "source_id", "kind", "goes_on", "at_spike", share.alias("end_share"), F.when(F.col("kind") == "broken", True).when(F.col("kind") == "dots", dots_cut).otherwise(open_cut).alias("is_cut"))
    plain = shaped.filter(F.col("kind").isin("mark", "ended")).select("article_id", "source_id", "kind", F.lit(None).cast("string").alias("goes_on"), F.lit(False).alias("at_spike"), F.lit(None).cast("double").alias("end_share"), (F.col("kind") == "mark").alias("is_cut"))
    return judged.unionByName(plain)


def truncated_found(articles: DataFrame) -> DataFrame:
    """(article_id) of summaries that were cut."""
    return judged_values(articles).filter("is_cut").select("article_id").distinct()


def truncation_by_source(articles: DataFrame) -> DataFrame:
    """(source_id, n, n_cut, share): how often each source's non-blank summaries were cut."""
    rows = judged_values(articles).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("is_cut").alias("n_cut"))
    return rows.withColumn("share", F.round(F.col("n_cut") / F.col("n"), 6))
