"""Text functions as column expressions: normal forms, tokens, stems, fingerprints, similarity (F-1 to F-16)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from storyloom.vocab.words import CASUALTY, COUNTS, GENERIC, NUMBER_WORDS, STOPWORDS, Lexicon

MARKS = r"[\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6ed}\x{640}]"
FOLD_FROM, FOLD_TO = "آأإٱةىؤئ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "ااااهيوي01234567890123456789"
#: The shortest stem takes the longest suffix; no other suffix ends in e, so that one pattern holds them all.
STEM = r"^([a-z]{4,}?)(?:ations|ation|ements|ement|ings|ing|ers|er|ed|es|s|e)$"
YEAR = r"^(19|20)\d\d$"


@F.pandas_udf(StringType())
def nfkc(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility form; Spark has no expression for it."""
    for s in values:
        yield s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def normalize_text(text: Column, compatibility: bool = False) -> Column:
    """Marks and tatweel dropped, Arabic letters and digits folded, punctuation as blanks (the Arabic block is kept), lower case.

    compatibility: apply NFKC first, in Python; otherwise the whole expression stays in the JVM.
    """
    t = nfkc(text) if compatibility else text
    t = F.translate(F.regexp_replace(F.coalesce(t, F.lit("")), MARKS, ""), FOLD_FROM, FOLD_TO)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s\x{600}-\x{6ff}]+", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def words_of(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def meaningful(words: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words without stopwords and single characters."""
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))


def tokens(text: Column, compatibility: bool = False) -> Column:
    """Distinct meaningful words."""
    return F.array_distinct(meaningful(words_of(normalize_text(text, compatibility))))


def fingerprint(text: Column, compatibility: bool = False) -> Column:
    """Short stable hash of a headline's meaningful words."""
    return F.substring(F.sha1(F.array_join(meaningful(words_of(normalize_text(text, compatibility))), " ")), 1, 16)


def stem(word: Column) -> Column:
    """Light stem of an ASCII word of five letters or more: the longest fitting suffix goes, else a last e."""
    return F.regexp_replace(word, STEM, "$1")


def stem_word(word: str) -> str:
    """stem() for one Python string."""
    return re.sub(STEM, r"\1", word)


def canonical_tokens(text: Column, lexicon: Lexicon | None = None, compatibility: bool = False) -> Column:
    """Distinct stems without stopwords, bare years and single letters; number words as digits.

    With aliases the phrases are replaced first, longest first from left to right, in a vectorised Python function;
    without any, and without NFKC (compatibility), the expression stays in the JVM.
    """
    lexicon = lexicon or Lexicon()
    normal = normalize_text(text, compatibility)
    words = alias_words(lexicon)(normal) if lexicon.aliases else words_of(normal)
    numbers = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    stop = sorted({*lexicon.stopwords, *map(stem_word, lexicon.stopwords)})
    stems = F.transform(words, lambda w: stem(F.coalesce(F.try_element_at(numbers, w), w)))
    return F.array_distinct(F.filter(stems, lambda t: ~t.isin(*stop) & ~t.rlike(YEAR) & ((F.length(t) > 1) | t.rlike(r"^\d+$"))))


def distinctive(canonical: Column, generic: tuple[str, ...] = GENERIC) -> Column:
    """Canonical tokens that are no generic words."""
    return F.array_except(canonical, F.array(*[F.lit(w) for w in sorted({*generic, *map(stem_word, generic)})]))


def normal_python(text: str) -> str:
    """normalize_text for one Python string (with NFKC)."""
    text = re.sub("[ؐ-ًؚ-ٰٟۖ-ۭـ]", "", unicodedata.normalize("NFKC", text or ""))
    text = re.sub(r"[^\w\s؀-ۿ]+", " ", text.translate(str.maketrans(FOLD_FROM, FOLD_TO)))
    return re.sub(r"\s+", " ", text).strip().lower()


def alias_words(lexicon: Lexicon):
    """A pandas function from normal text to words with aliases replaced.

    Phrases are found by their first word. The Arabic conjunction is split off where the rest is a one-word alias.
    """
    table = {tuple(normal_python(k).split()): v.split() for k, v in lexicon.aliases.items() if normal_python(k)}
    singles = {k[0] for k in table if len(k) == 1}
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for phrase in sorted(table, key=lambda p: -len(p)):
        by_first.setdefault(phrase[0], []).append(phrase)

    def replace(normal: str | None) -> list[str]:
        words = [w[1:] if len(w) > 4 and w[0] == "و" and w not in singles and w[1:] in singles else w for w in (normal or "").split()]
        out, i = [], 0
        while i < len(words):
            phrase = next((p for p in by_first.get(words[i], ()) if tuple(words[i : i + len(p)]) == p), None)
            out.extend(table[phrase] if phrase else words[i : i + 1])
            i += len(phrase) if phrase else 1
        return out

    @F.pandas_udf(ArrayType(StringType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(replace)

    return run


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if either is empty. (Always at least as large as jaccard.)"""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def numbers_disagree(a: Column, b: Column) -> Column:
    """Veto: both speak of casualties in disjoint words, or both state counts from 1 to 20 and the counts differ."""
    words, counts = F.array(*[F.lit(x) for x in CASUALTY]), F.array(*[F.lit(x) for x in COUNTS])
    ca, cb, na, nb = F.array_intersect(a, words), F.array_intersect(b, words), F.array_intersect(a, counts), F.array_intersect(b, counts)
    return ((F.size(ca) > 0) & (F.size(cb) > 0) & ~F.arrays_overlap(ca, cb)) | ((F.size(na) > 0) & (F.size(nb) > 0) & (F.array_sort(na) != F.array_sort(nb)))


def truncate(text: Column, limit: int, suffix: str = "…") -> Column:
    """Trimmed; beyond `limit` cut there, back to the last blank, with a suffix."""
    t = F.trim(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.regexp_replace(F.substring(t, 1, limit), r" [^ ]*$", "")), F.lit(suffix)))


def slug(text: Column, limit: int = 60) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(normalize_text(text), r"[^\p{L}\p{N}]+", "-"), 1, limit), r"^-+|-+$", "")


def first_sentences(text: Column, n: int = 3, limit: int = 420) -> Column:
    parts = F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[.!?؟])\s+"), 1, n)
    return truncate(F.array_join(parts, " "), limit)


def squash(name: Column) -> Column:
    """Lower case Latin letters, digits and Arabic characters only."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9\x{600}-\x{6ff}]", "")


def relax(squashed: Column) -> Column:
    """Spelling variants of transliterated names as one."""
    t = F.regexp_replace(F.regexp_replace(squashed, "([ae])y", "$1i"), "ei", "i")
    return F.regexp_replace(t, r"(.)\1+", "$1")


def without_cdata(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^\s*<!\[CDATA\[|\]\]>\s*$", ""))


@F.pandas_udf(StringType())
def title_case(values: pd.Series) -> pd.Series:
    """Python's title case for ASCII names; others as they are."""
    return values.map(lambda v: v if v is None or not v.isascii() else v.title())


def escape_html(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\`*_\[\]<>|])", r"\\$1"), r"\s+", " ")


@F.pandas_udf(StringType())
def unescape_html(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))
