"""Problem 3: visually identical text with different characters, brought to one consistent form.

Three steps for each value: compatibility normalisation of presentation forms (typographic signs are left alone),
deletion of ignorable characters and plain spaces, canonical composition; then a Viterbi search over the
look-alike lattice of each token that mixes alphabets, and of each Arabic-script token, whose look-alikes are
the letters and digits of Arabic and Persian. A path stays in one alphabet; its score is that of a character
bigram model of the alphabet's language, counted over all labelled samples by Spark.
A value is a case where its form changes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: labelled_samples() gives at most so many of each language, the smallest sample_ids.
MAX_SAMPLES = 2000

#: Letters of other alphabets and the Latin letters they look like, in the order of the first string.
_CYRILLIC = "абвгеокмнпрстухієѕјһԛԝьАВЕЗКМНОРСТУХІЅЈЬЄ"
_CYR_LATIN = "a6brеokmhnpctyxiesjhqwbABE3KMHOPCTYXISJbE".replace("е", "e")
_GREEK = "αβγεικνορτυχωϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ"
_GREEK_LATIN = "aßyeikvoptuxwcjABEZHIKMNOPTYXC"

#: Arabic characters and the Persian ones that look the same.
_ARABIC, _PERSIAN = "يىك٠١٢٣٧٨٩", "ییک۰۱۲۳۷۸۹"


def _tables() -> dict:
    """Character tables by rule: what to delete, what to make a space, and single forms of presentation forms."""
    compat: dict[int, str] = {}
    wanted = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>", "<small>", "<vertical>")
    for lo, hi in ((0xFB00, 0xFE00), (0xFE10, 0xFE1A), (0xFE30, 0xFE70), (0xFE70, 0xFF00), (0xFF00, 0xFFEF), (0x1D400, 0x1D800), (0x2100, 0x2150), (0x0132, 0x0134), (0x01C4, 0x01F4), (0x0675, 0x0679), (0x10780, 0x107C0)):
        for code in range(lo, hi):
            kind = unicodedata.decomposition(chr(code)).split(" ")[0]
            if kind in wanted or (kind == "<compat>" and not 0x2100 <= code < 0x2150):
                compat[code] = unicodedata.normalize("NFKC", chr(code))
    invisible = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200D, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xE0100, 0xE01F0)]
    spaces = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    return {"compat": compat, "invisible": invisible, "spaces": spaces}


def _script(ch: str) -> str:
    """Alphabet of a letter: L, G, C, A (Arabic script), or another block; empty for other characters."""
    code = ord(ch)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "L" if ch.isalpha() and code not in (0xAA, 0xBA, 0xB5) else ""
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "G" if ch.isalpha() else ""
    if 0x400 <= code < 0x530:
        return "C" if ch.isalpha() else ""
    if 0x600 <= code < 0x780 or 0x8A0 <= code < 0x900:
        return "A" if ch.isalpha() else ""
    return f"x{code >> 8}" if ch.isalpha() else ""


class Bigrams:
    """Character bigram model with add-k smoothing, of pairs of characters and how often they stand in words (blanks at both ends)."""

    def __init__(self, pairs: dict[tuple[str, str], int], k: float = 0.05) -> None:
        firsts: Counter = Counter()
        for (a, _), n in pairs.items():
            firsts[a] += n
        self.k, self.n, self.pairs, self.firsts = k, len({ch for pair in pairs for ch in pair}) + 50, dict(pairs), dict(firsts)

    def score(self, a: str, b: str) -> float:
        return math.log((self.pairs.get((a, b), 0) + self.k) / (self.firsts.get(a, 0) + self.k * self.n))

    def word(self, word: str) -> float:
        chars = f" {word} "
        return sum(map(self.score, chars, chars[1:]))


def model_pairs(samples: Iterable[tuple[str, str]]) -> Counter:
    """How often each (model, character, next character) stands in the words of (language, text); the models are named by
    language code, Arabic and Persian have one of the shared letter forms, too."""
    fold = str.maketrans("يىك", "ییک")
    pairs: Counter = Counter()
    for lang, text in samples:
        text = unicodedata.normalize("NFC", text)
        for name, form in ((lang, text.lower()), *([(f"{lang}~", text.translate(fold))] if lang in ("ar", "fa") else [])):
            for word in re.findall(r"[^\W_\d]+", form):
                chars = f" {word} "
                pairs.update((name, a, b) for a, b in zip(chars, chars[1:]))
    return pairs


def models_of(counts: Iterable[tuple[str, str, str, int]]) -> dict[str, Bigrams]:
    """Bigram models by name from counts (model, character, next character, n)."""
    by: dict[str, dict[tuple[str, str], int]] = {"ar~": {}, "fa~": {}}
    for name, a, b, n in counts:
        by.setdefault(name, {})[a, b] = n
    return {name: Bigrams(pairs) for name, pairs in by.items()}


def fit_models(samples: list[tuple[str, str]]) -> dict[str, Bigrams]:
    """models_of() the samples' pairs."""
    return models_of((*key, n) for key, n in model_pairs(samples).items())


def viterbi(options: list[list[tuple[str, str]]], models: dict[str, list[Bigrams]], cost: Callable[[int, str], float]) -> str | None:
    """Best path through a lattice of (alphabet, character) that stays in one alphabet; None where none does.

    models: the bigram models of an alphabet, of which the best counts; cost: of a replaced character.
    """
    best: tuple[float, str] | None = None
    for alphabet in sorted({a for a, _ in options[0]}):
        for model in models.get(alphabet, []):
            front = {" ": (0.0, "")}
            for at, column in enumerate(options):
                after: dict[str, tuple[float, str]] = {}
                for a, ch in column:
                    if a in (alphabet, "*"):
                        step = max((s + model.score(p.lower(), ch.lower()) - cost(at, ch), path + ch) for p, (s, path) in front.items())
                        if ch not in after or step > after[ch]:
                            after[ch] = step
                front = after
                if not front:
                    break
            if front:
                end = max((s + model.score(p.lower(), " "), path) for p, (s, path) in front.items())
                best = end if best is None or end > best else best
    return best[1] if best else None


def make_normaliser(models: dict[str, Bigrams]) -> Callable[[str], str]:
    """A function from a value to its consistent form."""
    tables = _tables()
    compat = tables["compat"]
    plain = {**compat, **{c: None for c in tables["invisible"]}, **{c: " " for c in tables["spaces"]}}
    # anything outside ordinary Latin and Arabic text that needs the long way
    marks = [*range(0x300, 0x370), *range(0x483, 0x48A), 0x653, 0x654, 0x655, *range(0x1AB0, 0x1B00), *range(0x20D0, 0x2100)]
    calm = frozenset(map(chr, [*tables["invisible"], *tables["spaces"], *marks, *compat, *range(0x370, 0x530), 0x200C])).isdisjoint
    arabic_letters = re.compile("[ء-ۿ]").search
    arabic_side = frozenset("یک۰۱۲۳۷۸۹").isdisjoint
    words = re.compile(r"[^\W_\d][^\W_]*(?:‌[^\W_]+)*").finditer
    arabic_words = re.compile(r"[ء-غف-يٱ-ۓ‌]+").findall
    numbers = re.compile(r"[٠-٩۰-۹]+")
    fold = str.maketrans("يىك", "ییک")
    to_persian = str.maketrans(_ARABIC + "٤٥٦", _PERSIAN + "۴۵۶")
    digits_ar = str.maketrans("۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩")
    latin_of = dict(zip(_CYRILLIC, _CYR_LATIN)) | dict(zip(_GREEK, _GREEK_LATIN))
    others_of: dict[str, list[str]] = {}
    for other, latin in latin_of.items():
        others_of.setdefault(latin, []).append(other)
    # a model scores paths in the alphabet that most of its letters are of; an alphabet without any is flat
    flat = Bigrams({})
    by_alphabet: dict[str, list[Bigrams]] = {}
    for x in sorted(models):
        kinds = Counter()
        for ch, n in models[x].firsts.items():
            kinds[_script(ch)] += n if _script(ch) else 0
        if kinds and not x.endswith("~"):
            by_alphabet.setdefault(kinds.most_common(1)[0][0], []).append(models[x])
    by_alphabet = {a: by_alphabet.get(a) or [flat] for a in "LCG"}
    ar, fa = models["ar~"], models["fa~"]
    own = {False: models.get("ar", flat), True: models.get("fa", flat)}
    # what a look-alike of the other language may be in this one
    columns = {False: {"ی": ["ي", "ى"], "ک": ["ك"]}, True: {"ي": ["ی"], "ى": ["ی"], "ك": ["ک"]}}
    ratio: dict[str, float] = {}

    def fresh_lean(word: str) -> float:
        if len(ratio) > 200_000:
            ratio.clear()
        x = ratio[word] = sum(fa.word(p) - ar.word(p) for p in word.translate(fold).split("‌") if p)
        return x

    def lean(text: str) -> float:
        """How much more Persian than Arabic a text is; the look-alikes of the two count as one."""
        get = ratio.get
        return sum([x if (x := get(w)) is not None else fresh_lean(w) for w in arabic_words(text)])

    def mixed(match: re.Match) -> str:
        word = match.group()
        kinds = {s for s in map(_script, word) if s}
        if len(kinds) < 2 or not kinds <= {"L", "C", "G"}:
            return word
        options = []
        for ch in word:
            own = _script(ch)
            column = [(own or "*", ch)]
            if ch in latin_of:
                column.append(("L", latin_of[ch]))
            for other in others_of.get(ch, []):
                column.append((_script(other), other))
            options.append(column)
        start = {a for column in options for a, _ in column}
        options[0] = [x for x in options[0] if x[0] in start]
        found = viterbi(options, by_alphabet, lambda at, ch: 0.0 if ch == word[at] else 0.7)
        return found or word

    def arabic(text: str, persian: bool) -> str:
        """Letters and digits of the language that the whole value is in."""

        def letters(match: re.Match) -> str:
            word, column = match.group(), columns[persian]
            if not persian:
                word = word.replace("‌", "")
            if column.keys().isdisjoint(word):
                return word
            options = [[("A", y) for y in column.get(ch, [ch])] for ch in word]
            return viterbi(options, {"A": [own[persian]]}, lambda at, ch: 0.0) or word

        out = re.sub(r"[ء-غف-يٱ-ۓ](?:[ء-غـ-ٰٟ-ۓ‌]*[ء-غـ-ٰٟ-ۓ])?", letters, text)
        look = re.compile("[٠١٢٣٧٨٩]" if persian else "[۰۱۲۳۷۸۹]").search
        turn = to_persian if persian else digits_ar
        return numbers.sub(lambda m: m.group().translate(turn) if look(m.group()) else m.group(), out)

    def normalise(value: str) -> str:
        if value.isascii():
            return value
        if not calm(value):
            value = unicodedata.normalize("NFC", value.translate(plain))
            value = words_sub(mixed, value)
        if arabic_letters(value):
            persian = lean(value) > 0
            return arabic(value, persian) if persian or not arabic_side(value) or "‌" in value else value
        return value.replace("‌", "")

    words_sub = re.compile(r"[^\W_\d][^\W_]*").sub
    return normalise


def mixes_alphabets(text: str) -> bool:
    """Whether a word holds letters of two of the Latin, Greek and Cyrillic alphabets, for which no path in one alphabet was found."""
    if text.isascii() or not _GREEK_CYRILLIC(text):
        return False
    return any(len({s for s in map(_script, word) if s in ("L", "G", "C")}) > 1 for word in _WORDS(text))


_GREEK_CYRILLIC = re.compile("[\u0370-\u052f\u1f00-\u1fff]").search
_WORDS = re.compile(r"[^\W_\d]+").findall


def _apply(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normalise = make_normaliser(models_of(shared.value))
        for batch in batches:
            texts = [normalise(v) for v in batch["value"]]
            yield pd.DataFrame({"article_id": batch["article_id"], "field": batch["field"], "value": batch["value"], "text": texts, "is_mixed": [mixes_alphabets(t) for t in texts]})

    return run


def labelled_samples(samples: DataFrame, most: int = MAX_SAMPLES) -> list[tuple[str, str]]:
    """(language, text) of at most `most` samples of each of the labelled languages, the smallest sample_ids."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("lang").orderBy("sample_id", "text"))
    rows = samples.filter("lang is not null and text is not null").withColumn("__r", rank).filter(F.col("__r") <= most)
    return [(r["lang"], r["text"]) for r in rows.select("lang", "text").sort("lang", "text").collect()]


def pair_counts(samples: DataFrame, count: Callable[[Iterable[tuple[str, str]]], Counter]) -> list[tuple[str, str, str, int]]:
    """(model, character, next character, n) over all labelled samples, sorted; count: of the (language, text) of a batch.

    The samples are counted where they are; the pairs of the alphabets reach the driver, never the texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = count(zip(batch["lang"], batch["text"]))
            yield pd.DataFrame([(*key, n) for key, n in found.items()], columns=["model", "a", "b", "n"])

    rows = samples.filter("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInPandas(run, "model string, a string, b string, n bigint").groupBy("model", "a", "b").agg(F.sum("n").alias("n"))
    return sorted(tuple(r) for r in counts.collect())


def consistent_forms(articles: DataFrame, samples: DataFrame) -> DataFrame:
    """(article_id, field, value, text, is_mixed): each title and summary with a character beyond ASCII, and its consistent form;
    is_mixed: a word mixes alphabets and could not be brought to one.

    Null and empty values and values of ASCII only are their own form and have no row. Repeated rows give repeated
    rows; extra columns are not read; without samples the models are flat and Arabic counts as Arabic; an empty
    table gives an empty result. No article is shuffled; the models are counted over all samples, and broadcast.
    """
    spark = articles.sparkSession
    long = articles.select("article_id", F.explode(F.map_from_arrays(F.array(F.lit("title"), F.lit("summary")), F.array("title", "summary"))).alias("field", "value"))
    rows = long.filter(F.col("article_id").isNotNull() & F.col("value").rlike("[^\\x00-\\x7F]"))
    shared = spark.sparkContext.broadcast(pair_counts(samples, model_pairs))
    return rows.mapInPandas(_apply(shared), "article_id bigint, field string, value string, text string, is_mixed boolean")


def lookalikes_found(articles: DataFrame, samples: DataFrame) -> DataFrame:
    """(article_id, field) of values that hold characters to be replaced or deleted."""
    return consistent_forms(articles, samples).filter("text <> value or is_mixed").select("article_id", "field").distinct()
