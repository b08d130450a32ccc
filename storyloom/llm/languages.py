"""Problem 2: a language with a confidence for each article and each line.

Language-bitmask n-gram filter: one table of bit-sliced Bloom filters holds a bit for each language in every slot.
The AND of an n-gram's slots gives at once all languages that contain it. For each line the bits are counted per
language, the counts are corrected for the filter's false positives (known from the fill of each language's
slice), and the largest decides. Batches are hashed as one array of code points, so that a worker makes no step
per character or per n-gram in Python.

The filter is fitted on the labelled samples, at most MAX_SAMPLES of each language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.lookalikes import labelled_samples

GRAM = 4
SLOT_BITS = 20
#: A line is clear by itself if its best language has so much more of its n-grams than the second,
MARGIN = 0.2
#: and differs from a body in the same script if it leads by such a share of its n-grams and so many of them
#: (names and single words, which any language may have, stay below).
LEAD, LEAST_LEAD = 0.3, 20
#: In another script so many n-grams are enough.
LEAST_GRAMS = 4
_SCHEMA = "article_id bigint, line_no int, lang string, confidence double, label string, is_case boolean"


def make_grams() -> Callable:
    """A function from texts to (text number, hash) of all their n-grams and, of each text, the share of letters beyond Latin."""
    import unicodedata

    import numpy as np

    # letters in lower case and one form, everything else a blank; 0: deleted; line feeds separate texts
    fold = np.full(0x110000, 32, dtype=np.uint32)
    for code in range(0x30000):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind[0] in "LM":
            fold[code] = ord(unicodedata.normalize("NFKC", ch)[0].lower()[0]) if kind[0] == "L" else 0
        elif kind == "Cf" and code != 0x200C:
            fold[code] = 0
    for a, b in zip("يىك’", "ییک'"):
        fold[ord(a)] = ord(b)
    fold[ord("'")] = ord("'")
    fold[10] = 10

    def grams(texts: list[str]):
        codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = fold[codes]
        codes = codes[codes != 0]
        # a line feed acts as a blank on both sides: widen it, then drop repeated blanks
        breaks = codes == 10
        wide = np.repeat(codes, np.where(breaks, 3, 1))
        at = np.flatnonzero(wide == 10)
        wide[at[0::3]] = 32
        wide[at[2::3]] = 32
        blank = wide == 32
        wide = wide[~(blank & np.concatenate([[False], blank[:-1]]))]
        line = np.cumsum(wide == 10) - 1
        letters = np.bincount(line[wide > 32], minlength=len(texts))[: len(texts)]
        beyond = np.bincount(line[wide >= 0x370], minlength=len(texts))[: len(texts)] / np.maximum(letters, 1)
        n = len(wide) - GRAM + 1
        row = line[:n]
        h = np.zeros(n, dtype=np.uint64)
        ends = np.zeros(n, dtype=bool)
        for k in range(GRAM):
            part = wide[k : k + n]
            h = h * np.uint64(0x100000001B3) + part
            ends |= part == 10
        good = ~ends
        h = h[good]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return row[good], h, beyond

    return grams


def make_classifier(samples: list[tuple[str, str]]) -> tuple[list[str], Callable]:
    """(languages, function from texts to the number of n-grams and the corrected hits of each language)."""
    import numpy as np

    grams = make_grams()
    languages = sorted({lang for lang, _ in samples})
    size, mask = 1 << SLOT_BITS, np.uint64((1 << SLOT_BITS) - 1)
    # 64 languages to a word
    tables = [np.zeros(size, dtype=np.uint64) for _ in range(0, len(languages), 64)]
    for bit, lang in enumerate(languages):
        _, h, _ = grams([" ".join(text.split("\n")) for x, text in samples if x == lang])
        for slot in (h & mask, (h >> np.uint64(SLOT_BITS)) & mask):
            tables[bit // 64][slot] |= np.uint64(1 << bit % 64)
    false = [float(((tables[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).mean()) ** 2 for bit in range(len(languages))]

    def classify(texts: list[str]):
        row, h, beyond = grams(texts)
        found = [table[h & mask] & table[(h >> np.uint64(SLOT_BITS)) & mask] for table in tables]
        n = np.bincount(row, minlength=len(texts)).astype(float)
        hits = np.zeros((len(languages), len(texts)))
        for bit in range(len(languages)):
            seen = np.bincount(row[(found[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1], minlength=len(texts))
            hits[bit] = np.maximum(0, seen - n * false[bit]) / (1 - false[bit])
        return n, hits, beyond > 0.5

    return languages, classify


def canonical_label(label: str | None) -> str:
    """Label in lower case without blanks and region; empty for a missing one."""
    text = (label or "").strip().lower().replace("_", "-").split("-")[0]
    return "" if text == "und" else text


def _apply(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        languages, classify = make_classifier(shared.value)
        codes = np.array([*languages, None], dtype=object)
        none = len(languages)
        for whole in batches:
            for start in range(0, len(whole), 2000):
                batch = whole.iloc[start : start + 2000]
                texts: list[str] = []
                owner: list[int] = []
                number: list[int] = []
                for i, (title, body) in enumerate(zip(batch["title"], batch["body"])):
                    if body and not body.isspace():
                        lines = body.split("\n")
                        number.extend(range(1, len(lines) + 1))
                    else:
                        lines = [(title or "").replace("\n", " ")]
                        number.append(0)
                    texts.extend(lines)
                    owner.extend([i] * len(lines))
                if not languages or not texts:
                    continue
                n, hits, other = classify(texts)
                own, num, rows = np.array(owner), np.array(number), len(batch)
                order = np.sort(hits, axis=0)
                best, top = hits.argmax(axis=0), order[-1]
                second = order[-2] if len(languages) > 1 else np.zeros_like(top)
                sure = (top > 0) & (top - second >= MARGIN * np.maximum(n, 1))
                votes = np.zeros((len(languages) + 1, rows))
                np.add.at(votes, (np.where(sure, best, none), own), n)
                total = np.zeros((len(languages), rows))
                for bit in range(len(languages)):
                    total[bit] = np.bincount(own, weights=hits[bit], minlength=rows)
                # lines without a clear language count where the whole of the article's n-grams points
                whole_best = total.argmax(axis=0)
                votes[whole_best, np.arange(rows)] += votes[none]
                main = np.where(total.max(axis=0) > 0, votes[:none].argmax(axis=0), none)
                share = votes[:none].max(axis=0) / np.maximum(votes[:none].sum(axis=0), 1)
                clear = np.sort(total, axis=0)
                lead = (clear[-1] - (clear[-2] if len(languages) > 1 else 0)) / np.maximum(clear[-1], 1e-9)
                confidence = np.where(main < none, np.clip(share * (0.5 + 0.5 * lead), 0, 1), 0.0)
                labels = [canonical_label(x) for x in batch["lang"]]
                found = codes[main]
                case = [bool(x is not None and x != y) for x, y in zip(found, labels)]
                out = [pd.DataFrame({"article_id": batch["article_id"].to_numpy(), "line_no": np.zeros(rows, dtype=np.int32), "lang": found, "confidence": confidence, "label": batch["lang"].to_numpy(), "is_case": case})]
                body_lang = main[own]
                known = body_lang < none
                of_body = np.where(known, hits[np.minimum(body_lang, none - 1), np.arange(len(own))], 0.0)
                # the script of an article is that of most of its n-grams; weak lines in the other script take
                # the language of all the article's lines in that script
                script = np.bincount(own, weights=np.where(other, n, -n), minlength=rows)[own] > 0
                foreign = (num > 0) & (other != script)
                apart = np.zeros((len(languages), rows))
                for bit in range(len(languages)):
                    apart[bit] = np.bincount(own[foreign], weights=hits[bit][foreign], minlength=rows)
                best = np.where(foreign & (top - second < LEAST_LEAD), apart.argmax(axis=0)[own], best)
                lead = hits[best, np.arange(len(own))] - of_body
                differs = (num > 0) & (best != body_lang) & known & ((lead >= np.maximum(LEAD * n, LEAST_LEAD)) | (foreign & (n >= LEAST_GRAMS) & (lead > 0)))
                line_lang = np.where(differs | sure, best, body_lang)
                line_conf = np.clip(0.5 + 0.5 * (np.where(differs | sure, top - second, of_body - np.where(best == body_lang, second, top))) / np.maximum(top, 1e-9), 0, 1)
                keep = (num > 0) & (n > 0)
                out.append(pd.DataFrame({"article_id": batch["article_id"].to_numpy()[own[keep]], "line_no": num[keep].astype(np.int32), "lang": codes[line_lang[keep]], "confidence": line_conf[keep], "label": None, "is_case": differs[keep]}))
                yield pd.concat(out, ignore_index=True)

    return run


def languages_of(articles: DataFrame, samples: DataFrame) -> DataFrame:
    """(article_id, line_no, lang, confidence, label, is_case): line_no 0 for the article, from 1 for its lines with a letter.

    is_case: the label is missing or names another language than the article's (line 0), or the line is in another
    language than most of the body. An article whose body is blank is judged by its title; without any known n-gram
    the language is null with confidence 0, which is no case. Repeated rows give repeated rows; extra columns are not
    read; an empty table, or no samples, gives an empty result. No shuffle; the broadcast samples are bounded.
    """
    shared = articles.sparkSession.sparkContext.broadcast(labelled_samples(samples))
    rows = articles.filter("article_id is not null").select("article_id", "lang", "title", "body")
    return rows.mapInPandas(_apply(shared), _SCHEMA)


def languages_found(articles: DataFrame, samples: DataFrame) -> DataFrame:
    """(article_id, line_no, lang) of wrong or missing labels and of lines in another language."""
    return languages_of(articles, samples).filter("is_case").select("article_id", "line_no", "lang").distinct()
