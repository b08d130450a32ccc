import random

import pytest

from storyloom.llm import languages as G
from storyloom.llm import lookalikes as K
from storyloom.llm import mojibake as M
from storyloom.llm import truncation as T


@pytest.fixture(scope="module")
def samples(spark, small):
    return spark.read.parquet(f"{small}/lang_samples.parquet").cache()


@pytest.fixture(scope="module")
def pairs(samples):
    return K.labelled_samples(samples)


@pytest.fixture(scope="module")
def normalise(pairs):
    return K.make_normaliser(K.fit_models(pairs))


def test_consistent_forms(normalise):
    cases = {
        "plain text": "plain text",
        "ｆｕｌｌ ﬁsh": "full fish",
        "café  x": "café  x",
        "sof­t​": "soft",
        "wаtеr роwеr": "water power",
        "мост is a bridge": "мост is a bridge",
        "σχέδιο": "σχέδιο",
        "“quoted” — 25 m² ½ №7 ™ …": "“quoted” — 25 m² ½ №7 ™ …",
        "مُهم جدا": "مُهم جدا",
        "أعلنت شرکة المیاه الوطنية خطة": "أعلنت شركة المياه الوطنية خطة",
        "گفت که قيمت‌ها از بهار پایین آمده است": "گفت که قیمت‌ها از بهار پایین آمده است",
        "سجلوا ۱۲ طلبا في الانتظار": "سجلوا ١٢ طلبا في الانتظار",
        "ﺍﻟﺮﺑﻴﻊ في الشتاء": "الربيع في الشتاء",
        "so﹖ yes︀": "so? yes",
    }
    assert {k: normalise(k) for k in cases} == cases
    for value in cases.values():
        assert normalise(value) == value


def test_alphabets_have_their_own_models(pairs):
    """A Russian model scores Cyrillic paths, and leaves the Latin ones to the others."""
    russian = [("ru", x) for x in "мост через реку открыт вечером в понедельник|совет сказал что город построит новый порт|рыбаки вернулись домой".split("|")] * 30
    normalise = K.make_normaliser(K.fit_models([*pairs, *russian]))
    assert normalise("мoст чеpез реку") == "мост через реку" and normalise("wаtеr роwеr") == "water power"
    assert normalise("گفت که قيمت‌ها از بهار پایین آمده اسك") == "گفت که قیمت‌ها از بهار پایین آمده اسک"


def test_models_are_counted_over_all_samples(spark, pairs):
    """What stands only in the samples after the first thousands of a language counts, too."""
    russian = "мост через реку открыт вечером в понедельник|совет сказал что город построит новый порт|рыбаки вернулись домой".split("|") * 30
    rows = [(None, "fr", None), *[(i, "ru", "ж") for i in range(2 * K.MAX_SAMPLES)], *[(10_000 + i, "ru", x) for i, x in enumerate(russian)], *[(20_000 + i, lang, x) for i, (lang, x) in enumerate(pairs)]]
    samples = spark.createDataFrame(rows, "sample_id bigint, lang string, text string").repartition(5)
    articles = spark.createDataFrame([(1, "мoст", "wаtеr роwеr"), (2, "пopт", "сoвет")], "article_id bigint, title string, summary string")
    got = {(r["article_id"], r["field"]): r["text"] for r in K.consistent_forms(articles, samples).collect()}
    assert got == {(1, "title"): "мост", (1, "summary"): "water power", (2, "title"): "порт", (2, "summary"): "совет"}


def test_words_without_a_path_are_reported():
    assert K.mixes_alphabets("a wordж here") and not K.mixes_alphabets("слово and word") and not K.mixes_alphabets("25 µm") and not K.mixes_alphabets("日本語text")


def test_forms_of_tables(spark, samples):
    rows = spark.createDataFrame([(1, None, ""), (2, "ｘ", "ok"), (2, "ｘ", "ok"), (None, "ｘ", None), (3, "é" * 30_000, "a​b")], "article_id bigint, title string, summary string").selectExpr("*", "'x' as field")
    assert {tuple(r) for r in K.lookalikes_found(rows, samples).collect()} == {(2, "title"), (3, "summary")}
    assert K.lookalikes_found(rows.limit(0), samples).count() == 0
    assert K.lookalikes_found(rows, samples.limit(0)).count() == 2
    assert K.make_normaliser(K.fit_models([]))("شرکة") == "شركة"


def test_languages_of_held_out_samples(pairs):
    rng = random.Random(1)
    mixed = sorted(pairs)
    rng.shuffle(mixed)
    cut = len(mixed) // 2
    languages, classify = G.make_classifier(mixed[:cut])
    n, hits, _ = classify([t.replace("\n", " ") for _, t in mixed[cut:]])
    right = sum(languages[k] == lang for k, (lang, _) in zip(hits.argmax(axis=0), mixed[cut:]))
    assert right >= 0.97 * (len(mixed) - cut) and (n > 0).all()


def test_more_languages_than_bits_of_a_word(pairs):
    import string

    odd = [(f"x{i:03d}", " ".join(string.ascii_lowercase[(i * 7 + k) % 26] * 3 + string.ascii_lowercase[(i + k * 3) % 26] + str(i % 10) for k in range(40))) for i in range(70)]
    languages, classify = G.make_classifier([*odd, *[p for p in pairs if p[0] == "fr"], *[("zz", t) for x, t in pairs if x == "de"]])
    assert len(languages) == 72
    _, hits, _ = classify([t for x, t in pairs if x in ("de", "fr")])
    want = ["zz" if x == "de" else x for x, _ in pairs if x in ("de", "fr")]
    assert [languages[k] for k in hits.argmax(axis=0)] == want


def test_languages_of_articles(spark, samples, pairs):
    by = {}
    for lang, text in pairs:
        by.setdefault(lang, []).append(text.replace("\n", " "))
    en, fr, ar = ("\n".join(by[x][:4]) for x in ("en", "fr", "ar"))
    rows = [(1, "EN-gb ", None, en), (2, "ar", None, en), (3, None, by["fr"][0], " "), (4, "und", "", None), (5, "en", "x", en + "\n" + by["ar"][0] + "\n\n" + by["de"][1]), (6, "fr_FR", None, fr), (7, "fa", None, ar), (None, "en", None, fr), (8, "en", None, (en + "\n") * 400)]
    frame = spark.createDataFrame(rows, "article_id bigint, lang string, title string, body string").selectExpr("*", "1 as line_no", "2.0 as confidence")
    got = {tuple(r) for r in G.languages_found(frame, samples).collect()}
    assert got == {(2, 0, "en"), (3, 0, "fr"), (5, 5, "ar"), (5, 7, "de"), (7, 0, "ar")}
    every = G.languages_of(frame, samples)
    assert every.filter("confidence < 0 or confidence > 1").count() == 0
    assert G.languages_found(frame.limit(0), samples).count() == 0 and G.languages_found(frame, samples.limit(0)).count() == 0


def _garble(text, true, read):
    return text.encode(true).decode(read)


def test_mojibake_is_found_and_restored(spark, samples, pairs):
    by = {}
    for lang, text in pairs:
        by.setdefault(lang, []).append(text)
    arabic, french, english = by["ar"][1], by["fr"][1], by["en"][0]
    clean = [arabic, french, by["de"][2], by["fa"][0], "caf&#233; &amp; bar", "the Vilã and São Qelmo streets", "MAÇÃ stalls", "It was a jalapeño stall — or €5.", "", None, "日本語 한국 🚢", "x" * 50_000]
    bad = [
        (_garble(arabic, "utf-8", "latin-1"), arabic),
        (_garble(arabic, "cp1256", "latin-1"), arabic),
        (_garble(french + " à déjà été prêt", "utf-8", "cp850"), french + " à déjà été prêt"),
        (_garble("the café owner", "utf-8", "mac_roman"), "the café owner"),
        (english + "\n" + _garble(_garble("naïve “yes”", "utf-8", "latin-1"), "utf-8", "latin-1"), english + "\nnaïve “yes”"),
        ("a jalape&#195;&#177;o stall", "a jalapeño stall"),
    ]
    rows = [(i, "s", t) for i, t in enumerate(clean)] + [(100 + i, None if i == 3 else "s", t) for i, (t, _) in enumerate(bad)] + [(200, "s", "lost �� here"), (100, "s", bad[0][0])]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "'x' as mapping", "1 as runs")
    got = {r["doc_id"]: r["restored"] for r in M.restored_texts(frame, samples).collect()}
    assert set(got) == {*range(100, 106), 200}
    assert {k: got[k] for k in range(100, 106)} == {100 + i: want for i, (_, want) in enumerate(bad)}
    assert M.mojibake_found(frame.limit(0), samples).count() == 0


def test_bigrams_are_counted_over_all_samples(spark, pairs):
    """Letters that stand only in the samples after the first thousands of a language are known, too."""
    fill = [(i, "fr", "la rue") for i in range(2 * K.MAX_SAMPLES)]
    rows = [(None, "fr", None), *fill, *[(10_000 + i, lang, x) for i, (lang, x) in enumerate(pairs)]]
    samples = spark.createDataFrame(rows, "sample_id bigint, lang string, text string").repartition(5)
    texts = [t for x, t in pairs if x == "fr" and "é" in t][:20]
    documents = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)] + [(100 + i, "s", _garble(t, "utf-8", "latin-1")) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    assert {r["doc_id"]: r["restored"] for r in M.restored_texts(documents, samples).collect()} == {100 + i: t for i, t in enumerate(texts)}


def test_a_model_of_counts_is_that_of_the_texts(spark, samples, pairs):
    model, counted = M.Model([t for _, t in pairs]), M.Model.of(K.pair_counts(samples, M.model_pairs))
    assert (model.count, model.value, model.known, model.usual) == (counted.count, counted.value, counted.known, counted.usual)


def test_mojibake_of_characters_that_are_harmless_alone(spark, samples, pairs):
    words = ["the Vilã and São Qelmo streets", "voilà, là-bas", "the Île-d’Août fair", "DÉJÀ VU, À PARIS", "Österreich und Ägypten, Übung", "the «old» bridge"]
    bad = [_garble(w, "utf-8", "cp1256") for w in words] + ["the Vil&#1571;&pound; streets", "the Vilأ&pound; streets"]
    clean = ["the Vilã and São Qelmo streets", "voilà, là-bas", "تم افتتاح الجسر، أمس", "شهر بزرگ ما"]
    rows = [(i, "s", t) for i, t in enumerate(bad)] + [(100 + i, "s", t) for i, t in enumerate(clean)]
    # no sample holds ë, so that the model cannot tell; it must see the text nevertheless
    frame = spark.createDataFrame(rows + [(200, "t", _garble("Noël", "utf-8", "cp1256"))], "doc_id bigint, source string, text string")
    suspects = M.make_suspects(M.Model([t for _, t in pairs]))
    assert all(suspects([t for _, _, t in frame.collect() if t in bad or "أ«" in t]))
    got = {r["doc_id"]: r["restored"] for r in M.restored_texts(frame, samples).collect()}
    assert got == dict(enumerate([*words, "the Vilã streets", "the Vilã streets"]))


def _counted(texts):
    from collections import Counter

    cut, counts = M.make_symbols(M.all_swaps()), Counter()
    for text in texts:
        for word in text.split():
            if not word.isascii():
                chain = [" ", *cut(word), " "]
                counts.update(zip(chain, chain[1:]))
    return [(a, b, n) for (a, b), n in counts.items()]


def test_expectation_maximization_learns_the_cipher(pairs):
    texts = [_garble("".join(c for c in t if ord(c) < 128 or 0x621 <= ord(c) <= 0x64A), "iso8859-6", "latin-1") for lang, t in pairs if lang == "ar"]
    found = M.learn_ciphers(_counted(texts), M.Model([t for _, t in pairs]), M.all_swaps())
    right = [letter == _garble(s, "latin-1", "iso8859-6") for s, (letter, _) in found["iso8859-6>latin-1"].items() if 0xC1 <= ord(s) <= 0xEA]
    assert len(right) > 15 and sum(right) >= 0.9 * len(right)


def test_counts_overrule_the_reading_of_a_known_page(pairs):
    """A page that differs from a known one in two letters: what the words say wins."""
    texts = [t for lang, t in pairs if lang == "ar"]
    swapped = str.maketrans("لم", "مل")
    garbled = ["".join(c for c in t.translate(swapped) if ord(c) < 128 or 0x621 <= ord(c) <= 0x64A).encode("cp1256").decode("latin-1") for t in texts * 4]
    table = M.learn_ciphers(_counted(garbled), M.Model([t for _, t in pairs]), M.all_swaps())["cp1256>latin-1"]
    lam, mim = (_garble(c, "cp1256", "latin-1") for c in "لم")
    assert (table[lam][0], table[mim][0]) == ("م", "ل")


@pytest.mark.parametrize("true, read, lang, share", [("cp1256", "koi8-r", "ar", 0.97), ("cp1252", "koi8-r", "fr", 0.8), ("iso8859-6", "cp1251", "ar", 0.97)])
def test_a_swap_that_no_list_holds_is_learnt_and_restored(spark, samples, pairs, true, read, lang, share):
    assert (true, read) not in M.PAGE_SWAPS
    texts = [t.encode(true, "ignore").decode(true) for x, t in pairs if x == lang]
    texts = [a + " " + b for a, b in zip(texts, texts[1:])]
    rows = [(i, "s", _garble(t, true, read)) for i, t in enumerate(texts)] + [(1000 + i, "s", t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["restored"] for r in M.restored_texts(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), samples).collect()}
    assert set(got) == set(range(len(texts)))
    same = [x.lower() == y.lower() for i, t in enumerate(texts) for x, y in zip(got[i], t) if not y.isascii()]
    assert sum(same) >= share * len(same)


def test_another_language_is_no_cipher(pairs):
    russian = "В понедельник совет объявил о новом плане развития города и порта. Жители района сказали, что не видели таких перемен много лет. По словам директора школы, дети начнут учиться в новом здании осенью. Рыбаки вернулись домой поздно вечером, потому что море было очень неспокойным. Музей открыл выставку старых карт и морских приборов."
    assert M.FREE not in M.learn_ciphers(_counted([russian] * 10), M.Model([t for _, t in pairs]), M.all_swaps())


def test_nothing_is_found_without_the_learnt_mapping(pairs):
    restore = M.make_restorer(M.Model([t for _, t in pairs]), M.all_swaps())
    run = _garble(pairs[0][1].split("\n")[0], "utf-8", "latin-1")
    assert not restore(run, {})[2]
    table = M.learn_ciphers(_counted([run]), M.Model([t for _, t in pairs]), M.all_swaps())
    assert restore(run, table)[2]


def test_truncated_summaries(spark):
    rng = random.Random(2)
    ends = ["the plan was approved by the council.", "the ferry was late again.", "families needed a clear answer."]
    rows = []
    for i in range(300):
        body = " ".join(f"Paragraph {i} says that {rng.choice(ends)}" for _ in range(8))
        summary = body[:120] if i % 2 else body.split(".")[0] + "."
        rows.append((i, "cut", f"Council {i} meets", summary, body if i % 4 else None))
    rows += [(1000, "x", "A headline without a stop", "A headline without a stop", None), (1001, "x", "t", "It ends here [...]", None), (1002, "x", "t", "half a refer &quo", None), (1003, "x", "t", None, None), (1004, "x", "t", "  ", None), (1005, None, None, "lost�", None), (1006, "x", "t", "families needed a clear answer...", "families needed a clear answer. More."), (1006, "x", "t", "families needed a clear answer...", "families needed a clear answer. More.")]
    frame = spark.createDataFrame(rows, "article_id bigint, source_id string, title string, summary string, body string").selectExpr("*", "'x' as kind", "0 as chars")
    got = {r[0] for r in T.truncated_found(frame).collect()}
    # cut just before the stop of a sentence the body ends there, or just after it: not inside a sentence
    fine = {i for i in range(300) if rows[i][3].rstrip().endswith((".", "council", "again", "answer"))}
    want = {i for i in range(300) if i % 2} - fine | {1001, 1002, 1005}
    assert got - fine == want and len(want) > 100
    spikes = T.length_spikes(frame).filter("source_id = 'cut' and unit = 'chars'").collect()
    assert [(r["lo"], r["hi"]) for r in spikes] == [(120, 120)]
    shares = {r["source_id"]: r["share"] for r in T.truncation_by_source(frame).collect()}
    assert 0.4 < shares["cut"] < 0.6
    assert T.truncated_found(frame.limit(0)).count() == 0


def test_every_limit_of_a_source_shows():
    import numpy as np

    histogram = np.zeros(400)
    histogram[100:300] = 1
    histogram[160] += 200
    histogram[280] += 150
    assert [x[:2] for x in T.find_spikes(histogram, 8, 6.0)] == [(280, 280), (160, 160)]
    assert T.find_spikes(np.ones(400), 8, 6.0) == [] and T.find_spikes(np.zeros(5), 8, 6.0) == []


def test_long_open_tags_and_late_places(spark):
    body = "families needed a clear answer " * 40 + "families needed a clear answer."
    rows = [(1, "x", "t", 'See <a href="https://long.example/' + "a" * 200, None), (2, "x", "t", "the families needed a clear answer", "the " + body), (3, "x", "t", "x < y and more of it.", None)]
    frame = spark.createDataFrame(rows, "article_id bigint, source_id string, title string, summary string, body string")
    assert {r[0] for r in T.truncated_found(frame).collect()} == {1, 2}
    assert T.spikes_of_columns(frame).columns[-1] == "column"
