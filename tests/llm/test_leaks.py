import random

from storyloom.llm import leaks as L

ITEM, DOC = "item_id bigint, suite string, text string", "doc_id bigint, text string, item_id string"


def brute(docs, items, n=13):
    words = L.make_words()
    out = set()
    for d, text in docs:
        w = words(text or "")
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for item, it in items:
            v = words(it or "")
            if any(tuple(v[i : i + n]) in grams for i in range(len(v) - n + 1)):
                out.add((d, item))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)] + ["مُهم", "ـكتاب", "Ab9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))) for i in range(30)] + [(30, None), (31, "")]
    docs = []
    for d in range(120):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))
        if d % 3 == 0:
            part = (items[rng.randrange(30)][1]).split()
            at = rng.randrange(max(1, len(part) - 10))
            text += "; " + " — ".join(part[at : at + rng.randint(8, 25)]).upper() + " " + text
        docs.append((d, text))
    docs += [(200, None), (201, "")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], DOC)
    query = spark.createDataFrame([(i, "s", t) for i, t in items], ITEM)
    want = brute(docs, items)
    assert {tuple(r) for r in L.leaks_found(frame, query).collect()} == want and len(want) > 10
    # the same in blocks of few words
    assert {(r[0], r[1]) for r in L.leaked_items(frame, query, block_words=300).collect()} == want
    assert L.leaks_found(frame.limit(0), query).count() == L.leaks_found(frame, query.limit(0)).count() == 0


def test_reordered_passages_are_tiled():
    item = list(range(1, 41))
    doc = [0, *range(21, 41), 0, *range(1, 21)]
    seeds = [(i, j) for i in range(len(doc) - 12) for j in range(len(item) - 12) if doc[i : i + 13] == item[j : j + 13]]
    assert sorted(L.tiles_of(doc, item, seeds, 13)) == [(1, 20, 20), (22, 0, 20)]
    # two windows with one hash but different words are no tile
    assert L.tiles_of([1] * 13, [2] * 13, [(0, 0)], 13) == []


def test_very_long_text(spark):
    item = " ".join(f"k{i}" for i in range(20))
    frame = spark.createDataFrame([(1, "word " * 60_000 + item, "x")], DOC)
    assert L.leaks_found(frame, spark.createDataFrame([(7, "s", item)], ITEM)).collect()[0][1] == 7


def test_shuffled_pieces_are_found_by_coverage(spark):
    """An item cut into pieces of eight words, in another order: no piece is long, together they cover it."""
    rng = random.Random(9)
    item = [f"k{i}" for i in range(64)]
    pieces = [item[i : i + 8] for i in range(0, 64, 8)]
    rng.shuffle(pieces)
    shuffled = " filler words between ".join(" ".join(p) for p in pieces)
    rows = [(1, shuffled, "x"), (2, " ".join(item[:8]) + " and other words", "x"), (3, " ".join(item[:20]), "x"), (4, None, "x")]
    frame, query = spark.createDataFrame(rows, DOC), spark.createDataFrame([(7, "s", " ".join(item)), (8, "s", "")], ITEM)
    got = {r["doc_id"]: r for r in L.covered_items(frame, query).collect()}
    assert set(got) == {1, 3} and got[1]["coverage"] == 1.0 and got[1]["reordered"] and got[1]["tiles"] == 8
    assert {r["doc_id"] for r in L.leaks_found(frame, query).collect()} == {3}
    assert {r["doc_id"] for r in L.covered_items(frame, query, coverage=0.1).collect()} == {1, 2, 3}
