import random
from pathlib import Path

import pytest

from storyloom.llm import encoding as E

pytestmark = pytest.mark.skipif(not Path(E.DEFAULT_RANKS).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def ranks():
    return E.load_ranks()


def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_equals_the_library_on_odd_texts(ranks):
    encode, want = E.make_encoder(ranks), reference(ranks)
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice("ab  \n\tع́é'sll 19٣😀_-.<|>") for _ in range(rng.randint(0, 40)))
        assert list(encode(text)) == want(text), text
    for text in ("<|endoftext|>", "ab" * 4000 + "x" * 3000 + "ع" * 700, " ", "", "a\r\nb", "I'm  here ", "\n \n x"):
        assert list(encode(text)) == want(text)


def test_scan_and_heap_agree(ranks):
    rng = random.Random(5)
    for _ in range(300):
        raw = bytes(rng.choice(b"abcdefgh \xd8\xb9") for _ in range(rng.randint(1, 90)))
        assert E.merge_scan(raw, ranks) == E.merge_heap(raw, ranks)


def test_nulls_repeats_extra_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in E.encode_corpus(rows).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] == (3, [15496, 995])
    assert E.encode_corpus(rows.limit(0)).count() == 0
