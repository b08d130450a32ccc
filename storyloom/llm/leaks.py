"""Problem 9: evaluation items whose passages stand in training documents.

Greedy string tiling with Karp-Rabin hashes: windows of `min_words` words of all items form a table of rolling
hashes; the windows of a batch of documents are hashed at once, and those found in the table are the shared-token
seeds. For each document and item with a seed, seeds are verified word by word, joined to maximal matches along
their diagonal, and the longest ones are marked one after the other without overlap. Reordered passages give
several tiles; coverage is the share of the item's words under tiles. A leak is a tile of MIN_WORDS words, or, where an item
was cut up and shuffled, tiles of TILE_WORDS words or more that cover COVERAGE of it.

Items are the query set: they are sent to the workers in blocks of a bounded number of words, whatever their
number; documents are read once for each block and never shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 13
#: Shortest tiles of shuffled passages, and the share of the item's words that they must cover.
TILE_WORDS, COVERAGE = 5, 0.5
#: Words of items in one broadcast block (about 100 bytes each in a worker).
BLOCK_WORDS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_SCHEMA = "doc_id bigint, item_id bigint, tiles int, longest int, words int, covered int, item_words int, reordered boolean"


def make_words() -> Callable[[str], list[str]]:
    """Longest runs of letters and digits in lower case, without tatweel and Arabic vowel marks."""
    drop = {0x640: None} | {c: None for c in range(0x64B, 0x653)}
    runs = re.compile(r"[^\W_]+").findall
    return lambda text: runs(text.translate(drop).lower() if not text.isascii() else text.lower())


def tiles_of(doc: list[int], item: list[int], seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the greedy tiles, longest first; seeds are verified here."""
    runs: list[tuple[int, int, int]] = []
    reach: dict[int, int] = {}
    for i, j in sorted(seeds):
        diagonal = i - j
        if reach.get(diagonal, -1) > i or doc[i : i + least] != item[j : j + least]:
            continue
        n = least
        while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
            n += 1
        reach[diagonal] = i + n - least + 1
        runs.append((-n, i, j))
    heapq.heapify(runs)
    free_doc, free_item, tiles = bytearray(b"\1") * len(doc), bytearray(b"\1") * len(item), []
    while runs:
        n, i, j = heapq.heappop(runs)
        n = -n
        parts, start = [], None
        for k in range(n + 1):
            open_ = k < n and free_doc[i + k] and free_item[j + k]
            if open_ and start is None:
                start = k
            elif not open_ and start is not None:
                parts.append((start, k - start))
                start = None
        if parts == [(0, n)]:
            free_doc[i : i + n] = free_item[j : j + n] = bytes(n)
            tiles.append((i, j, n))
        else:
            for start, m in parts:
                if m >= least:
                    heapq.heappush(runs, (-m, i + start, j + start))
    return tiles


def _search(shared, least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        words = make_words()
        vocabulary: dict[str, int] = {}
        names: list[int] = []
        items: list[list[int]] = []
        for item_id, text in shared.value:
            names.append(item_id)
            items.append([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)])
        # a fixed pseudo-random number for each word; 0 for words that no item has
        numbers = np.random.default_rng(7).integers(1, 1 << 63, size=len(vocabulary) + 1, dtype=np.uint64)
        numbers[0] = 0

        def windows(ids):
            h = np.zeros(max(0, len(ids) - least + 1), dtype=np.uint64)
            values, base = numbers[ids], np.uint64(_BASE)
            for k in range(least):
                h = h * base + values[k : k + len(h)]
            return h

        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for entry, ids in enumerate(items):
            for j, h in enumerate(windows(np.array(ids, dtype=np.int64)).tolist()):
                places[h].append((entry, j))
        table = np.sort(np.fromiter(places, dtype=np.uint64, count=len(places)))
        get = vocabulary.get
        for batch in batches:
            rows: list[tuple] = []
            docs = [[get(w, 0) for w in words(t)] if t else [] for t in batch["text"]]
            # one array for the whole batch; a 0 after each document keeps windows inside their document
            ends = np.cumsum([len(d) + 1 for d in docs])
            ids = np.fromiter((x for d in docs for x in (*d, 0)), dtype=np.int64, count=int(ends[-1]) if len(ends) else 0)
            if len(table) and len(ids) >= least:
                zeros = np.concatenate([[0], np.cumsum(ids == 0)])
                whole = np.flatnonzero(zeros[least:] == zeros[: len(zeros) - least])
                h = windows(ids)[whole]
                at = np.searchsorted(table, h)
                hit = (at < len(table)) & (table[np.minimum(at, len(table) - 1)] == h)
                seeds: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                for position, value in zip(whole[hit].tolist(), h[hit].tolist()):
                    d = int(np.searchsorted(ends, position, side="right"))
                    i = position - (int(ends[d - 1]) if d else 0)
                    for entry, j in places[value]:
                        seeds[d, entry].append((i, j))
                for (d, entry), pairs in seeds.items():
                    item = items[entry]
                    if tiles := tiles_of(docs[d], item, pairs, least):
                        order = [j for _, j, _ in sorted(tiles)]
                        lengths = [n for _, _, n in tiles]
                        rows.append((batch["doc_id"].iat[d], names[entry], len(tiles), max(lengths), len(docs[d]), sum(lengths), len(item), order != sorted(order)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "tiles", "longest", "words", "covered", "item_words", "reordered"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item that share at least `min_words` consecutive words of the item.

    tiles, longest, covered, item_words: of the greedy tiling; reordered: whether the tiles stand in another order
    than in the item. Null and empty texts and items shorter than `min_words` have no rows; repeated rows of a
    document give repeated rows; an item_id with several texts counts with each; empty tables give no rows.
    """
    spark = documents.sparkSession
    texts = items.filter("item_id is not null and text is not null and text <> ''").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    total = texts.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    docs = documents.selectExpr("cast(doc_id as bigint) as doc_id", "text").filter("doc_id is not null and text is not null")
    out = None
    for block in range(blocks):
        part = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = docs.mapInPandas(_search(spark.sparkContext.broadcast([(r[0], r[1]) for r in part.sort("item_id", "text").collect()]), min_words), _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def covered_items(documents: DataFrame, items: DataFrame, tile_words: int = TILE_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """leaked_items with its tiles of at least `tile_words` words, and the share of the item they cover; rows below `coverage` are left
    out unless a tile alone has MIN_WORDS words."""
    share = F.col("covered") / F.col("item_words")
    rows = leaked_items(documents, items, tile_words)
    return rows.withColumn("coverage", F.round(share, 6)).filter((share >= coverage) | (F.col("longest") >= MIN_WORDS))


def leaks_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents that hold at least 13 consecutive words of an item."""
    return leaked_items(documents, items).select("doc_id", "item_id").distinct()
