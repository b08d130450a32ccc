"""Problem 8: the whole corpus as ids of a public byte-level BPE tokenizer.

Merging works on one contiguous array of part boundaries and the ranks of adjacent pairs: the smallest rank is
found by a scan, its boundary is deleted, and only the two neighbouring ranks are refreshed. Long pieces (more
than LONG_PIECE bytes, where repeated scans would be quadratic) get the same merges from a heap.

Texts repeat their words, so a worker keeps the ids of the pieces it met (a bounded cache, which never changes a
result), and a text whose blanks all stand between two other characters is cut at its blanks before the
tokenizer's pattern runs: each such blank starts a piece in any case.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_PIECE = 256
CACHE = 400_000
NO_RANK = 1 << 60


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    """Bytes to rank from a file of base64 tokens and ranks."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def merge_scan(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short piece by scans over its boundary and rank arrays."""
    get, bounds = ranks.get, list(range(len(piece) + 1))
    pair = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while pair:
        low = min(pair)
        if low == NO_RANK:
            break
        i = pair.index(low)
        del bounds[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = get(piece[bounds[i] : bounds[i + 2]], NO_RANK)
        if i:
            pair[i - 1] = get(piece[bounds[i - 1] : bounds[i + 1]], NO_RANK)
    return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long piece, in n log n steps."""
    import heapq

    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != end:
            continue  # one of the two parts has changed since
        alive[j] = 0
        after[i] = end
        if end < n:
            before[end] = i
            if (rank := get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (rank, i, after[end]))
        if i and (rank := get(piece[before[i] : end])) is not None:
            heapq.heappush(heap, (rank, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def make_encoder(ranks: dict[bytes, int]) -> Callable[[str], array]:
    """A function from a text to the array of its ids, with a bounded cache."""
    import re

    import regex

    pieces = regex.compile(PATTERN).findall
    # a blank at either end, or beside other white space
    odd = re.compile(r"\A | \Z|\s (?=\S)| (?=\s)").search
    cache: dict[str, array] = {}

    def fresh(chunk: str) -> array:
        ids = array("i")
        for word in pieces(chunk):
            raw = word.encode("utf-8", "surrogatepass")
            if (whole := ranks.get(raw)) is not None:
                ids.append(whole)
            else:
                ids.extend(merge_scan(raw, ranks) if len(raw) <= LONG_PIECE else merge_heap(raw, ranks))
        if len(chunk) <= 64:
            if len(cache) >= CACHE:
                cache.clear()
            cache[chunk] = ids
        return ids

    def encode(text: str) -> array:
        out = array("i")
        if not text:
            return out
        if odd(text):
            return fresh(text)
        head, *rest = text.split(" ")
        out.extend(cache.get(head) or fresh(head))
        get = cache.get
        for word in rest:
            word = " " + word
            out.extend(get(word) or fresh(word))
        return out

    return encode


def _encode_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = make_encoder(shared.value)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            flat, offsets = array("i"), [0]
            for text in batch.column(1).to_pylist():
                flat.extend(encode(text or ""))
                offsets.append(len(flat))
            values = pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], schema=schema)

    return run


def encode_corpus(documents: DataFrame, ranks_path: str = DEFAULT_RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) for each row: ids of the byte-level BPE without special tokens; strings of special tokens are plain text.

    Null and empty texts have the empty list. Repeated rows give repeated rows; extra columns are not read; an empty
    table gives an empty result. No shuffle. The vocabulary (a file of fixed size, 50 256 tokens) is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    return documents.selectExpr(f"`{key}` as doc_id", f"`{text}` as text").mapInArrow(_encode_batches(shared), "doc_id bigint, ids array<int>")
