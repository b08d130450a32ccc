"""Problem 4: the main body of a page, told from navigation, notices, teasers, side columns and footers.

A recurrent block labeller: each page is the sequence of its blocks (the lines of the body), each block a hashed
bag of its words, a hashed path and a few shape figures; a bidirectional LSTM in numpy reads the whole sequence and
classifies every block from the context of the whole page. The texts here hold no tags; in place of the tag path
stands the site's host with the block's shape (its pattern of words, digits and separators).

No labelled pages exist, so the labeller is trained on a bounded sample of pages (about SITE_PAGES of each source and
MAX_PAGES in all, whole sites where there are many, chosen by hash thresholds from a count) whose blocks get weak labels
from what the pages repeat: see weak_labels. What is repeated is counted over all pages, for the lines of the sample.
Every page is then labelled by the network alone, at a cost that is linear in its blocks and needs no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample, and the size of the network.
SITE_PAGES, MAX_PAGES = 200, 4000
#: Sources of fewer pages repeat too little to be told from themselves: lines count there that so many sources have.
FEW_PAGES, MANY_SITES = 50, 3
BUCKETS, WORD_DIM, PATH_DIM, HIDDEN, DENSE = 1 << 13, 16, 12, 24, 9
STEPS, BATCH, RATE = 150, 64, 0.015
THRESHOLD = 0.5

_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]").findall
_ENDED = re.compile(r"[.!?؟。][\"'»”’“)\]]*$").search
_NUMBERED = re.compile(r"^[0-9٠-٩۰-۹]+[.)]\s").match
_LISTED = re.compile(r"^[-•*–]\s").match
_PREFIX = re.compile(r"^([^\s:>—–/|·]+(?: [^\s:>—–/|·]+){0,2}\s?[:>—–/|·])\s").match
_DIGITS = re.compile(r"[0-9٠-٩۰-۹]+")
_SPACE = re.compile(r"\s+")


def comparable(line: str) -> str:
    return _SPACE.sub(" ", _DIGITS.sub("0", line.lower())).strip()


def blocks_of(body: str) -> list[tuple[int, str]]:
    """(line number, text) of the non-blank lines."""
    return [(i, line.strip()) for i, line in enumerate(body.split("\n"), 1) if line.strip()]


def _words(text: str) -> list[str]:
    return [w for w in _TOKENS(comparable(text)) if w.isalnum()]


def _prefix(text: str) -> str | None:
    return comparable(m.group(1)) if len(text) < 200 and (m := _PREFIX(text)) else None


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def line_keys(text: str) -> list[int]:
    """What is counted of a line: itself, and the prefix that ends in a separator."""
    p = _prefix(text)
    return [_key("line", comparable(text))] + ([_key("prefix", p)] if p else [])


def title_keys(text: str) -> list[int]:
    """What is counted of a title: its first word and its pairs of words."""
    words = _words(text)
    return [_key("head", w) for w in words[:1]] + [_key("pair", *p) for p in zip(words, words[1:])]


def count_keys(pages: list[tuple[str, str | None, str]], wanted: set[int] | None = None) -> Counter:
    """(source, key) to the number of pages (source, title, body) that have it; titles count under no source. wanted: other keys are left out."""
    counts: Counter = Counter()
    for source, title, body in pages:
        found = {k for _, text in blocks_of(body) for k in line_keys(text)}
        counts.update((source, k) for k in (found if wanted is None else found & wanted))
        heads = set(title_keys(title or ""))
        counts.update(("", k) for k in (heads if wanted is None else heads & wanted))
    return counts


def wanted_keys(pages: list[tuple[str, str | None, str]]) -> set[int]:
    """All keys that labels of these pages depend on."""
    return {k for _, _, body in pages for _, text in blocks_of(body) for k in (*line_keys(text), *([] if _ENDED(text) else title_keys(text)))}


def weak_labels(pages: list[tuple[str, str, str]], counts: Counter | None = None, totals: dict[str, int] | None = None, spread: dict[int, int] | None = None) -> list[list[int]]:
    """Labels (1: of the page, 0: of the article) of the blocks of sample pages (source, title, body).

    counts, totals and spread (sources that have a key) are of all pages, or of these where they are not given. Of the page are:
    lines that the source repeats on at least 3 pages and 2 % of them; lines that begin with a repeated prefix ending in a
    separator; lines of a column, which begins after a repeated line that is mostly followed by headlines and ends at the
    next repeated line; and unpunctuated lines that read like headlines (their first word begins a title, and their word pairs
    stand in titles). In sources of few pages a line is repeated that stands on two of their pages, or, unless it ends like a
    sentence, in several sources; columns are told there from all such sources together. Everything else, subheads and list
    entries included, is the article's.
    """
    counts = count_keys(pages) if counts is None else counts
    totals = Counter(source for source, _, _ in pages) if totals is None else totals
    if spread is None:
        spread = Counter(k for source, k in counts if source)
    lines = [[text for _, text in blocks_of(body)] for _, _, body in pages]
    few = {source: totals[source] < FEW_PAGES for source, _, _ in pages}
    enough = {source: 2 if few[source] else max(3, 0.02 * totals[source]) for source in few}

    def often(source: str, key: int, pooled: bool) -> bool:
        return counts[source, key] >= enough[source] or (pooled and few[source] and spread.get(key, 0) >= MANY_SITES)

    def prefixed(source: str, text: str) -> bool:
        p = _prefix(text)
        return bool(p) and often(source, _key("prefix", p), True)

    def headline(text: str) -> bool:
        keys = title_keys(text)
        seen = [("", k) in counts for k in keys[1:]]
        return len(keys) >= 4 and ("", keys[0]) in counts and sum(seen) >= 0.4 * len(seen)

    repeated = [[often(source, _key("line", comparable(x)), not _ENDED(x) and len(x) < 200) for x in page] for (source, _, _), page in zip(pages, lines)]
    follows: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    column_of = lambda source, text: ("" if few[source] else source, comparable(text))
    for (source, _, _), page, marks in zip(pages, lines, repeated):
        for k in range(len(page) - 1):
            if marks[k] and not marks[k + 1]:
                seen = follows[column_of(source, page[k])]
                seen[0] += 1
                seen[1] += not prefixed(source, page[k + 1]) and (bool(_NUMBERED(page[k + 1])) or (not _ENDED(page[k + 1]) and headline(page[k + 1])))
            elif marks[k]:
                follows[column_of(source, page[k])][0] += 1
    out = []
    for (source, _, _), page, marks in zip(pages, lines, repeated):
        labels, column = [], False
        for text, mark in zip(page, marks):
            if mark:
                n, teasers = follows[column_of(source, text)]
                column = n >= 3 and teasers >= 0.5 * n
                labels.append(1)
            elif column or prefixed(source, text):
                labels.append(1)
            else:
                labels.append(int(not _LISTED(text) and not _ENDED(text) and headline(text)))
        out.append(labels)
    return out


def make_features() -> Callable:
    """A function from (url, blocks) of pages to flat word ids, their offsets, path ids and dense figures of all blocks."""
    import numpy as np

    ids: dict[str, int] = {}
    hosts: dict[str, str] = {}

    def bucket(key: str) -> int:
        if (x := ids.get(key)) is None:
            if len(ids) > 300_000:
                ids.clear()
            x = ids[key] = zlib.crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS
        return x

    def features(pages: list[tuple[str | None, list[str]]]):
        flat: list[int] = []
        starts: list[int] = []
        paths: list[int] = []
        dense: list[tuple] = []
        for url, blocks in pages:
            try:
                host = urlsplit(url or "").hostname or ""
            except ValueError:
                host = ""
            n = len(blocks)
            for i, text in enumerate(blocks):
                tokens = _TOKENS(text.lower())
                words = [bucket("0" if t[0].isdigit() else t) for t in tokens]
                starts.append(len(flat))
                if tokens:
                    words.append(bucket("^" + ("0" if tokens[0][0].isdigit() else tokens[0])))
                    words.append(bucket("$" + tokens[-1]))
                else:
                    words.append(0)
                flat.extend(words)
                shape = "".join("0" if t[0].isdigit() else "a" if t.isalpha() else t for t in tokens[:3]) + ("." if _ENDED(text) else "") + str(min(len(tokens).bit_length(), 6))
                paths.append(bucket(f"{host}/{shape}"))
                digits = sum(t[0].isdigit() for t in tokens)
                signs = sum(not t.isalnum() for t in tokens)
                dense.append((1.0, min(len(text), 600) / 200, min(len(tokens), 60) / 20, 1.0 if _ENDED(text) else 0.0, 1.0 if _NUMBERED(text) else 0.0, 1.0 if _LISTED(text) else 0.0, (digits + signs) / (len(tokens) + 1), i / n, (n - 1 - i) / n))
        return np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(paths, dtype=np.int64), np.array(dense, dtype=np.float32).reshape(-1, DENSE)

    return features


def new_network(seed: int = 5) -> dict:
    import numpy as np

    r = np.random.default_rng(seed)
    d = WORD_DIM + PATH_DIM + DENSE
    net = {"words": r.normal(0, 0.1, (BUCKETS, WORD_DIM)), "paths": r.normal(0, 0.1, (BUCKETS, PATH_DIM)), "out": r.normal(0, 0.1, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
    for side in "fb":
        net[f"x{side}"], net[f"h{side}"], net[f"b{side}"] = r.normal(0, d**-0.5, (d, 4 * HIDDEN)), r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN)
        net[f"b{side}"][HIDDEN : 2 * HIDDEN] = 1.0  # the forget gate starts open
    return {k: v.astype(np.float32) for k, v in net.items()}


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _inputs(net: dict, flat, starts, paths, dense):
    import numpy as np

    lengths = np.diff(np.append(starts, len(flat)))
    bag = np.add.reduceat(net["words"][flat], starts, axis=0) / lengths[:, None]
    return np.concatenate([bag, net["paths"][paths], dense], axis=1).astype(np.float32), lengths


def _padded(x, sizes):
    """(time, pages, features), mask (time, pages) and the places of the blocks in it."""
    import numpy as np

    steps, n = int(max(sizes)), len(sizes)
    page = np.repeat(np.arange(n), sizes)
    time = np.concatenate([np.arange(s) for s in sizes])
    grid = np.zeros((steps, n, x.shape[1]), dtype=np.float32)
    grid[time, page] = x
    mask = np.zeros((steps, n, 1), dtype=np.float32)
    mask[time, page] = 1
    return grid, mask, time, page


def _scan(net: dict, side: str, grid, mask, keep: list | None = None):
    """Hidden states of one direction; padding leaves the state unchanged. keep: gets what training needs."""
    import numpy as np

    steps, n, _ = grid.shape
    wx, wh, b = net[f"x{side}"], net[f"h{side}"], net[f"b{side}"]
    h, c = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32)
    out = np.zeros((steps, n, HIDDEN), dtype=np.float32)
    projected = grid @ wx + b
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = projected[t] + h @ wh
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        fresh = f * c + i * g
        shown = np.tanh(fresh)
        m = mask[t]
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, shown, m))
        h, c = m * (o * shown) + (1 - m) * h, m * fresh + (1 - m) * c
        out[t] = h
    return out


def probabilities(net: dict, features: tuple, sizes: list[int]):
    """Probability of each block (in order) to belong to the page."""
    x, _ = _inputs(net, *features)
    grid, mask, time, page = _padded(x, sizes)
    both = np_concat(_scan(net, "f", grid, mask), _scan(net, "b", grid, mask))
    return _sigmoid(both @ net["out"] + net["bias"])[time, page, 0]


def np_concat(a, b):
    import numpy as np

    return np.concatenate([a, b], axis=2)


def train(pages: list[tuple[str | None, list[str]]], labels: list[list[int]], steps: int = STEPS, seed: int = 5) -> dict:
    """The network fitted to labelled pages (url, blocks) by about `steps` steps of Adam, back-propagated through whole pages."""
    import numpy as np

    net, rng, features = new_network(seed), np.random.default_rng(seed), make_features()
    pages, labels = zip(*[(p, y) for p, y in zip(pages, labels) if y]) if any(labels) else ((), ())
    order = sorted(range(len(pages)), key=lambda k: len(labels[k]))
    groups = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
    batches = []
    for group in groups:
        sizes = [len(labels[k]) for k in group]
        batches.append((features([pages[k] for k in group]), sizes, np.array([y for k in group for y in labels[k]], dtype=np.float32)))
    first, second, step = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    epochs = -(-steps // max(1, len(batches)))
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            (flat, starts, paths, dense), sizes, y = batches[b]
            x, lengths = _inputs(net, flat, starts, paths, dense)
            grid, mask, time, page = _padded(x, sizes)
            kept: dict[str, list] = {"f": [], "b": []}
            hf, hb = _scan(net, "f", grid, mask, kept["f"]), _scan(net, "b", grid, mask, kept["b"])
            both = np_concat(hf, hb)
            p = _sigmoid(both @ net["out"] + net["bias"])[time, page, 0]
            error = np.zeros((*mask.shape[:2], 1), dtype=np.float32)
            error[time, page, 0] = (p - y) / len(y)
            grads = {"out": both.reshape(-1, 2 * HIDDEN).T @ error.reshape(-1, 1), "bias": error.sum(axis=(0, 1))}
            back = error @ net["out"].T
            dx = np.zeros_like(grid)
            for side, part in (("f", back[..., :HIDDEN]), ("b", back[..., HIDDEN:])):
                wx, wh = net[f"x{side}"], net[f"h{side}"]
                dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
                dz_all, h_all = np.zeros((*grid.shape[:2], 4 * HIDDEN), dtype=np.float32), np.zeros_like(part)
                for t, h, c, i, f, o, g, shown, m in reversed(kept[side]):
                    dh = dh + part[t]
                    live, dlive = dh * m, dc * m
                    dfresh = live * o * (1 - shown * shown) + dlive
                    dz = np.concatenate([dfresh * g * i * (1 - i), dfresh * c * f * (1 - f), live * shown * o * (1 - o), dfresh * i * (1 - g * g)], axis=1)
                    dz_all[t], h_all[t] = dz, h
                    dh, dc = dz @ wh.T + dh * (1 - m), dfresh * f + dc * (1 - m)
                grads[f"x{side}"] = grid.reshape(-1, grid.shape[2]).T @ dz_all.reshape(-1, 4 * HIDDEN)
                grads[f"h{side}"] = h_all.reshape(-1, HIDDEN).T @ dz_all.reshape(-1, 4 * HIDDEN)
                grads[f"b{side}"] = dz_all.sum(axis=(0, 1))
                dx += dz_all @ wx.T
            rows = dx[time, page]
            words = np.zeros_like(net["words"])
            np.add.at(words, flat, np.repeat(rows[:, :WORD_DIM] / lengths[:, None], lengths, axis=0))
            places = np.zeros_like(net["paths"])
            np.add.at(places, paths, rows[:, WORD_DIM : WORD_DIM + PATH_DIM])
            grads["words"], grads["paths"] = words, places
            step += 1
            rate = RATE * (1 - epoch / (epochs + 1))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def page_bodies(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, source_id, title, url, body) of the non-blank bodies of `html` sources."""
    sites = sources.filter("kind = 'html'").select("source_id").distinct()
    rows = articles.filter(F.col("article_id").isNotNull() & F.col("body").rlike(r"\S")).select("article_id", "source_id", "title", "url", "body")
    return rows.join(sites, "source_id", "left_semi")


def sample_pages(pages: DataFrame, site_pages: int = SITE_PAGES, most: int = MAX_PAGES) -> tuple[list, dict[str, int]]:
    """(rows, pages of each sampled source) of a sample by hash thresholds: about `site_pages` pages of a source, and so many
    sources that about `most` pages come together. Only counts are shuffled; the bodies of the sample go to the driver."""
    totals = pages.groupBy("source_id").agg(F.count("*").alias("__n"))
    few, some = F.least("__n", F.lit(FEW_PAGES)), F.least("__n", F.lit(max(site_pages, FEW_PAGES)))
    least, whole = totals.agg(F.sum(few), F.sum(some)).first()
    least, whole = least or 0, whole or 0
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1_000_003)) / 1_000_003.0
    # FEW_PAGES of a source show what it repeats: first more pages are given up, then sources
    more = min(1.0, max(0.0, most - least) / max(whole - least, 1))
    chosen = totals.filter(part("source_id") <= min(1.0, most / max(least, 1))).filter("source_id is not null")
    rate = (few + more * (some - few)) / F.col("__n")
    # every chosen source gives a page at least, so that there are no more than `most` of them: bounded, hence broadcast
    names = chosen.select("source_id", "__n", rate.alias("__rate")).limit(4 * most).collect()
    if not names:
        return [], {}
    small = F.broadcast(pages.sparkSession.createDataFrame(names, "source_id string, __n bigint, __rate double"))
    rows = pages.join(small, "source_id").filter(part("article_id", F.lit(1)) <= F.col("__rate"))
    # the thresholds give about `most` rows; the limit only bounds chance
    got = rows.select("source_id", "title", "url", "body", "__n").limit(4 * most).collect()
    return sorted(got, key=lambda r: (r["source_id"], r["url"] or "", r["body"])), {r["source_id"]: r["__n"] for r in got}


def _count_all(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = count_keys(list(zip(batch["source_id"], batch["title"], batch["body"])), shared.value)
            yield pd.DataFrame([(s, k, n) for (s, k), n in counts.items()], columns=["source_id", "key", "n"])

    return run


def fit_labeller(articles: DataFrame, sources: DataFrame, site_pages: int = SITE_PAGES, most: int = MAX_PAGES) -> dict:
    """The network trained on the bounded sample of pages; repeats of its lines are counted over all pages."""
    pages = page_bodies(articles, sources)
    rows, totals = sample_pages(pages, site_pages, most)
    sample = [(r["source_id"], r["title"], r["body"]) for r in rows]
    wanted = wanted_keys(sample)
    shared = articles.sparkSession.sparkContext.broadcast(wanted)
    hits = pages.select("source_id", "title", "body").mapInPandas(_count_all(shared), "source_id string, key bigint, n bigint")
    # as many rows reach the driver as keys of the sample: counts of its own sources, and the number of sources of a key
    by_source = hits.groupBy("key", "source_id").agg(F.sum("n").alias("n"))
    own = F.when((F.col("source_id") == "") | F.col("source_id").isin(sorted(totals)), F.struct("source_id", "n"))
    merged = by_source.groupBy("key").agg(F.approx_count_distinct(F.when(F.col("source_id") != "", F.col("source_id"))).alias("spread"), F.collect_list(own).alias("own")).collect()
    counts = Counter({(o["source_id"], r["key"]): o["n"] for r in merged for o in r["own"]})
    labels = weak_labels(sample, counts, totals, {r["key"]: r["spread"] for r in merged})
    return train([(r["url"], [text for _, text in blocks_of(r["body"])]) for r in rows], labels)


def _label(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        net, features = shared.value, make_features()
        for whole in batches:
            pages = [(a, u, blocks_of(b)) for a, u, b in zip(whole["article_id"], whole["url"], whole["body"])]
            pages = sorted((p for p in pages if p[2]), key=lambda p: len(p[2]))
            at = 0
            while at < len(pages):
                # pages of about one length together, and few of the very long ones
                size = max(1, min(512, 40_000 // len(pages[at][2])))
                group = pages[at : at + size]
                at += size
                sizes = [len(blocks) for _, _, blocks in group]
                p = probabilities(net, features([(u, [t for _, t in blocks]) for _, u, blocks in group]), sizes)
                yield pd.DataFrame({"article_id": np.repeat([a for a, _, _ in group], sizes), "line_no": np.array([i for _, _, blocks in group for i, _ in blocks], dtype=np.int32), "p_page": p.astype(float)})

    return run


def labelled_blocks(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, line_no, p_page): each non-blank line of each page with its probability to belong to the page.

    Null and blank bodies and articles of other sources have no row; a null url counts as no host; repeated rows give
    repeated rows; extra columns are not read; empty tables give an empty result.
    """
    net = fit_labeller(articles, sources)
    shared = articles.sparkSession.sparkContext.broadcast(net)
    return page_bodies(articles, sources).select("article_id", "url", "body").mapInPandas(_label(shared), "article_id bigint, line_no int, p_page double")


def page_lines_found(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, line_no) of non-blank lines that belong to the page and not to the article."""
    return labelled_blocks(articles, sources).filter(F.col("p_page") >= THRESHOLD).select("article_id", "line_no").distinct()


def main_bodies(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, text): the lines of each page that are the article, in order."""
    net = fit_labeller(articles, sources)
    shared = articles.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = _label(shared)
        for batch in batches:
            batch = batch.reset_index(drop=True).assign(row=range(len(batch)))
            drop: dict[int, set[int]] = defaultdict(set)
            for part in label(iter([batch[["row", "url", "body"]].rename(columns={"row": "article_id"})])):
                for row, line_no in part.loc[part["p_page"] >= THRESHOLD, ["article_id", "line_no"]].itertuples(index=False):
                    drop[row].add(line_no)
            texts = ["\n".join(x for i, x in enumerate(body.split("\n"), 1) if x.strip() and i not in drop[k]) for k, body in enumerate(batch["body"])]
            yield pd.DataFrame({"article_id": batch["article_id"], "text": texts})

    return page_bodies(articles, sources).select("article_id", "url", "body").mapInPandas(run, "article_id bigint, text string")
