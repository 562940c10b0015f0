"""Evaluation passages inside training text, found by greedy string tiling.

The seeds are all runs of a few words of the test items, as hashes in a table. One pass over the documents keeps of each
its runs that may be seeds, by a bit set of fixed size in which every seed has set two bits; documents without any go no
further. A join of hashes tells which documents and items share enough seeds, and only those pairs are tiled: tiling
repeatedly marks the longest common run of words that overlaps no earlier tile, with common runs found by Karp-Rabin
hashes, down to ``min_tile`` words. Tiles may come in any order, so reordered passages count. ``coverage`` is the tiled
share of the item's words; a pair leaks if it shares a run of ``min_match`` words or if its coverage reaches the threshold.

Without a threshold (None) the seeds have ``min_match`` words and one shared seed makes a pair. With one the seeds have
``min_tile`` words. A pair at the threshold shares a number of seeds that follows from the item's length; the commonest
seeds of each item, fewer than that number, are left out of the join, which loses no pair.

Nothing that grows with documents or items is broadcast or sent to the driver.

Defined results: NULL and empty texts match nothing; items shorter than a seed match nothing; repeated rows of one
document or item count once (the greatest text); items that share text are all reported. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.words import WordHashes, mix, words
from quillspan.session import stored

MIN_MATCH, MIN_TILE, COVERAGE = 12, 5, 0.5
#: Words of 64 bits in the bit set that tells possible seeds from other runs: 8 MB, however many items there are.
BIT_WORDS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all runs of ``n`` ids."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out, x = np.zeros(m, dtype=np.uint64), ids.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _BASE + x[k : k + m]
    return out


def common_runs(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The maximal runs (doc position, item position, length) of at least ``least`` equal ids."""
    hd, hi = rolling(doc, least), rolling(item, least)
    order = np.argsort(hi, kind="stable")
    low, high = np.searchsorted(hi[order], hd, "left"), np.searchsorted(hi[order], hd, "right")
    n = high - low
    if not n.sum():
        return []
    i = np.repeat(np.arange(len(hd)), n)
    j = order[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))]
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    new = np.concatenate(([True], (np.diff(i - j) != 0) | (np.diff(i) != 1)))
    at = np.nonzero(new)[0]
    size = np.diff(np.concatenate((at, [len(i)]))) + least - 1
    return [(a, b, k) for a, b, k in zip(i[at].tolist(), j[at].tolist(), size.tolist()) if np.array_equal(doc[a : a + k], item[b : b + k])]


def tile(doc: np.ndarray, item: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id arrays: tiles (doc position, item position, length), longest first, ties by
    position. What an earlier tile leaves of a run comes back as a shorter run."""
    heap = [(-k, i, j) for i, j, k in common_runs(doc, item, min_tile)]
    heapq.heapify(heap)
    free_d, free_i, tiles = np.ones(len(doc), bool), np.ones(len(item), bool), []
    while heap:
        k, i, j = heapq.heappop(heap)
        free = free_d[i : i - k] & free_i[j : j - k]
        if free.all():
            free_d[i : i - k] = free_i[j : j - k] = False
            tiles.append((i, j, -k))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= min_tile:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


def seeds_of(text: str, n: int, store: WordHashes) -> np.ndarray:
    return mix(rolling(store.of(words(text)), n))


def _bits(seeds: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Two places (word, bit) of each seed in the bit set."""
    size = np.uint64(BIT_WORDS - 1)
    return tuple(((seeds >> np.uint64(a)) & size, np.uint64(1) << ((seeds >> np.uint64(b)) & np.uint64(63))) for a, b in ((0, 20), (26, 46)))


def item_seeds(items: DataFrame, n: int) -> DataFrame:
    """(item_id, h, places, n_words): the seeds of each item and how often each stands in it."""

    def go(batches):
        store = WordHashes()
        for pdf in batches:
            out = []
            for key, text in zip(pdf.item_id, pdf.text):
                ws = words(text)
                h, k = np.unique(mix(rolling(store.of(ws), n)).view(np.int64), return_counts=True)
                out += [(key, a, b, len(ws)) for a, b in zip(h.tolist(), k.tolist())]
            yield pd.DataFrame(out, columns=["item_id", "h", "places", "n_words"])

    return items.mapInPandas(go, "item_id bigint, h bigint, places int, n_words int")


def bit_set(seeds: DataFrame) -> np.ndarray:
    """The bits of all seeds, BIT_WORDS words of 64 bits, put together by the executors."""

    def go(batches):
        out = np.zeros(BIT_WORDS, np.uint64)
        for pdf in batches:
            for w, b in _bits(pdf.h.to_numpy().view(np.uint64)):
                np.bitwise_or.at(out, w.astype(np.int64), b)
        at = np.nonzero(out)[0]
        yield pd.DataFrame({"w": at, "b": out[at].view(np.int64)})

    rows = seeds.select("h").mapInPandas(go, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # BIT_WORDS rows at most
    out = np.zeros(BIT_WORDS, np.uint64)
    out[rows.w.to_numpy(dtype=np.int64)] = rows.b.to_numpy(dtype=np.int64).view(np.uint64)
    return out


def seeded_documents(documents: DataFrame, bits: np.ndarray, n: int) -> DataFrame:
    """(doc_id, text, seeds) of the documents that hold a run of ``n`` words that may be a seed."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def go(batches):
        store, have = WordHashes(), shared.value
        for pdf in batches:
            keys, texts, found = [], [], []
            for key, text in zip(pdf.doc_id, pdf.text):
                h = seeds_of(text, n, store)
                if len(h):
                    (w1, b1), (w2, b2) = _bits(h)
                    h = h[(have[w1.astype(np.int64)] & b1 != 0) & (have[w2.astype(np.int64)] & b2 != 0)]
                if len(h):
                    keys.append(key), texts.append(text), found.append(np.unique(h).view(np.int64))
            yield pd.DataFrame({"doc_id": keys, "text": pd.Series(texts, dtype=object), "seeds": pd.Series(found, dtype=object)})

    return documents.mapInPandas(go, "doc_id bigint, text string, seeds array<bigint>")


def _pairs(found: DataFrame, seeds: DataFrame, min_match: int, min_tile: int, coverage: float | None) -> DataFrame:
    """(doc_id, item_id) that share as many seeds as a leak must."""
    hits = found.select("doc_id", F.explode("seeds").alias("h"))
    if coverage is None:
        return hits.join(seeds.select("item_id", "h").hint("merge"), "h").select("doc_id", "item_id").distinct()
    # tiles of k words hold k - min_tile + 1 seeds, at least one for every min_tile words that are covered
    least = F.least(F.lit(min_match - min_tile + 1), F.ceil(F.ceil(coverage * F.col("n_words") - 1e-9) / min_tile)).cast("int")
    counts = hits.groupBy("h").agg(F.count("*").alias("k"))
    common_first = Window.partitionBy("item_id").orderBy(F.desc("k"), "h")
    ranked = seeds.join(counts.hint("merge"), "h").withColumn("least", least).withColumn("upto", F.sum("places").over(common_first))
    left_out = F.floor(F.col("least") / 2)
    used = ranked.where(F.col("upto") > left_out).select("item_id", "h", "places", (F.col("least") - left_out).alias("need"))
    met = hits.join(used.hint("merge"), "h").groupBy("doc_id", "item_id").agg(F.sum("places").alias("shared"), F.max("need").alias("need"))
    return met.where("shared >= need").select("doc_id", "item_id")


def leaks(
    documents: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, min_tile: int = MIN_TILE, coverage: float | None = COVERAGE
) -> DataFrame:
    """(doc_id, item_id, longest, tiles, matched_words, item_words, coverage) of documents and items that share a run of
    at least ``min_match`` words, or of which the tiles cover ``coverage`` of the item's words."""
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    tests = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.max("text").alias("text"))
    n = min_match if coverage is None else min_tile
    seeds = stored(item_seeds(tests, n), "leak-seeds")
    found = seeded_documents(docs, bit_set(seeds), n).groupBy("doc_id").agg(F.max(F.struct("text", "seeds")).alias("r"))
    found = stored(found.select("doc_id", "r.text", "r.seeds"), "leak-documents")
    pairs = stored(_pairs(found, seeds, min_match, min_tile, coverage), "leak-pairs")
    both = pairs.join(found.select("doc_id", "text"), "doc_id").join(tests.select("item_id", F.col("text").alias("item_text")), "item_id")

    def go(batches):
        for pdf in batches:
            rows, last, vocabulary, doc = [], None, {}, None
            for key, item, text, other in zip(pdf.doc_id, pdf.item_id, pdf.text, pdf.item_text):
                if key != last:
                    last, vocabulary = key, {}
                    doc = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(text)], dtype=np.int64)
                unknown = len(vocabulary)
                its = np.array([vocabulary.get(w, unknown) for w in words(other)], dtype=np.int64)
                tiles = tile(doc, its, min_tile)
                longest, matched = max((k for _, _, k in tiles), default=0), sum(k for _, _, k in tiles)
                if longest >= min_match or (coverage is not None and matched >= coverage * len(its) - 1e-9 and matched):
                    rows.append((key, item, longest, len(tiles), matched, len(its), matched / len(its)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest", "tiles", "matched_words", "item_words", "coverage"])

    return both.mapInPandas(go, "doc_id bigint, item_id bigint, longest int, tiles int, matched_words int, item_words int, coverage double")
