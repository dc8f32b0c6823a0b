"""Benchmark decontamination by SimHash.

Every window of a document that is as long as a benchmark item gets a 64-bit SimHash of its weighted five-word shingles. A
multi-index over blocks of the items' fingerprints finds all pairs within a Hamming radius: by the pigeonhole
principle some block of such a pair differs in at most radius / blocks bits, and the index holds every block value that near.
The exact weighted similarity of the shingle multisets decides.

Windows without any shingle of an item of their length have similarity 0 to all of them and are not fingerprinted. A document
shorter than an item is one window. Items of fewer than five words are one shingle; items and documents without
words match nothing. Null texts count as empty. Repeated rows are judged alike. Extra columns are ignored.

The items are a query set: they are taken in blocks of bounded size, each broadcast and held against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import text_digest

SHINGLE = 5
BLOCKS, BLOCK_BITS = 8, 8

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

SCHEMA = "doc_id long, digest string, item_id long, similarity double, start_word long, n_words long, hamming int"


def _normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words (letters, digits, non-ASCII characters) and their document offsets."""
    data, offsets = A.text_bytes(pc.utf8_lower(texts))
    start, end = A.spans(_WORD[data], offsets)
    return A.word_hashes(data, start, end), A.doc_offsets(A.owners(offsets, start), len(texts))


def _fingerprints(hashes: np.ndarray, weights: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """SimHash of windows of ``length`` shingles: the sign of the weighted sum of each bit, from prefix sums."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(hashes) + 1, 64), np.int64)
    np.cumsum(bits * weights[:, None], axis=0, out=sums[1:])
    return np.packbits(sums[start + length] - sums[start] > 0, axis=1).view(np.uint64).ravel()


@dataclass
class _Items:
    """The items of one block that have the same number of words."""

    ids: np.ndarray
    shingles: list[Counter]
    prints: np.ndarray
    known: np.ndarray  # sorted distinct shingle hashes
    index: list[tuple[np.ndarray, np.ndarray]]  # per block of bits: offsets by value, items near that value


@dataclass
class _Block:
    by_length: dict[int, _Items]
    known: np.ndarray  # sorted shingle hashes of the block's items
    hashes: np.ndarray  # sorted hashes of the shingles that several items of any block have, with their weights
    weights: np.ndarray
    other: int  # weight of every other shingle


def _weights(block: _Block, hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(block.hashes, hashes), max(len(block.hashes) - 1, 0))
    return np.where(A.member(hashes, block.hashes), block.weights[at], block.other) if len(block.hashes) else np.full(len(hashes), block.other)


def _blocks_of(prints: np.ndarray) -> np.ndarray:
    return prints.view(np.uint8).reshape(-1, BLOCKS)


def _index(prints: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    near = np.array([x for x in range(1 << BLOCK_BITS) if x.bit_count() <= radius // BLOCKS], np.uint8)
    out = []
    for block in _blocks_of(prints).T:
        value, item = (block[:, None] ^ near).ravel(), np.repeat(np.arange(len(prints)), len(near))
        order = np.argsort(value, kind="stable")
        out.append((np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1)), item[order]))
    return out


def _shared_shingles(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of all items with words, and the sorted hashes of the shingles that several of them have, with how many."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            words, offsets = _normal_words(batch.column("text"))
            size = np.diff(offsets)
            held = [pa.nulls(int((size > 0).sum()), pa.int64())]  # a row without a shingle for each item with words
            for k in range(1, SHINGLE + 1):
                first, hashes = A.windows(words, offsets, k)
                item = A.owners(offsets, first)
                own = size[item] == k if k < SHINGLE else np.ones(len(item), bool)
                once = np.unique(np.stack([item[own].astype(np.int64), hashes[own].view(np.int64)]), axis=1)[1]
                held.append(pa.array(once, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(held)], ["shingle"])

    counted = items.select("text").mapInArrow(shingles, "shingle long").groupBy("shingle").count().where("shingle is null or count > 1").toArrow()
    shingle, count = counted["shingle"].combine_chunks(), counted["count"].to_numpy()
    some = shingle.is_valid().to_numpy(zero_copy_only=False)
    hashes = shingle.drop_null().to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return int(count[~some].sum()), hashes[order], count[some][order]


def _build(rows: list, radius: int, n: int, shared: np.ndarray, df: np.ndarray) -> _Block:
    words, offsets = _normal_words(pa.array([r["text"] or "" for r in rows], pa.string()))
    sets: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r, a, b in zip(rows, offsets[:-1], offsets[1:], strict=True):
        if b > a:
            sets.setdefault(int(b - a), []).append((r["item_id"], A.windows(words[a:b], np.array([0, b - a]), min(SHINGLE, b - a))[1]))
    known = np.unique(np.concatenate([s for held in sets.values() for _, s in held])) if sets else np.zeros(0, np.uint64)
    weigh = lambda d: max(1, round(16 * math.log(1 + max(n, 1) / d)))  # noqa: E731  rarer shingles weigh more
    block = _Block({}, known, shared, np.array([weigh(d) for d in df.tolist()], np.int64), weigh(1))
    for length, held in sets.items():
        k = len(held[0][1])
        flat = np.concatenate([s for _, s in held])
        prints = _fingerprints(flat, _weights(block, flat), np.arange(len(held)) * k, np.full(len(held), k))
        block.by_length[length] = _Items(np.array([i for i, _ in held]), [Counter(s.tolist()) for _, s in held], prints, np.unique(flat), _index(prints, radius))
    return block


def weighted_similarity(a: Counter, b: Counter, weight: dict[int, int], other: int) -> float:
    """Weighted Jaccard similarity of two multisets."""
    both = sum(min(n, b[s]) * weight.get(s, other) for s, n in a.items() if s in b)
    total = sum(n * weight.get(s, other) for c in (a, b) for s, n in c.items())
    return both / (total - both) if total else 0.0


def _windows_near(positions: np.ndarray, size: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shingle and length of all windows of ``size`` shingles that contain one of the positions."""
    doc = A.owners(offsets, positions)
    low, high = offsets[doc], offsets[doc + 1]
    last = np.maximum(high - size, low)
    a, b = np.minimum(np.maximum(positions - size + 1, low), last), np.minimum(positions, last)
    edge = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b + 1, -1)
    start = np.flatnonzero(np.cumsum(edge[:-1]))
    return start, np.minimum(size, offsets[A.owners(offsets, start) + 1] - start)


def _find(texts: pa.Array, block: _Block, radius: int, threshold: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(document, item id, similarity, first word, words, Hamming distance) of the best window of each pair."""
    words, of = _normal_words(texts)
    weight = dict(zip(block.hashes.tolist(), block.weights.tolist(), strict=True))
    shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    best: dict[tuple[int, int], tuple] = {}
    for length, items in block.by_length.items():
        k = min(SHINGLE, length)
        if k not in shingles:
            first, hashes = A.windows(words, of, k)
            shingles[k] = hashes, A.doc_offsets(A.owners(of, first), len(texts)), np.flatnonzero(A.member(hashes, block.known))
        hashes, offsets, hits = shingles[k]
        hits = hits[A.member(hashes[hits], items.known)]
        if not len(hits):
            continue
        start, size = _windows_near(hits, length - k + 1, offsets)
        needed = A.covered(start, 1, len(hashes)) if length == k else np.zeros(len(hashes), bool)
        if length > k:
            edge = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + size, -1)
            needed = np.cumsum(edge[:-1]) > 0
        place = np.cumsum(needed) - 1  # windows stay contiguous among the shingles needed
        own = hashes[needed]
        prints = _fingerprints(own, _weights(block, own), place[start], size)
        pairs = set()
        for (index, near), value in zip(items.index, _blocks_of(prints).T, strict=True):
            count = index[value.astype(np.int64) + 1] - index[value]
            window = np.repeat(np.arange(len(start)), count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            item = near[np.repeat(index[value], count) + within]
            close = np.bitwise_count(prints[window] ^ items.prints[item]) <= radius
            pairs.update(zip(window[close].tolist(), item[close].tolist(), strict=True))
        doc = A.owners(offsets, start)
        for w, i in sorted(pairs):
            got = weighted_similarity(Counter(hashes[start[w] : start[w] + size[w]].tolist()), items.shingles[i], weight, block.other)
            if got >= threshold:
                d, at = int(doc[w]), int(start[w] - offsets[doc[w]])
                found = (-got, at, int(size[w] + k - 1), int(prints[w] ^ items.prints[i]).bit_count())
                key = (d, int(items.ids[i]))
                best[key] = min(best.get(key, found), found)
    for (d, i), (score, at, n, distance) in sorted(best.items()):
        yield d, i, -score, at, n, distance


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, radius: int = 23, block_bytes: int = 16 << 20, digests: bool = False) -> DataFrame:
    """The best window of each document and item with weighted similarity of at least ``threshold``.

    ``digest``, the SHA-256 of the document's text, is kept where ``digests`` is set. Shingles weigh by the number of all items that have them, whatever the blocks; those of several items are held with each block.
    ``radius`` 23 of 64 bits is 4.6 standard deviations above the expected distance at similarity 0.8. ``block_bytes`` bounds the
    item text that is broadcast at once; more items mean more passes over the documents.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    weighing = _shared_shingles(items)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_digest(F.col(text)).alias("digest"), F.col(text).alias("_text"))
    out = None
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        held = docs.sparkSession.sparkContext.broadcast(_build(rows, radius, *weighing))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in A.slices(batches, "_text"):
                ids = batch.column("doc_id")
                found = list(_find(batch.column("_text"), held.value, radius, threshold))
                if found:
                    d, *rest = (list(x) for x in zip(*found, strict=True))
                    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), batch.column("digest").take(pa.array(d)), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))], ["doc_id", "digest", "item_id", "similarity", "start_word", "n_words", "hamming"])

        found = docs.mapInArrow(search, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if digests else out.drop("digest")


def clean(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """The documents without a match; rows with a null id are kept."""
    return docs.join(matches.select("doc_id").distinct(), "doc_id", "left_anti")
