"""Jaccard join of word n-gram sets by chosen paths.

Identical texts are one node. In each run a set chooses a few of its tokens (a token is chosen where its seeded hash is below
1 / (similarity * size), so similar sets choose alike) and goes into their buckets. A bucket of many dissimilar
sets is split again by further sampled tokens along its path. The pairs of a final bucket are compared by brute force, a large bucket in pairs of
blocks over many tasks (members of several large buckets of similar sets in one of them, their home): first by sizes and small sketches, then, for the members with a likely partner, by their sets. Runs are repeated until a pair at the threshold shares a bucket with the target probability.

A pair that shares several buckets counts in the first of them only, so counts of links are exact for the pairs found, and no
list of pairs is made: each block pair returns one row per linked node.

Sets hold the n-grams of words ``[^\\x20\\x09-\\x0D]+``; a text of fewer words is one n-gram; a text without words has no links but
to nothing, and its copies form a class. Rows with a null id have neither class nor links. Repeated rows get equal results.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .components import connected_components
from .store import written

_ALL = np.float64(2.0**64)
#: Bins of a sketch.
BINS = 64


def runs_for(recall: float, similarity: float, choices: float) -> int:
    """Runs after which a pair at the threshold has shared a token with probability ``recall``: a run misses it with
    probability exp(-choices * similarity)."""
    return max(1, math.ceil(math.log(1 - recall) / (-choices * similarity)))


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text and their document offsets."""
    data, offsets = A.text_bytes(texts)
    start, end, doc = A.words(data, offsets)
    word = A.word_hashes(data, start, end)
    of = A.doc_offsets(doc, len(texts))
    first, hashes = A.windows(word, of, n)
    owner = A.owners(of, first)
    short = np.flatnonzero((np.diff(of) > 0) & (np.diff(of) < n))
    if len(short):
        whole = A.span_hash(A.prefix(word), of[short], of[short + 1])
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, whole])
    key = hashes ^ A.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    owner, hashes = owner[~again], hashes[~again]
    if len(short):
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    return hashes, A.doc_offsets(owner, len(texts))


def _chosen(hashes: np.ndarray, size: np.ndarray, choices: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are chosen in a run, and the bucket key of each."""
    value = A.seeded(hashes, seed)
    chosen = value.astype(np.float64) < np.minimum(choices / np.maximum(size, 1), 1.0) * _ALL
    return chosen, A.mix(value[chosen]).view(np.int64)


def _sketches(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A byte per bin of a one-permutation MinHash: 0 for an empty bin, else bits of its smallest hash."""
    value = A.seeded(hashes, 1000)
    least = np.full(n * BINS, np.uint64(2**64 - 1))
    cell = owner * BINS + (value >> np.uint64(58)).astype(np.int64)
    order = np.argsort(cell)
    cell = cell[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    if len(first):
        least[cell[first]] = np.minimum.reduceat(value[order], first)
    return np.where(least == np.uint64(2**64 - 1), np.uint64(0), least % np.uint64(255) + np.uint64(1)).astype(np.uint8).reshape(n, BINS)


def _signatures(docs: DataFrame, n: int, choices: float, runs: int) -> DataFrame:
    """(doc_id, digest, size of the set, keys of all runs, sketch) of every row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "_text"):
            hashes, of = _sets(batch.column("_text"), n)
            size, owner = np.diff(of), np.repeat(np.arange(batch.num_rows), np.diff(of))
            keys, docs_of = [], []
            for run in range(runs):
                chosen, key = _chosen(hashes, size[owner], choices, run)
                keys.append(key)
                docs_of.append(owner[chosen])
            keys, docs_of = np.concatenate(keys), np.concatenate(docs_of)
            order = np.argsort(docs_of, kind="stable")
            at = A.doc_offsets(docs_of[order], batch.num_rows).astype(np.int32)
            sketch = pa.array([row.tobytes() for row in _sketches(hashes, owner, batch.num_rows)], pa.binary())
            arrays = [batch.column("doc_id"), batch.column("digest"), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[order])), sketch]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "size", "keys", "sketch"])

    return docs.mapInArrow(signed, "doc_id long, digest binary, size int, keys array<long>, sketch binary")


def _token_sets(docs: DataFrame, n: int) -> DataFrame:
    """Tokens of each node as sorted 64-bit hashes, with the other columns of ``docs``: (node, keys, tokens)."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "_text"):
            hashes, of = _sets(batch.column("_text"), n)
            raw = [np.sort(hashes[a:b]).tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("keys"), pa.array(raw, pa.binary())], ["node", "keys", "tokens"])

    return docs.select("node", "keys", "_text").mapInArrow(tokens, "node long, keys array<long>, tokens binary")


def _buckets(rows: DataFrame) -> DataFrame:
    """Size and member checksums of every bucket of at least two."""
    member = F.xxhash64("node")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(member).alias("x"), F.sum(F.pmod(member, F.lit(1 << 30))).alias("s")).where("n > 1")


def _split(large: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, last, node) one step further along each path: members choose again among their sampled tokens, in rising order."""
    further = F.explode(F.filter("keys", lambda k: k > F.col("last"))).alias("next")
    return large.join(reps.select("node", "keys"), "node").select("key", "node", further).select(F.xxhash64("key", "next").alias("key"), F.col("next").alias("last"), "node").distinct()


def _with_homes(final: DataFrame) -> DataFrame:
    """(key, node, n): a member of large dense buckets gets one home, and members of one home are compared there alone.

    The home is the largest dense bucket that a member of one's own dense buckets is in, so a group of near copies, whose members share
    several large buckets each, has about one. Homes have negative keys and come first; a bucket whose members have the same home is left out.
    """
    dense = final.where("dense").select("key", "node", F.struct("n", "key").alias("size"))
    largest = dense.groupBy("node").agg(F.max("size").alias("size"))
    near = dense.select("key", "node").join(largest, "node").groupBy("key").agg(F.max("size").alias("size"))
    homes = dense.select("key", "node").join(near, "key").groupBy("node").agg(F.bitwise_not(F.shiftrightunsigned(F.max("size")["key"], 1)).alias("home"))
    homes = written(homes, "homes")
    sizes = homes.groupBy("home").agg(F.count("*").alias("n"))
    settled = final.join(homes, "node").groupBy("key", "n").agg(F.count("*").alias("m"), F.min("home").alias("a"), F.max("home").alias("b")).where("m = n and a = b")
    others = final.join(settled.select("key"), "key", "left_anti").select(F.shiftrightunsigned("key", 1).alias("key"), "node", "n")
    return homes.join(sizes, "home").select(F.col("home").alias("key"), "node", "n").unionByName(others)


def _final_buckets(reps: DataFrame, limit: int, depth: int) -> DataFrame:
    """(key, node, n) of the buckets to compare."""
    rows = reps.select(F.explode("keys").alias("key"), "node").distinct().select("key", F.col("key").alias("last"), "node")
    rows = written(rows.join(_buckets(rows), "key"), "bucket-rows")
    columns = lambda rows, dense: rows.select("key", "node", "n", "x", "s", F.lit(dense).alias("dense"))
    final, large = columns(rows.where(F.col("n") <= limit), False), rows.where(F.col("n") > limit)
    for _ in range(depth):
        if large.isEmpty():
            break
        # the mean similarity in a bucket is the chance that two members agree in a bin of the sketch
        bins = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.substring("sketch", i + 1, 1).alias("v")) for i in range(0, BINS, BINS // 4)))).alias("x")
        values = large.join(reps.select("node", "sketch"), "node").select("key", "n", bins).groupBy("key", "n", "x").agg(F.count("*").alias("c"))
        mean = F.sum(F.col("c") * F.col("c")) / (F.lit(4.0) * F.col("n") * F.col("n"))
        dense = values.groupBy("key", "n").agg(mean.alias("mean")).where("mean >= 0.25").select("key")
        final = final.unionByName(columns(large.join(dense, "key", "left_semi"), True))
        rows = written(_split(large.join(dense, "key", "left_anti"), reps), "bucket-rows")
        rows = written(rows.join(_buckets(rows), "key"), "bucket-rows")
        final, large = final.unionByName(columns(rows.where(F.col("n") <= limit), False)), rows.where(F.col("n") > limit)
    final = final.unionByName(columns(large, False))
    # of buckets with the same members, one is enough
    keep = final.groupBy("n", "x", "s").agg(F.min("key").alias("key"))
    final = written(final.join(keep.select("key"), "key", "left_semi").select("key", "node", "n", "dense").distinct(), "final-buckets")
    return final.select("key", "node", "n") if final.where("dense").isEmpty() else written(_with_homes(final), "final-buckets")


def _overlaps(sets: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of membership tables over a range of tokens at a time."""
    flat = np.concatenate([*sets, *other]) if sets or other else np.zeros(0, np.uint64)
    tokens, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets) + len(other)), [len(s) for s in [*sets, *other]])
    shared = count > 1
    new = np.cumsum(shared) - 1
    number, owner = new[number[shared[number]]], owner[shared[number]]
    out, width = np.zeros((len(sets), len(other)), np.float32), 4096
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    for a in range(0, int(shared.sum()), width):
        part = slice(*np.searchsorted(number, [a, a + width]))
        table = np.zeros((len(sets) + len(other), width), np.float32)
        table[owner[part], number[part] - a] = 1
        out += table[: len(sets)] @ table[len(sets) :].T
    return out


def _unseen(keys: list[np.ndarray], key: int, left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """Pairs of a bucket that share no earlier one, each once."""
    earlier = [k[k < key].view(np.uint64) for k in keys]
    out = _overlaps([earlier[i] for i in left], [earlier[i] for i in right]) == 0
    return np.triu(out, 1) if same else out


def _sides(side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    return (np.arange(len(side)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))


def _screen(key: int, same: bool, side: np.ndarray, keys: list[np.ndarray], sketch: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Members that may be similar to another one of the bucket, by sizes and sketches.

    A pair at the threshold agrees in 51 of 64 bins on average, with a standard deviation of 3; a pair is kept if half of its bins agree.
    """
    left, right = _sides(side, same)
    hit = np.zeros(len(side), bool)
    if not len(left) or not len(right):
        return np.flatnonzero(hit)
    open_ = _unseen(keys, key, left, right, same) if len(side) > 64 else None
    rows = np.arange(len(left)) if open_ is None else np.flatnonzero(open_.any(1))
    step = max(1, (1 << 24) // (len(right) * BINS))
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        one, two = sketch[left[part]][:, None, :], sketch[right][None, :, :]
        agree = ((one == two) & (one > 0)).sum(2)
        filled = ((one > 0) | (two > 0)).sum(2)
        x, y = size[left[part]][:, None], size[right][None, :]
        near = (2 * agree >= filled) & (np.minimum(x, y) >= (similarity - 1e-9) * np.maximum(x, y))
        near &= open_[part] if open_ is not None else (left[part][:, None] < right[None, :] if same else True)
        i, j = np.nonzero(near)
        hit[left[part[i]]] = hit[right[j]] = True
    return np.flatnonzero(hit)


def _compare(nodes: np.ndarray, side: np.ndarray, keys: list[np.ndarray], sets: list[np.ndarray], key: int, same: bool, similarity: float) -> tuple[list[int], list[int], list[int]]:
    """Linked nodes of one bucket or block pair, the smallest node that each is connected to within it, and their links."""
    left, right = _sides(side, same)
    if not len(left) or not len(right):
        return [], [], []
    open_ = _unseen(keys, key, left, right, same)
    if not open_.any():
        return [], [], []
    both = _overlaps([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
    size = np.array([len(s) for s in sets])
    union = np.maximum(size[left][:, None] + size[right][None, :] - both, 1)
    a, b = np.nonzero(open_ & (both / union >= similarity))
    a, b = left[a], right[b]
    links = np.bincount(a, minlength=len(nodes)) + np.bincount(b, minlength=len(nodes))
    root = nodes.copy()
    while True:  # every node takes the smallest root among its neighbours' and its own
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        if np.array_equal(new, root):
            break
        root = new
    at = np.flatnonzero(links)
    return nodes[at].tolist(), root[at].tolist(), links[at].tolist()


def _candidates(final: DataFrame, reps: DataFrame, similarity: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(key, a, b, side, node) of the members that may have a similar one, and (node, keys) of all members.

    A bucket of more than ``block`` members is compared in pairs of blocks; every member goes to the pairs that hold its block.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node", "key"), blocks).cast("int")
    held = written(final.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("held")), "members")
    keys = held.select("node", F.transform("held", lambda h: h["key"]).alias("keys"))
    rows = (
        held.join(reps.select("node", "size", "sketch"), "node").select("node", "size", "sketch", F.transform("held", lambda h: h["key"]).alias("keys"), F.explode("held").alias("h"))
        .select("node", "size", "sketch", "keys", "h.key", "h.n")
        .withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "keys", "size", "sketch")
        .repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    )

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds, names = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), ["key", "a", "b", "side", "node"]

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for group in A.grouped(batches, "key", "a", "b"):
            key, a, b = (group.column(c)[0].as_py() for c in ("key", "a", "b"))
            node, side = group.column("node").to_numpy(), group.column("side").to_numpy()
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            lists = [np.array(k, np.int64) for k in group.column("keys").to_pylist()] if len(node) > 64 else []
            hit = _screen(key, a == b, side, lists, sketch, group.column("size").to_numpy(), similarity)
            out += [(key, a, b, int(side[i]), int(node[i])) for i in hit]
            if len(out) > 10_000:
                yield batch_of()
                out = []
        if out:
            yield batch_of()

    return rows.mapInArrow(screened, "key long, a int, b int, side int, node long"), keys


def _links(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root, links) per bucket or block pair, from the exact similarities of the candidates."""
    rows = candidates.join(sets, "node").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for group in A.grouped(batches, "key", "a", "b"):
            key, a, b = (group.column(c)[0].as_py() for c in ("key", "a", "b"))
            keys = [np.array(k, np.int64) for k in group.column("keys").to_pylist()]
            tokens = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
            for held, more in zip(out, _compare(group.column("node").to_numpy(), group.column("side").to_numpy(), keys, tokens, key, a == b, similarity), strict=True):
                held += more
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "root", "links"])
                out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "root", "links"])

    return rows.select("key", "a", "b", "side", "node", "keys", "tokens").mapInArrow(compared, "node long, root long, links long")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.9999, limit: int = 4096, block: int = 2048, depth: int = 4) -> DataFrame:
    """Class and links of every row: (doc_id, class_id, copy_of, n_links).

    ``class_id`` is the smallest id that a document is connected to by copies and links, ``copy_of`` the smallest id with the same text,
    ``n_links`` the number of other texts of Jaccard similarity ``similarity`` or more. Buckets over ``limit`` whose members
    are dissimilar on average are split, up to ``depth`` times; ``block`` bounds what is compared at once.
    """
    choices = 1 / similarity
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("digest", F.unhex("digest"))
    signed = written(_signatures(rows, n, choices, runs_for(recall, similarity, choices)), "signatures")
    first = [F.first(c).alias(c) for c in ("size", "keys", "sketch")]
    reps = written(signed.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), *first), "nodes")

    candidates, keys = _candidates(_final_buckets(reps, limit, depth), reps, similarity, block)
    candidates = written(candidates, "candidates")
    chosen = keys.join(candidates.select("node").distinct(), "node")
    texts = rows.where("doc_id is not null").select(F.col("doc_id").alias("node"), "_text").join(chosen.hint("merge"), "node")
    sets = written(_token_sets(texts, n).dropDuplicates(["node"]), "token-sets")
    links = written(_links(candidates, sets, similarity), "links")
    classes = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    known = reps.select("digest", "node").join(classes, "node", "left").join(counts, "node", "left").select("digest", F.col("node").alias("copy_of"), F.coalesce("class_id", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("doc_id", "digest").where("doc_id is not null").join(known, "digest").select("doc_id", "class_id", "copy_of", "n_links")
    alone = signed.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)
