"""Byte-exact removal of long repeated substrings by a Burrows-Wheeler transform.

A byte is removed where a string of ``length`` bytes over it also starts in a document with a smaller id.

1. Equal texts are one text; its later copies are removed whole. Texts that share an anchor (the smallest hash of a window's
   n-grams) with another text are candidates; see ``anchors``.
2. Each maximal run of windows of a candidate with the same shared anchor becomes one string. Equal strings are merged before they are shuffled.
   All occurrences of a window have the same anchor, so they meet in one bucket.
3. Strings that share an anchor with another string are the ones compared: blocks of whole anchors' strings are sorted into a Burrows-Wheeler transform. Breadth-first backward extension derives its common prefixes by
   increasing value: after step k, intervals of rows share k bytes. It stops at ``length``. Each interval then holds the occurrences
   of one window, among them the smallest document.
4. Strings of an anchor with more than ``hot`` different contexts are split into windows, which spread over all tasks.
5. Runs of windows with an earlier document go back to their documents, whose remaining bytes are joined.

Documents with a null id come last, in the order of a hash of their text. A null text is empty. Repeated rows (equal id) get equal results and do not remove
each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from . import arrays as A
from .store import written

GRAM = 20
#: Bytes of text or of strings that are handled at once: arrays of some numbers for each of them stay in a core's cache.
BLOCK = 1 << 17
_LAST = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes and hashes of all n-grams; those over a document's end lie in no window."""
    sums = A.byte_prefix(data)
    return sums, A.gram_hashes(sums, GRAM)


def _anchors(texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = A.text_bytes(texts)
    _, hashes = _grams(data)
    at = anchors.minimizers(hashes, A.window_starts(offsets, length), length - GRAM + 1)
    return A.owners(offsets, at), hashes[at]


def anchored_strings(texts: pa.Array, length: int, codes: pa.Array) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one shared anchor: document, first byte, bytes, anchor hash and content hash."""
    data, offsets = A.text_bytes(texts)
    first, none = A.window_starts(offsets, length), np.zeros(0, np.int64)
    if not len(first):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums, hashes = _grams(data)
    least = A.sliding_min(hashes, length - GRAM + 1)[first]
    fresh = np.ones(len(first), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (first[1:] != first[:-1] + 1)  # no two documents' windows follow each other
    start = np.flatnonzero(fresh)
    begin, end, least = first[start], first[np.append(start[1:], len(first)) - 1] + length, least[start]
    doc = A.owners(offsets, begin)
    own = A.mix(np.arange(len(texts), dtype=np.uint64) + np.uint64(1))
    keep = anchors.is_wanted(least, doc, anchors.wanted(codes, own), own)  # a run's windows share what decides
    begin, end, least, doc = begin[keep], end[keep], least[keep], doc[keep]
    return doc, begin - offsets[doc], end - begin, least, A.span_hash(sums, begin, end)


def prefix_intervals(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of suffixes, interval number of each row, and common prefixes below ``length`` of neighbouring rows.

    Suffixes are sorted by doubling, as deep as needed; each round sorts the rows that are still tied. Row r of the transform goes back to row psi[r],
    the suffix one symbol further; extending all intervals backward by their symbols at once makes row r a boundary where psi leads to different
    intervals. A row's common prefix is the step in which it became a boundary. A row that the first d symbols left tied is looked at from step d - 1 on
    (the text's end costs one), one that stays tied never. Symbols are below 2**9; the text's end counts as -1.
    """
    n = len(symbols)
    number = np.cumsum(np.bincount(symbols) > 0)  # 0 is left for the text's end
    bits = int(number[-1]).bit_length()
    pack = depth = 63 // bits  # the first symbols in one number
    padded = np.concatenate([number[symbols], np.zeros(pack, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(pack):
        key <<= bits
        key |= padded[i : i + n]
    order = np.argsort(key)
    ordered = key[order]
    order = order.astype(np.int32)
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    levels = [(1, np.flatnonzero(fresh).astype(np.int32))]
    tied = np.arange(n, dtype=np.int32)
    rank = np.zeros(n + 1, np.int32)  # first row of the ties, from 1
    rank[order] = np.maximum.accumulate(np.where(fresh, tied + 1, 0))
    while depth <= length:
        single = fresh[tied]
        single[:-1] &= single[1:]  # the row behind a group of ties is fresh
        tied = tied[~single]
        if not len(tied):
            break
        suffix = order[tied]
        key = rank[suffix].astype(np.int64) * (n + 1) + rank[np.minimum(suffix + depth, n)]
        by_key = np.argsort(key)
        key, suffix = key[by_key], suffix[by_key]
        parted = np.ones(len(tied), bool)
        parted[1:] = key[1:] != key[:-1]
        order[tied] = suffix
        rank[suffix] = np.maximum.accumulate(np.where(parted, tied + 1, 0))
        levels.append((depth - 1, tied[parted & ~fresh[tied]]))
        fresh[tied] = parted
        depth *= 2
    row = np.empty(n + 1, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    row[n] = 0  # the last suffix is its own interval: nothing else ends there
    psi = row[order + 1]
    head = symbols[order]
    boundary = np.ones(n, bool)
    boundary[1:] = head[1:] != head[:-1]
    at_end = row[n - 1]
    boundary[at_end : at_end + 2] = True
    lcp = np.zeros(n, np.int32)
    known = before = here = np.zeros(0, np.int32)
    for step in range(1, length):
        while levels and levels[0][0] <= step:
            more = levels.pop(0)[1]
            more = more[~boundary[more]]
            known, before, here = np.append(known, more), np.append(before, psi[more - 1]), np.append(here, psi[more])
        if not len(known):
            continue
        group = np.cumsum(boundary, dtype=np.int32)
        cut = group[before] != group[here]
        new = known[cut]
        lcp[new] = step
        boundary[new] = True
        left = ~cut
        known, before, here = known[left], before[left], here[left]
    return order, np.cumsum(boundary, dtype=np.int32) - 1, lcp


def earliest_documents(strings: list[bytes], nodes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the strings, in their order: string, place in it, and the smallest document that has the window."""
    sizes = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    m = len(strings)
    end = np.cumsum(sizes + 1)
    symbols = np.zeros(int(end[-1]), np.int16)  # 0 ends each string; no window reaches over it
    text = np.ones(len(symbols), bool)
    text[end - 1] = False
    symbols[text] = data.astype(np.int16) + 1
    suffixes, group, _ = prefix_intervals(symbols, length)
    owner = np.repeat(np.arange(m), sizes + 1)
    place = np.arange(len(symbols)) - (end - sizes - 1)[owner]
    window = place <= (sizes - length)[owner]
    least = np.minimum.reduceat(np.where(window, nodes[owner], _LAST)[suffixes], np.flatnonzero(np.diff(group, prepend=-1)))
    found = np.empty(len(symbols), np.int64)
    found[suffixes] = least[group]
    return owner[window], place[window], found[window]


_PIECE = "node long, code long, content long, start int, size int"


def _pieces(candidates: DataFrame, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "_text", BLOCK):
            doc, start, size, code, content = anchored_strings(batch.column("_text"), length, batch.column("codes"))
            node = batch.column("node").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([node, pa.array(code.view(np.int64)), pa.array(content.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["node", "code", "content", "start", "size"])

    return candidates.select("node", "_text", "codes").mapInArrow(cut, _PIECE)


def _with_bytes(strings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Read each distinct string from the first document that has it."""
    held = strings.groupBy("node").agg(F.collect_list(F.struct("code", "content", "start", "size", "node", "most")).alias("held"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "_text"):
            data, offsets = A.text_bytes(batch.column("_text"))
            raw, lists = data.tobytes(), batch.column("held")
            rows, doc = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            start = offsets[doc] + rows.field("start").to_numpy()
            size = rows.field("size").to_numpy()
            content = pa.array([raw[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.field(c) for c in ("code", "content", "node", "most")] + [content], ["code", "content", "node", "most", "bytes"])

    return candidates.select("node", "_text").join(held, "node").select("_text", "held").mapInArrow(read, "code long, content long, node long, most long, bytes binary")


_RUN = "code long, content long, first int, n int, least long"


def anchor_blocks(codes: np.ndarray, sizes: np.ndarray, limit: int) -> list[int]:
    """Where to cut strings, sorted by anchor, into blocks of about ``limit`` bytes that hold all strings of their anchors."""
    fresh = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    block = (np.cumsum(sizes) // limit)[fresh]
    return [0, *fresh[np.flatnonzero(np.diff(block, prepend=0))].tolist(), len(codes)]


def _transform(strings: DataFrame, length: int, parts: int) -> DataFrame:
    """Runs of windows with the smallest document of each, from one transform per block of a part's anchors."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for own in A.grouped(batches, "part"):
            cuts = anchor_blocks(own.column("code").to_numpy(), pc.binary_length(own.column("bytes")).to_numpy(), BLOCK)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield own.slice(a, b - a)

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in blocks(batches):
            code, content, node, most = (own.column(c).to_numpy() for c in ("code", "content", "node", "most"))
            string, place, found = earliest_documents(own.column("bytes").to_pylist(), node, length)
            fresh = np.ones(len(string), bool)
            fresh[1:] = (string[1:] != string[:-1]) | (found[1:] != found[:-1])
            first = np.flatnonzero(fresh)
            n = np.diff(np.append(first, len(string)))
            string, place, found = string[first], place[first], found[first]
            used = found < most[string]
            string = string[used]
            arrays = [code[string], content[string], place[used].astype(np.int32), n[used].astype(np.int32), found[used]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["code", "content", "first", "n", "least"])

    keyed = strings.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int"))
    return keyed.repartition(parts, "part").sortWithinPartitions("part", "code").select("part", "code", "content", "node", "most", "bytes").mapInArrow(transformed, _RUN)


def _by_window(strings: DataFrame, length: int) -> DataFrame:
    """The same runs for strings of hot anchors, each window grouped by its bytes' digest."""
    starts = F.sequence(F.lit(0), F.octet_length("bytes") - length)
    each = strings.select("code", "content", "node", "most", F.explode(F.transform(starts, lambda i: F.struct(i.cast("int").alias("first"), F.unhex(F.sha2(F.substring(F.col("bytes"), i + 1, F.lit(length)), 256)).alias("w")))).alias("x"))
    each = each.select("code", "content", "node", "most", "x.first", "x.w")
    least = each.groupBy("w").agg(F.min("node").alias("least"))
    return each.join(least, "w").where("least < most").select("code", "content", "first", F.lit(1).alias("n"), "least")


def _removed(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """(digest, first, n_removed, n_spans, kept_sha256, kept) of the documents with removed spans."""
    held = spans.groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "_text", BLOCK):
            data, offsets = A.text_bytes(batch.column("_text"))
            lists, n = batch.column("spans"), batch.num_rows
            rows, at = lists.flatten(), offsets[np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))]
            edge = np.bincount(at + rows.field("start").to_numpy(), minlength=len(data) + 1)
            edge -= np.bincount(at + rows.field("stop").to_numpy(), minlength=len(data) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            n_removed = A.sums_by_doc(gone, offsets)
            n_spans = np.bincount(A.owners(offsets, A.spans(gone, offsets)[0]), minlength=n)
            left, end = data[~gone].tobytes(), np.append(0, np.cumsum(np.diff(offsets) - n_removed)).tolist()
            kept = [left[a:b] for a, b in zip(end[:-1], end[1:], strict=True)]
            shas = [hashlib.sha256(x).hexdigest() for x in kept]
            columns = [pa.array(n_removed), pa.array(n_spans), pa.array(shas, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("own"), *columns], ["digest", "first", "n_removed", "n_spans", "kept_sha256", "kept"])

    return candidates.select("digest", "own", "node", "_text").join(held, "node").select("digest", "own", "_text", "spans").mapInArrow(joined, "digest long, first long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeated_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, hot: int = 20_000, part_bytes: int = 1_500_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document. ``kept`` holds the remaining bytes of documents that lost some; null
    stands for the whole text, or for nothing where all is removed. ``part_bytes`` bounds what one task's transforms hold."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("digest", F.xxhash64("_text"))
    sha = F.sha2("_text", 256)
    known = written(rows.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("own"), "digest", sha.alias("sha"), F.octet_length("_text").cast("long").alias("n_bytes")), "texts")
    nodes = known.groupBy("digest", "sha").agg(F.min("own").alias("node"))
    buckets = anchors.bucket_count(rows)
    codes = anchors.shared_anchors(rows, lambda texts: _anchors(texts, length), buckets, slice_bytes=BLOCK)
    named = codes.join(nodes, "digest")
    first = rows.withColumn("own", F.coalesce("doc_id", F.lit(_LAST))).select("digest", "own", "_text")
    named = named.withColumn("own", F.col("node")).withColumn("node", F.when(F.col("own") == _LAST, F.pmod("digest", F.lit(1 << 62)) + (1 << 62)).otherwise(F.col("own")))
    # the join's own keys also tell copies apart, so texts are shuffled once
    candidates = written(first.join(named, ["digest", "own"]).dropDuplicates(["digest", "own"]), "candidates")

    pieces = written(_pieces(candidates, length), "pieces")
    first = [F.min("node").alias("node"), F.min_by("start", "node").alias("start"), F.max("size").alias("size"), F.max("node").alias("most")]
    strings = written(pieces.groupBy("code", "content").agg(*first), "strings")
    strings = written(strings.join(strings.groupBy("code").agg(F.count("*").alias("variants")), "code"), "strings")
    # a string whose anchor has no other string shares no window with one: all its windows first occur where it does
    single = strings.where("variants = 1 and node < most").select("code", "content", F.lit(0).alias("first"), (F.col("size") - (length - 1)).alias("n"), F.col("node").alias("least"))
    several, often = strings.where(F.col("variants").between(2, hot)), strings.where(F.col("variants") > hot)
    parts = max(1, (several.agg(F.sum("size")).first()[0] or 0) // part_bytes + 1)
    runs = single.unionByName(_transform(_with_bytes(several, candidates), length, parts))
    if not often.isEmpty():
        runs = runs.unionByName(_by_window(_with_bytes(often, candidates), length))
    runs = written(runs, "runs")
    begin = F.col("start") + F.col("first")
    spans = pieces.join(runs, ["code", "content"]).where("least < node").select("node", begin.alias("start"), (begin + F.col("n") + (length - 1)).alias("stop"))
    removed = _removed(candidates, spans)

    whole = F.col("own") > F.col("first")
    gone = whole & (F.col("n_bytes") >= length)
    out = known.join(nodes.withColumnRenamed("node", "first"), ["digest", "sha"]).join(removed, ["digest", "first"], "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).when(whole, 0).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).when(whole, 0).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY)).when(whole, F.col("sha")).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(~whole, F.col("kept")).alias("kept"),
    )
