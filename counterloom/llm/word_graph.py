"""Removal of long repeated word spans by compaction of a De Bruijn graph.

The windows of ``length`` words are the edges of a De Bruijn graph; neighbouring windows of a document are neighbouring edges. A word is
removed where a window over it also starts earlier: in a document with a smaller id, or before it in the same document.

1. Only texts that share an anchor (the smallest hash of a window's n-grams) with another text, or have it twice, hold repeated
   edges; see ``anchors``. Equal texts are one text; its later copies are removed whole.
2. Edges with one anchor are dealt to one bucket, as maximal paths of neighbouring edges. Equal paths are merged before the shuffle, keeping the
   coordinates of the first.
3. In a bucket, edges are grouped and repeated nonbranching paths compacted: stretches whose edges first occur one after another in one source
   document. A join hands the stretches to all their occurrences, and stretches that go on across anchors with the
   same source offset are glued.
4. Source coordinates verify each span: a strong digest of its words must equal that of the words at the source.

Documents with a null id come last, in the order of a hash of their text. A null text has no words. Repeated rows (equal id) get equal results.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors
from . import arrays as A
from .store import written

GRAM = 8
_LAST = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = A.text_bytes(texts)
    start, end, doc = A.words(data, offsets)
    return A.word_hashes(data, start, end), A.doc_offsets(doc, len(texts))


def _grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = A.prefix(words)
    return sums, A.gram_hashes(sums, GRAM)


def _anchors(texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    words, of = _word_hashes(texts)
    _, hashes = _grams(words)
    at = anchors.minimizers(hashes, A.window_starts(of, length), length - GRAM + 1)
    return A.owners(of, at), hashes[at]


def _known(rows: DataFrame) -> DataFrame:
    """(doc_id, own, digest, n_words, sha): number of words and digest of the words joined by one space."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "_text"):
            words = [t.encode().split() for t in batch.column("_text").to_pylist()]
            sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(w) for w in words], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "own", "digest", "n_words", "sha"])

    return rows.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("own"), "digest", "_text").mapInArrow(counted, "doc_id long, own long, digest long, n_words long, sha string")


def _paths(candidates: DataFrame, length: int) -> DataFrame:
    """Maximal paths of neighbouring edges with one shared anchor: place in the document, number of edges and content hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "_text"):
            words, of = _word_hashes(batch.column("_text"))
            first = A.window_starts(of, length)
            if not len(first):
                continue
            sums, hashes = _grams(words)
            least = A.sliding_min(hashes, length - GRAM + 1)[first]
            doc = A.owners(of, first)
            own = A.mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(1))
            keep = anchors.is_wanted(least, doc, anchors.wanted(batch.column("codes"), own), own)
            first, least, doc = first[keep], least[keep], doc[keep]
            if not len(first):
                continue
            fresh = np.ones(len(first), bool)
            fresh[1:] = (first[1:] != first[:-1] + 1) | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(fresh)
            begin, end = first[start], first[np.append(start[1:], len(first)) - 1] + length
            arrays = [
                batch.column("digest").take(pa.array(doc[start])), batch.column("node").take(pa.array(doc[start])), pa.array(least[start].view(np.int64)),
                pa.array(A.span_hash(sums, begin, end).view(np.int64)), pa.array((begin - of[doc[start]]).astype(np.int32)), pa.array((end - begin - length + 1).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "node", "code", "content", "start", "edges"])

    return candidates.select("digest", "node", "_text", "codes").mapInArrow(cut, "digest long, node long, code long, content long, start int, edges int")


def _with_edges(paths: DataFrame, candidates: DataFrame, length: int) -> DataFrame:
    """Two 64-bit hashes of every edge of the distinct paths, read at the coordinates of their first occurrence."""
    held = paths.groupBy("digest").agg(F.collect_list(F.struct("code", "content", "node", "start", "edges", "times")).alias("held"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "_text"):
            words, of = _word_hashes(batch.column("_text"))
            one, two = A.prefix(words), A.prefix(A.seeded(words, 1))
            lists = batch.column("held")
            rows, doc = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            n = rows.field("edges").to_numpy().astype(np.int64)
            at = np.repeat(of[doc] + rows.field("start").to_numpy() - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hashes = np.stack([A.span_hash(s, at, at + length) for s in (one, two)], axis=1).tobytes()
            cut = np.concatenate([[0], np.cumsum(n)]) * 16
            raw = pa.array([hashes[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            names = ["code", "content", "node", "start", "times"]
            yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in names), batch.column("digest").take(pa.array(doc)), raw], [*names, "digest", "hashes"])

    return candidates.select("digest", "_text").join(held, "digest").select("digest", "_text", "held").mapInArrow(read, "code long, content long, node long, start int, times long, digest long, hashes binary")


_RUN = "code long, content long, first int, n int, s_node long, s_digest long, s_start int"


def compact(edges: np.ndarray, path: np.ndarray, node: np.ndarray, digest: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of paths whose edges first occur one after another: path, first edge, edges, and where they first occur.

    ``edges`` has two hashes per row, ``path`` the path of each; the others give each path's first occurrence.
    """
    place = np.arange(len(path)) - np.searchsorted(path, path)
    at = start[path] + place
    order = np.lexsort((at, digest[path], node[path], edges[:, 1], edges[:, 0]))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (edges[order][1:] != edges[order][:-1]).any(1)
    source = np.empty(len(order), np.int64)
    source[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]  # the first occurrence of the same edge
    s_path, s_at = path[source], at[source]
    cut = np.ones(len(path), bool)
    cut[1:] = (path[1:] != path[:-1]) | (node[s_path][1:] != node[s_path][:-1]) | (digest[s_path][1:] != digest[s_path][:-1]) | (s_at[1:] != s_at[:-1] + 1)
    first = np.flatnonzero(cut)
    return path[first], place[first], np.diff(np.append(first, len(path))), node[s_path][first], digest[s_path][first], s_at[first]


def _compacted(paths: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in A.grouped(batches, "part"):
            code, content, node, start, times, digest = (own.column(c).to_numpy() for c in ("code", "content", "node", "start", "times", "digest"))
            raw = own.column("hashes").to_pylist()
            edges = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)
            path = np.repeat(np.arange(len(raw)), [len(r) // 16 for r in raw])
            p, first, n, s_node, s_digest, s_start = compact(edges, path, node, digest, start)
            used = (times[p] > 1) | (s_node != node[p]) | (s_digest != digest[p]) | (s_start != start[p] + first)
            arrays = [code[p], content[p], first.astype(np.int32), n.astype(np.int32), s_node, s_digest, s_start.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in arrays], ["code", "content", "first", "n", "s_node", "s_digest", "s_start"])

    keyed = paths.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int"))
    return keyed.repartition(parts, "part").sortWithinPartitions("part").select("part", "code", "content", "node", "start", "times", "digest", "hashes").mapInArrow(run, _RUN)


def _by_edge(paths: DataFrame) -> DataFrame:
    """The same stretches for paths of hot anchors, one edge each: edges are grouped by their hashes over all tasks."""
    n = (F.octet_length("hashes") / 16).cast("int")
    each = paths.select("code", "content", "node", "digest", "start", "times", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("first"), F.substring(F.col("hashes"), i * 16 + 1, F.lit(16)).alias("edge")))).alias("x"))
    each = each.select("code", "content", "times", "x.first", "x.edge", F.struct("node", "digest", (F.col("start") + F.col("x.first")).cast("int").alias("start")).alias("at"))
    source = each.groupBy("edge").agg(F.min("at").alias("s"))
    out = each.join(source, "edge").where("times > 1 or s <> at")
    return out.select("code", "content", "first", F.lit(1).alias("n"), F.col("s.node").alias("s_node"), F.col("s.digest").alias("s_digest"), F.col("s.start").alias("s_start"))


def _glued(spans: DataFrame) -> DataFrame:
    """Join stretches of a document that follow each other at one source offset."""
    own = Window.partitionBy("digest", "s_node", "s_digest", "shift").orderBy("start")
    cut = F.when(F.col("start") > F.lag(F.col("start") + F.col("n")).over(own), 1).otherwise(0)
    spans = spans.withColumn("shift", F.col("start") - F.col("s_start")).withColumn("cut", cut).withColumn("island", F.sum("cut").over(own))
    return spans.groupBy("digest", "s_node", "s_digest", "shift", "island").agg(F.min("start").alias("start"), F.sum("n").alias("n")).withColumn("s_start", F.col("start") - F.col("shift")).drop("shift", "island")


def _span_digests(candidates: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """Digest of the words of each source span (s_digest, s_start, n)."""
    held = spans.select("s_digest", "s_start", "n").distinct().groupBy("s_digest").agg(F.collect_list(F.struct("s_start", "n")).alias("held"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "_text"):
            rows = []
            for key, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().split()
                rows += [(key, h["s_start"], h["n"], hashlib.sha256(b" ".join(words[h["s_start"] : h["s_start"] + h["n"] + length - 1])).digest()) for h in held]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["s_digest", "s_start", "n", "words"])

    texts = candidates.select(F.col("digest").alias("s_digest"), "_text").join(held, "s_digest")
    return texts.mapInArrow(digested, "s_digest long, s_start int, n long, words binary")


def _removed(candidates: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """(digest, n_removed, kept_sha256, kept) of the documents with spans; a span whose words differ from the source's is left alone."""
    held = spans.groupBy("digest").agg(F.collect_list(F.struct("start", "n", "words")).alias("held"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "_text"):
            out = []
            for key, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, np.int32)
                for h in held:
                    a, b = h["start"], h["start"] + h["n"] + length - 1
                    if hashlib.sha256(b" ".join(words[a:b])).digest() == h["words"]:
                        gone[a] += 1
                        gone[b] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["digest", "n_removed", "kept_sha256", "kept"])

    return candidates.select("digest", "_text").join(held, "digest").mapInArrow(joined, "digest long, n_removed long, kept_sha256 string, kept string")


def remove_repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 20, hot: int = 20_000, part_edges: int = 1_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every document. ``kept`` holds the remaining words of documents that lost some; null
    stands for all words, or for none where all are removed. Anchors with more than ``hot`` different paths are handled edge by edge;
    ``part_edges`` bounds one bucket."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("digest", F.xxhash64("_text"))
    known = written(_known(rows), "texts")
    nodes = known.groupBy("digest", "sha").agg(F.min("own").alias("node"))
    buckets = anchors.bucket_count(rows, 128 << 20)
    codes = anchors.shared_anchors(rows, lambda texts: _anchors(texts, length), buckets, within=True)
    first = rows.withColumn("node", F.coalesce("doc_id", F.lit(_LAST))).select("digest", "node", "_text")
    named = codes.join(nodes.select("digest", "node"), "digest")
    candidates = written(first.join(named, ["digest", "node"]).dropDuplicates(["digest"]), "candidates")

    paths = _paths(candidates, length)
    least = F.min(F.struct("node", "digest", "start", "edges")).alias("first")
    distinct = written(paths.groupBy("code", "content").agg(least, F.count("*").alias("times")).select("code", "content", "first.*", "times"), "paths")
    busy = distinct.groupBy("code").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("code")
    parts = max(1, (distinct.agg(F.sum("edges")).first()[0] or 0) // part_edges + 1)
    if busy.isEmpty():
        runs = _compacted(_with_edges(distinct, candidates, length), parts)
    else:
        usual, often = (_with_edges(distinct.join(busy, "code", how), candidates, length) for how in ("left_anti", "left_semi"))
        runs = _compacted(usual, parts).unionByName(_by_edge(often))
    runs = written(runs, "runs")
    found = paths.join(runs, ["code", "content"]).withColumn("start", F.col("start") + F.col("first"))
    found = found.where("not (s_node = node and s_digest = digest and s_start = start)")
    spans = written(_glued(found.select("digest", "start", "n", "s_node", "s_digest", "s_start")), "spans")
    verified = spans.join(_span_digests(candidates, spans, length), ["s_digest", "s_start", "n"]).select("digest", "start", "n", "words")
    removed = _removed(candidates, verified, length)

    whole = F.col("own") > F.col("node")
    gone = whole & (F.col("n_words") >= length)
    out = known.join(nodes, ["digest", "sha"]).join(removed, "digest", "left")
    return out.select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).when(whole, 0).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(EMPTY)).when(whole, F.col("sha")).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), F.when(~whole, F.col("kept")).alias("kept"),
    )
