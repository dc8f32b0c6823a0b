"""Ranked lexical search on hashed max-sketches.

The index has a sketch for every document: its terms are hashed to coordinates, and a coordinate keeps the largest number of occurrences
of any of them. What a term adds to a score rises with its occurrences and falls with nothing else of the document but its
length, so the largest number gives the largest impact. A sketch has ``spread`` coordinates for each distinct term, in powers of
two. The number of documents of every term is counted in the same pass.

A batch of items looks its terms up in all sketches: the weights times the impacts at their coordinates add up to a bound on each
document's score, never below it. The documents of the ``ahead`` highest bounds of every item are scored exactly; the score at
place ``k`` is the threshold of the item, and then all documents whose bound reaches the threshold of some item are scored
exactly. No other document can be among the ``k``.

Terms are told apart by 64-bit hashes of their bytes. Items come in blocks of bounded text, so what a task holds of them does not grow;
each block reads the sketches twice and the texts of its candidates.

Null and empty texts and texts without terms are not counted and never found. Rows without an id are ranked like others, after those
with one at equal scores; rows that share an id or a text are rows of their own, each with a place. Of items that repeat both id
and text, one counts; items that share an id but not a text each have ranks from 1. Items without terms, and empty tables, give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A
from .store import written

#: Bytes of a term: not those of ASCII that are neither digits nor letters.
_TERM = np.ones(256, bool)
_TERM[:128] = [chr(i).isalnum() for i in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Numbers of occurrences from here on count as unbounded in a sketch.
_MANY = 255
SKETCHES = "kind int, key long, n long, bits int, entries binary, terms binary, counts binary"


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and occurrences of the distinct terms of each text, by document and hash; and the number of terms of each text."""
    data, offsets = A.text_bytes(texts)
    data = _LOWER[data]
    start, end = A.spans(_TERM[data], offsets)
    doc, word = A.owners(offsets, start), A.word_hashes(data, start, end)
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return word[first], doc[first], np.diff(np.append(first, len(doc))), np.bincount(doc, minlength=len(texts))


def _coordinates(words: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    return (words >> (np.uint64(64) - np.asarray(bits, np.uint64))).astype(np.int64)


def _key() -> F.Column:
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, spread: int = 512) -> DataFrame:
    """Sketches (kind 0) and, for each slice of texts, the number of documents of its terms (kind 1)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text", 2 << 20):
            word, doc, count, n = terms(batch.column("text"))
            of = A.doc_offsets(doc, batch.num_rows)
            bits = np.clip(np.ceil(np.log2(np.maximum(np.diff(of) * spread, 1))), 6, 24).astype(np.int64)
            place = _coordinates(word, bits[doc])
            same = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))) if len(doc) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(np.minimum(count, _MANY), same) if len(same) else np.zeros(0, np.int64)
            entries = (place[same] << 8 | most).astype("<u4")
            ends = A.doc_offsets(doc[same], batch.num_rows)
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(entries.view(np.uint8))])
            none, m = pa.nulls(batch.num_rows, pa.binary()), batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), batch.column("key"), pa.array(n), pa.array(bits.astype(np.int32)), raw, none, none], names)
            every, times = np.unique(word, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([every.tobytes()], pa.binary()), pa.array([times.astype("<u4").tobytes()], pa.binary())], names
            )

    names = ["kind", "key", "n", "bits", "entries", "terms", "counts"]
    return written(docs.select(_key().alias("key"), "text").mapInArrow(sketched, SKETCHES), "sketches")


@dataclass(frozen=True)
class Batch:
    """A block of items: their distinct terms with weights, and for each term the items that hold it."""

    words: np.ndarray
    weights: np.ndarray
    of: np.ndarray  # items of the terms, cut at ``ends``
    ends: np.ndarray
    size: int
    documents: int
    length: int

    def damping(self, n: np.ndarray) -> np.ndarray:
        return 50 + 50 * n * self.documents // self.length

    def add_up(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
        """(documents, items): sums of the impacts; whole numbers, exact in double precision."""
        times = (self.ends[1:] - self.ends[:-1])[term]
        out = np.zeros(n * self.size)
        step = max(1, (1 << 21) // max(int(times.max(initial=1)), 1))
        for a in range(0, len(doc), step):
            t = times[a : a + step]
            own = np.repeat(self.ends[:-1][term[a : a + step]], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            out += np.bincount(np.repeat(doc[a : a + step], t) * self.size + self.of[own], np.repeat(impact[a : a + step], t), n * self.size)
        return out.reshape(n, self.size)

    def bounds(self, entries: np.ndarray, doc: np.ndarray, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(documents, items): no score is higher."""
        place, most = (entries >> 8).astype(np.int64), (entries & 255).astype(np.int64)
        m = self.damping(n)
        parts = []
        for b in np.unique(bits):
            wanted = _coordinates(self.words, int(b))  # rises with the hashes
            own = np.flatnonzero(bits[doc] == b)
            low, high = np.searchsorted(wanted, place[own]), np.searchsorted(wanted, place[own], "right")
            own, low, high = own[high > low], low[high > low], high[high > low]
            t = high - low
            term = np.repeat(low, t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            parts.append((np.repeat(own, t), term))
        own, term = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
        tf = most[own]
        impact = np.where(tf == _MANY, 1_000_000, 1_000_000_000 * tf // (1000 * tf + 20 * m[doc[own]]))
        return self.add_up(doc[own], term, self.weights[term] * impact, len(n))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """(documents, items): the scores."""
        word, doc, tf, n = terms(texts)
        there = A.member(word, self.words)
        word, doc, tf = word[there], doc[there], tf[there]
        term = np.searchsorted(self.words, word)
        return self.add_up(doc, term, self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * self.damping(n)[doc])), len(texts))


def _blocks(items: DataFrame, count: int, size: int) -> Iterator[list[Row]]:
    """Blocks of items of bounded number and text, one at a time; a longer item is alone."""
    held: list[Row] = []
    total = 0
    for row in items.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"].encode())
        if held and (len(held) == count or total + n > size):
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held


def _weighed(index: DataFrame, block: list[Row], documents: int, length: int) -> Batch:
    """The block's terms with the number of documents of each, from the whole index."""
    word, item, _, _ = terms(pa.array([r["text"] for r in block]))
    words, number = np.unique(word, return_inverse=True)
    order = np.argsort(number, kind="stable")
    of, ends = item[order], np.append(0, np.cumsum(np.bincount(number, minlength=len(words))))
    held = index.sparkSession.sparkContext.broadcast(words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for raw, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                found = np.frombuffer(raw.as_buffer(), np.uint64)
                there = A.member(found, held.value)
                total[np.searchsorted(held.value, found[there])] += np.frombuffer(counts.as_buffer(), "<u4")[there]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    got = index.where("kind = 1").select("terms", "counts").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(len(words))
    df[got["term"].to_numpy(np.int64)] = got["df"]
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    return Batch(words, weights, of, ends, len(block), documents, length)


def _sketch_bounds(batch: pa.RecordBatch, block: Batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and bounds of some documents at a time."""
    step = max(1, (1 << 21) // block.size)
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        raw, ends = A.text_bytes(part.column("entries"))
        doc = np.repeat(np.arange(part.num_rows), np.diff(ends) // 4)
        yield part.column("key").to_numpy(), block.bounds(np.frombuffer(raw.tobytes(), "<u4"), doc, part.column("bits").to_numpy().astype(np.int64), part.column("n").to_numpy())


def _largest(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest positive values of each column, with ties."""
    least = np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) > k else np.zeros(values.shape[1])
    return np.nonzero((values >= least) & (values > 0))


def _scored(docs: DataFrame, keys: DataFrame, held, k: int) -> DataFrame:
    """(item, doc_id, score) of the documents with these keys, as many as may be among the ``k`` highest."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in A.slices(batches, "text", 2 << 20):
            for a in range(0, batch.num_rows, step := max(1, (1 << 21) // block.size)):
                part = batch.slice(a, step)
                score = block.scores(part.column("text"))
                doc, item = _largest(score, k)
                yield pa.RecordBatch.from_arrays([pa.array(item), part.column("doc_id").take(pa.array(doc)), pa.array(score[doc, item].astype(np.int64))], ["item", "doc_id", "score"])

    found = docs.withColumn("key", _key()).join(keys.distinct(), "key").select("doc_id", "text").mapInArrow(scored, "item long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", ahead: int = 100, block_items: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: (item_id, rank, doc_id, score)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    items = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    index = build_index(docs)
    sketches = index.where("kind = 0 and n > 0").select("key", "n", "bits", "entries")
    documents, length = sketches.agg(F.count("*"), F.sum("n")).first()
    out = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for rows in _blocks(items, block_items, block_bytes) if documents else ():
        block = _weighed(index, rows, documents, length)
        if not len(block.words):
            continue
        held = spark.sparkContext.broadcast(block)

        def highest(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            """The highest bounds of each item in this task."""
            block = held.value
            keys, values = np.zeros(0, np.int64), np.zeros((0, block.size))
            for batch in batches:
                for key, bound in _sketch_bounds(batch, block):
                    keys, values = np.append(keys, key), np.append(values, bound, axis=0)
                    own = np.unique(_largest(values, ahead)[0])
                    if len(own) < len(keys) // 2 or len(keys) * block.size > 1 << 23:
                        keys, values = keys[own], values[own]
            doc, item = _largest(values, ahead) if len(keys) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(keys[doc]), pa.array(values[doc, item].astype(np.int64))], ["item", "key", "bound"])

        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "key"))
        top = sketches.mapInArrow(highest, "item long, key long, bound long").withColumn("place", place).where(F.col("place") <= ahead)
        tried = _scored(docs, written(top.select("key").distinct(), "tried"), held, k).where(F.col("rank") == k).select("item", "score").toPandas()
        threshold = np.ones(block.size)
        threshold[tried["item"].to_numpy(np.int64)] = tried["score"]  # reached by k documents

        def reaching(batches: Iterator[pa.RecordBatch], held=held, threshold=threshold) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, bound in _sketch_bounds(batch, held.value):
                    yield pa.RecordBatch.from_arrays([pa.array(key[(bound >= threshold).any(1)])], ["key"])

        best = written(_scored(docs, written(sketches.mapInArrow(reaching, "key long").distinct(), "candidates"), held, k), "ranked")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))  # at most block_items names
    return out
