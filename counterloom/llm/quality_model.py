"""Quality classifier on random-indexing word vectors.

``word_vectors`` gives every word a random sparse index vector, drawn from its hash, and sums up, over all documents, the index
vectors of its neighbours. There is no vocabulary: every distinct word has a vector of its own. A document is pooled to the mean and spread of its tokens' vectors. A two-layer
network learns from pooled labelled documents; a temperature fitted on labelled rows that it did not see makes its outputs probabilities.

Tokens are runs of letters, of digits and of other characters between white space, in their own case. Null and empty texts have
no tokens: their pooled vector is 0 and they are scored like any other. Repeated rows get equal scores.
Labels other than 0 and 1 are ignored; without labels of both kinds every score is their mean, or 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import hashed_sample, text_digest, written

#: Bytes of text and tokens handled at once, and words whose sums a task holds before it passes them on.
SLICE, TOKENS, WORDS = 1 << 20, 1 << 15, 200_000

#: Class of each byte: white space, letter (with all non-ASCII), digit, other.
_KIND = np.full(256, 3, np.int8)
_KIND[A.SPACE] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash, which stands for the word, and document of every token."""
    data, offsets = A.text_bytes(texts)
    kind = _KIND[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[offsets[:-1][np.diff(offsets) > 0]] = True
    edge = np.append(np.flatnonzero(fresh), len(data))
    start, end = edge[:-1], edge[1:]
    inside = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[inside], end[inside]
    return A.word_hashes(data, start, end), A.owners(offsets, start)


def index_vectors(words: np.ndarray, width: int, seed: int, ones: int = 4) -> np.ndarray:
    """Sparse vector of each word, drawn by seeded hashes of the word itself: ``ones`` entries of +1 or -1 each."""
    out = np.zeros((len(words), width), np.int8)
    for i in range(ones):
        h = A.seeded(words, seed * 31 + i)
        out[np.arange(len(words)), (h >> np.uint64(1)) % np.uint64(width)] += np.where(h & np.uint64(1), 1, -1).astype(np.int8)
    return out


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values from the bytes of ``data``, cut at ``ends`` (from 0)."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of whole numbers as binary: half a byte each where all are very small, as those of most words, a byte, or eight."""
    n, width = rows.shape
    most = np.abs(rows).max(axis=1, initial=0)
    half, small = (most < 8) & (width > 1), most < 128
    size = np.where(half, (width + 1) // 2, np.where(small, width, 8 * width))
    ends = np.append(0, np.cumsum(size))
    out = np.zeros(ends[-1], np.uint8)

    def put(own: np.ndarray, part: np.ndarray) -> None:
        out[ends[:-1][own][:, None] + np.arange(part.shape[1])] = part

    pairs = np.zeros((int(half.sum()), (width + 1) // 2 * 2), np.uint8)
    pairs[:, :width] = rows[half] + 8
    put(half, pairs[:, ::2] << 4 | pairs[:, 1::2])
    for kind, own in ((np.int8, small & ~half), (np.int64, ~small)):
        put(own, np.ascontiguousarray(rows[own].astype(kind)).view(np.uint8).reshape(-1, width * np.dtype(kind).itemsize))
    return _binary(out, ends)


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    data, ends = A.text_bytes(column)
    size, out = np.diff(ends), np.zeros((len(column), width), np.int64)
    for kind, own in ((np.int8, size == width), (np.int64, size == 8 * width)):
        at = ends[:-1][own][:, None] + np.arange(width * np.dtype(kind).itemsize)
        out[own] = np.ascontiguousarray(data[at]).view(kind).reshape(-1, width)
    half = np.flatnonzero((size == (width + 1) // 2) & (width > 1))
    pairs = data[ends[:-1][half][:, None] + np.arange((width + 1) // 2)]
    out[half] = np.stack([pairs >> 4, pairs & 15], axis=2).reshape(len(half), 2 * pairs.shape[1])[:, :width].astype(np.int64) - 8
    return out


#: Vectors are whole numbers of this part of their length where they are summed by document.
STEPS = 4096

def _entries(doc: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a group that hold a word, and how often: bytes, and where the bytes of each word begin and the last ends.

    ``doc`` is ascending within each word; ``first`` has each word's first entry. An entry is a number of seven bits a byte, of which the last
    byte is below 128: the step from the word's previous document, plus 65,536 for each occurrence but one. Most take a byte.
    """
    step = np.diff(doc, prepend=0)
    step[first] = doc[first]
    number = (count - 1) << 16 | step
    size, most = np.ones(len(number), np.int64), int(number.max(initial=0))
    while most := most >> 7:
        size += number >> 7 * size > 0
    ends = np.append(0, np.cumsum(size))
    out = np.zeros(ends[-1], np.uint8)
    for i in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > i)
        out[ends[own] + i] = number[own] >> 7 * i & 127 | np.where(size[own] > i + 1, 128, 0)
    return out, ends[np.append(first, len(doc))]


def _entries_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and count of every entry of a column of ``_entries``."""
    data, ends = A.text_bytes(column)
    last = np.flatnonzero(data < 128)
    begin = np.append(0, last[:-1] + 1)[: len(last)]
    number = np.zeros(len(last), np.int64)
    for i in range(int((last - begin).max(initial=-1)) + 1):
        own = np.flatnonzero(begin + i <= last)
        number[own] |= (data[begin[own] + i].astype(np.int64) & 127) << 7 * i
    row = np.searchsorted(ends, begin, "right") - 1
    total = np.append(0, np.cumsum(number & 65535))
    return row, total[1:] - total[np.searchsorted(begin, ends[row])], (number >> 16) + 1


def _joined(*columns: pa.Array) -> bytes:
    """Binary columns of equal length as one value, the lengths and the bytes of each compressed by themselves."""
    out = [len(columns[0]).to_bytes(4, "little")]
    for column in columns:
        raw, ends = A.text_bytes(column)
        for part in (np.diff(ends).astype("<i4").tobytes(), raw.tobytes()):
            small = pa.compress(part, codec="zstd", asbytes=True)
            out += [len(part).to_bytes(4, "little"), len(small).to_bytes(4, "little"), small]
    return b"".join(out)


def _split(raw: bytes, columns: int = 2) -> list[pa.Array]:
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []

    def part() -> bytes:
        nonlocal at
        whole, small = (int.from_bytes(raw[i : i + 4], "little") for i in (at, at + 4))
        at += 8 + small
        return pa.decompress(raw[at - small : at], decompressed_size=whole, codec="zstd", asbytes=True)

    for _ in range(columns):
        ends = np.append(0, np.cumsum(np.frombuffer(part(), "<i4", n)))
        out.append(_binary(np.frombuffer(part(), np.uint8), ends))
    return out


@dataclass(frozen=True)
class WordVectors:
    """Context sums by word, a table of (word, sums), and the common direction that is taken off."""

    sums: DataFrame
    common: np.ndarray

    @property
    def width(self) -> int:
        return len(self.common)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def context_vectors(sums: pa.Array, common: np.ndarray) -> np.ndarray:
    """Vectors of length 1 without their common direction."""
    return _unit(_unit(_unpacked(sums, len(common)).astype(np.float64)) - common).astype(np.float32).astype(np.float64)


def _merged(words: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of equal words added up."""
    if not len(words):
        return words, sums
    order = np.argsort(words, kind="stable")
    words = words[order]
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    return words[first], np.add.reduceat(sums[order], first, axis=0)


def _contexts(words: np.ndarray, doc: np.ndarray, width: int, reach: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and the sums of their neighbours' index vectors, for some tokens at a time; this bounds the rows of vectors."""
    for a in range(0, len(words), TOKENS):
        b = min(a + TOKENS, len(words))
        low, high = max(a - reach, 0), min(b + reach, len(words))
        held, number = np.unique(words[low:high], return_inverse=True)
        own, of = index_vectors(held, width, seed)[number], doc[low:high]
        near = np.zeros((high - low, width), np.int32)
        for step in range(1, reach + 1):
            same = (of[step:] == of[:-step])[:, None]
            near[:-step] += own[step:] * same
            near[step:] += own[:-step] * same
        yield _merged(words[a:b], near[a - low : b - low])


def word_vectors(docs: DataFrame, text: str = "text", width: int = 24, reach: int = 2, seed: int = 11) -> WordVectors:
    """Context sums of all words over all documents; ``context_vectors`` makes vectors of them.

    A word is its 64-bit hash. Tasks sum the contexts of their words for each slice of text; these are summed by word. Only the common
    direction goes through the driver.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = np.zeros(0, np.uint64), np.zeros((0, width), np.int32)
        new: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in A.slices(batches, "_text", SLICE):
            for part in _contexts(*_tokens(batch.column("_text")), width, reach, seed):
                new.append(part)
                waiting += len(part[0])
                if waiting > WORDS // 2:
                    words, sums = _merged(*(np.concatenate(x) for x in zip((words, sums), *new, strict=True)))
                    new, waiting = [], 0
                    if len(words) > WORDS:
                        yield from rows(words, sums)
                        words, sums = words[:0], sums[:0]
        yield from rows(*_merged(*(np.concatenate(x) for x in zip((words, sums), *new, strict=True))))

    def rows(words: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(words), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 20_000].view(np.int64)), _packed(sums[a : a + 20_000])], ["word", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (np.zeros(0, np.uint64), np.zeros((0, width), np.int64))
        for batch in batches:  # by word: the last one may go on in the next batch
            words, sums = _merged(np.append(last[0], batch.column("word").to_numpy().view(np.uint64)), np.append(last[1], _unpacked(batch.column("sums"), width), axis=0))
            order = np.argsort(words.view(np.int64), kind="stable")
            yield from rows(words[order[:-1]], sums[order[:-1]])
            last = words[order[-1:]], sums[order[-1:]]
        yield from rows(*last)

    parts = docs.select(F.col(text).alias("_text")).mapInArrow(contexts, "word long, sums binary")
    merged = parts.repartition("word").sortWithinPartitions("word").mapInArrow(summed, "word long, sums binary")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)  # whole numbers, whose sum does not depend on the order
        for batch in batches:
            rows = _unit(_unpacked(batch.column("sums"), width).astype(np.float64))
            total += np.append(np.rint(rows * 2**20).astype(np.int64).sum(axis=0), len(rows))
        yield pa.RecordBatch.from_arrays([_lists(total[None])], ["total"])

    words = written(merged, "words")
    got = words.select("sums").mapInArrow(totals, "total array<long>").agg(*(F.sum(F.col("total")[i]) for i in range(width + 1))).first()
    total = np.array([x or 0 for x in got], np.float64)
    return WordVectors(words, total[:width] / 2**20 / max(total[width], 1))


def pooled(docs: DataFrame, vectors: WordVectors, doc_id: str = "doc_id", text: str = "text", group_bytes: int = 32 << 20) -> DataFrame:
    """Mean and spread of the token vectors of every whole text, and the logarithm of its length: (doc_id, digest, pooled).

    Texts are taken in groups of about ``group_bytes``. A group has one row for each of its words, with the documents that hold it and
    how often; joined to the words' sums, the rows of a group come together again, many in one, and their vectors are summed by
    document in steps of 1 / ``STEPS``. A frequent word has a row for each group, not for each document.
    """

    common, width = vectors.common, vectors.width

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        ids: list[pa.RecordBatch] = []
        size = documents = 0

        def table() -> Iterator[pa.RecordBatch]:
            words, doc, count = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(words, kind="stable")
            words, doc, count = words[order], doc[order].astype(np.int64), count[order].astype(np.int64)
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
            entries, ends = _entries(doc, count, first)
            for a in range(0, len(first), 20_000):
                b = min(a + 20_000, len(first))
                at, raw = ends[a : b + 1] - ends[a], entries[ends[a] : ends[b]]
                yield row(b - a, group=pa.array(np.full(b - a, group)), word=pa.array(words[first[a:b]].view(np.int64)), held=_binary(raw, at))
            done = 0
            for part in ids:
                n = part.num_rows
                spread = A.mix((np.arange(done, done + n) + (group << 16)).astype(np.uint64)).view(np.int64)  # any word: the join keeps the row as it is
                yield row(n, group=pa.array(np.full(n, group)), word=pa.array(spread), at=pa.array(np.arange(done, done + n, dtype=np.int32)), doc_id=part.column("doc_id"), digest=part.column("digest"))
                done += n

        for batch in (part.slice(a, 10_000) for part in A.slices(batches, "_text", SLICE) for a in range(0, part.num_rows, 10_000)):
            words, doc = _tokens(batch.column("_text"))
            distinct, number = np.unique(words, return_inverse=True)
            pairs, count = np.unique(number * batch.num_rows + doc, return_counts=True)
            held.append((distinct[pairs // batch.num_rows], (pairs % batch.num_rows + documents).astype(np.int32), count.astype(np.int32)))
            ids.append(batch.select(["doc_id", "digest"]))
            documents += batch.num_rows
            size += batch.column("_text").nbytes
            if size >= group_bytes or documents >= 20_000:
                yield from table()
                group, held, ids, size, documents = group + 1, [], [], 0, 0
        if documents:
            yield from table()

    def row(n: int, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, t)) for c, t in kinds.items()], list(kinds))

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of documents, and for each group of some batches a row with all sums and entries."""
        waiting: list[pa.RecordBatch] = []
        size = 0

        def table() -> Iterator[pa.RecordBatch]:
            rest = pa.Table.from_batches(waiting)
            order = np.argsort(rest["group"].to_numpy(), kind="stable")
            rest = rest.take(pa.array(order)).combine_chunks()
            group, sums, held = (rest[c].combine_chunks() for c in ("group", "sums", "held"))
            ends = np.append(np.flatnonzero(np.append(True, np.diff(group.to_numpy()) != 0)), len(group))
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield row(1, group=group[a:a + 1], held=pa.array([_joined(sums[a:b], held[a:b])], pa.binary()))

        for batch in batches:
            known = batch.filter(batch.column("at").is_valid())
            if known.num_rows:
                yield row(known.num_rows, **{c: known.column(c) for c in ("group", "at", "doc_id", "digest")})
            rest = batch.filter(batch.column("at").is_null()).select(["group", "sums", "held"])
            if rest.num_rows:
                waiting.append(rest)
                size += rest.nbytes
            if size >= 8 << 20:  # so that a group has many words in a row, however many groups there are
                yield from table()
                waiting, size = [], 0
        if waiting:
            yield from table()

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in A.grouped(batches, "group"):
            known = rows.filter(rows["at"].is_valid()).sort_by("at")
            n = known.num_rows
            sums, tokens = np.zeros((n, 2 * width), np.int64), np.zeros(n, np.int64)
            for raw in rows.filter(rows["at"].is_null())["held"].to_pylist():
                (of_words, held) = _split(raw)
                vector = np.rint(context_vectors(of_words, common) * STEPS).astype(np.int64)
                both = np.concatenate([vector, vector**2], axis=1)
                of, doc, count = _entries_of(held)
                for a in range(0, len(doc), TOKENS):  # bounds the rows of vectors
                    own = slice(a, a + TOKENS)
                    order = np.argsort(doc[own], kind="stable")
                    part = doc[own][order]
                    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                    sums[part[first]] += np.add.reduceat(both[of[own][order]] * count[own][order][:, None], first, axis=0)
                tokens += np.bincount(doc, count, n).astype(np.int64)
            each = np.maximum(tokens, 1)[:, None]
            mean, square = sums[:, :width] / (STEPS * each), sums[:, width:] / (STEPS * STEPS * each)
            got = np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(tokens)[:, None]], axis=1).astype(np.float32)
            for a in range(0, n, 10_000):
                part = known.slice(a, 10_000).combine_chunks()
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), part["digest"].combine_chunks(), _lists(got[a : a + 10_000])], ["doc_id", "digest", "pooled"])

    kinds = {"group": pa.int64(), "word": pa.int64(), "held": pa.binary(), "at": pa.int32(), "doc_id": pa.int64(), "digest": pa.string()}
    schema = "group long, word long, held binary, at int, doc_id long, digest string"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_digest(F.col(text)).alias("digest"), F.col(text).alias("_text"))
    found = rows.mapInArrow(counted, schema).join(vectors.sums, "word", "left").mapInArrow(by_group, schema).drop("word")
    return found.repartition("group").sortWithinPartitions("group").mapInArrow(pool, "doc_id long, digest string, pooled array<float>")


@dataclass(frozen=True)
class Network:
    """Two layers: tanh of a linear layer, then a logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.tanh((rows - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows) / self.temperature, -30, 30)))


def fit_network(rows: np.ndarray, labels: np.ndarray, hidden: int = 24, epochs: int = 40, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on cross entropy over four fifths of the rows; the rest sets the temperature. A constant where one label is missing."""
    if len(np.unique(labels)) < 2:
        p = float(np.mean(labels)) if len(labels) else 0.5
        p = min(max(p, 1e-3), 1 - 1e-3)
        d = rows.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, own = order[: len(rows) // 5], order[len(rows) // 5 :]
    mean, scale = rows[own].mean(0), rows[own].std(0) + 1e-6
    x, y = (rows[own] - mean) / scale, labels[own].astype(np.float64)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        turn = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            i = turn[a : a + batch]
            h = np.tanh(x[i] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
            back = np.outer(e, p[2]) * (1 - h**2)
            grads = [x[i].T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], np.array([e.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                p[k] = p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if not len(held):
        return net
    z, y = net.logits(rows[held]), labels[held]
    options = np.geomspace(0.2, 10, 120)
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in options]
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(options[int(np.argmin(loss))]))


def score(features: DataFrame, network: Network) -> DataFrame:
    """Add the column ``score`` to rows of (doc_id, digest, pooled)."""
    held = features.sparkSession.sparkContext.broadcast(network)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("pooled").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(np.round(held.value.probabilities(rows), 9))], ["doc_id", "digest", "score"])

    return features.select("doc_id", "digest", "pooled").mapInArrow(scored, "doc_id long, digest string, score double")


def labelled_sample(features: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """(pooled, label) of at most ``limit`` ids of ``known``, chosen by a hash of the id: one row for each, however many repeat it."""
    ids = hashed_sample(known.join(features.select("doc_id").distinct(), "doc_id"), ("doc_id", "label"), limit)
    return features.join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("pooled").alias("pooled")).orderBy("doc_id").select("pooled", "label")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 20_000, digests: bool = False) -> DataFrame:
    """Probability of label 1 for every document: (doc_id, score). ``labels`` holds only rows to learn from. ``digest``, the SHA-256 of
    the text, is kept where ``digests`` is set.

    The network learns from at most ``sample`` labelled ids, chosen by a hash of the id; word vectors come from all documents.
    """
    vectors = word_vectors(docs)
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(2))  # one half after the other, so that only one is shuffled at a time
    features = reduce(DataFrame.unionByName, [written(pooled(docs.where(half == k), vectors), "pooled") for k in (0, 1)])
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = labelled_sample(features, known, sample).toPandas()
    width = len(features.first()["pooled"]) if chosen.empty and features.head(1) else len(chosen["pooled"].iloc[0]) if len(chosen) else 1
    rows = np.array(chosen["pooled"].tolist(), np.float64).reshape(-1, width)
    scores = score(features, fit_network(rows, chosen["label"].to_numpy()))
    return scores if digests else scores.drop("digest")
