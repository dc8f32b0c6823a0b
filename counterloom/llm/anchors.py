"""Anchors shared between texts: which sampled n-grams of a text also occur in another text.

An operator that looks for long equal spans samples n-grams by a rule that depends on content alone (the smallest hash of each
window), so equal spans carry equal anchors. Only texts with an anchor that another text has can share a span; the
rest of the corpus need not be looked at again.

Anchors travel as binary blobs per bucket. Before the shuffle a task keeps one entry per hash, so a hash that
a large share of the texts has costs one entry per task flush; texts that share it within the flush are told at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

#: Anchors that a task gathers before it sends them.
FLUSH = 1 << 20

_COLUMNS = ["bucket", "kind", "q", "index", "table"]


def minimizers(hashes: np.ndarray, windows: np.ndarray, w: int) -> np.ndarray:
    """Items whose hash is the smallest of some window of ``w`` items, given the windows' first items.

    Ties count every smallest item, which depends on the window's content alone.
    """
    if not len(windows):
        return windows
    valid = np.zeros(len(hashes) - w + 1, bool)
    valid[windows] = True
    # the largest of the minima of the windows that hold an item, as the smallest of their complements
    least = np.full(len(hashes) + w - 1, np.uint64(2**64 - 1))
    np.invert(A.sliding_min(hashes, w), out=least[w - 1 : len(hashes)], where=valid)
    return np.flatnonzero(~A.sliding_min(least, w) == hashes)  # no hash is 0, which stands for no window


def code(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a hash as one number."""
    return (((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)) << np.uint64(32)) | (hashes >> np.uint64(32))


def _rows(buckets: np.ndarray, kind: int, columns: list[np.ndarray], digests: np.ndarray | None) -> Iterator[tuple]:
    """One row per bucket; digests as a table of the distinct ones and short indexes."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    ordered = buckets[order]
    cuts = [0, *(np.flatnonzero(np.diff(ordered)) + 1).tolist(), len(ordered)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        at = order[a:b]
        index, table = b"", b""
        if digests is not None:
            names, number = np.unique(digests[at], return_inverse=True)
            index, table = number.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32).tobytes(), names.tobytes()
        yield int(ordered[a]), kind, b"".join(c[at].tobytes() for c in columns), index, table


def _flush(hashes: np.ndarray, digests: np.ndarray, within: np.ndarray, buckets: int) -> Iterator[tuple]:
    yield from _rows((digests[within].view(np.uint64) % np.uint64(buckets)).astype(np.int64), 2, [(hashes[within] >> np.uint64(32)).astype(np.uint32)], digests[within])
    order = np.lexsort((digests, hashes))
    hashes, digests = hashes[order], digests[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (digests[1:] != digests[:-1])
    hashes, digests = hashes[fresh], digests[fresh]
    codes = code(hashes, buckets)
    again = np.zeros(len(hashes), bool)
    same = hashes[1:] == hashes[:-1]
    again[1:] |= same
    again[:-1] |= same
    one = ~again
    split = lambda c: ((c >> np.uint64(32)).astype(np.int64), [c.astype(np.uint32)])
    yield from _rows(*split(codes[one])[:1], 0, split(codes[one])[1], digests[one])
    seen = np.unique(codes[again])
    yield from _rows(*split(seen)[:1], 1, split(seen)[1], None)
    told = (digests[again].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    yield from _rows(told, 2, [codes[again].astype(np.uint32)], digests[again])


def _digests(index: bytes, table: bytes, n: int) -> np.ndarray:
    names = np.frombuffer(table, np.int64)
    return names[np.frombuffer(index, np.uint16 if len(index) == 2 * n else np.uint32)] if n else np.zeros(0, np.int64)


def shared_anchors(texts: DataFrame, find: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], buckets: int, within: bool = False, slice_bytes: int = A.SLICE_BYTES) -> DataFrame:
    """(digest, codes): for every text with a shared anchor, the 32-bit codes of its shared anchors.

    ``texts`` has ``digest``, a 64-bit hash of the text, and ``_text``; ``find`` gives document numbers and hashes of the anchors of a
    column of texts of about ``slice_bytes``. Equal texts count as one; with ``within``, an anchor that a text has twice counts as shared. Codes may repeat, and two anchors may share one by chance, so a code is a candidate only.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, digests, again, held = [], [], [], 0

        def rows() -> pa.RecordBatch:
            columns = list(zip(*_flush(*map(np.concatenate, (hashes, digests, again)), buckets), strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _COLUMNS)

        for batch in A.slices(batches, "_text", slice_bytes):
            doc, found = find(batch.column("_text"))
            hashes.append(found)
            digests.append(batch.column("digest").to_numpy()[doc])
            again.append(A.repeated(found ^ A.mix(doc.astype(np.uint64) + np.uint64(1))) if within else np.zeros(len(found), bool))
            held += len(found)
            if held >= FLUSH:
                yield rows()
                hashes, digests, again, held = [], [], [], 0
        if held:
            yield rows()

    def judged(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = [(np.frombuffer(q, np.uint32), i, t) for _, kind, q, i, t in rows if kind == 0]
        flagged = [np.frombuffer(q, np.uint32) for _, kind, q, _, _ in rows if kind == 1]
        for _, kind, q, i, t in rows:
            if kind == 2:
                codes = np.frombuffer(q, np.uint32)
                yield _digests(i, t, len(codes)), codes
        if not own:
            return
        q = np.concatenate([x for x, _, _ in own])
        digest = np.concatenate([_digests(i, t, len(x)) for x, i, t in own])
        order = np.lexsort((digest, q))
        q, digest = q[order], digest[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (digest[1:] != digest[:-1])
        q, digest = q[fresh], digest[fresh]
        twice = np.unique(np.concatenate([q[1:][q[1:] == q[:-1]], *flagged]))
        hit = A.member(q, twice)
        yield digest[hit], q[hit]

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def told() -> Iterator[pa.RecordBatch]:
            for digest, codes in judged(held):
                for a in range(0, len(digest), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(digest[a : a + 100_000]), pa.array(codes[a : a + 100_000].view(np.int32))], ["digest", "code"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield from told()
                    held = []
                held.append(row)
        if held:
            yield from told()

    blobs = texts.select("digest", "_text").mapInArrow(sent, "bucket int, kind int, q binary, index binary, table binary")
    dealt = blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(answered, "digest long, code int").groupBy("digest").agg(F.collect_list("code").alias("codes"))


def wanted(codes: pa.Array, own: np.ndarray) -> np.ndarray:
    """Sorted keys of the shared anchors of a batch of documents, from the lists of codes; ``own`` tells documents apart."""
    doc = np.repeat(np.arange(len(codes)), np.diff(np.asarray(codes.offsets)))
    return np.unique(A.mix(np.asarray(codes.flatten()).view(np.uint32).astype(np.uint64)) ^ own[doc])


def is_wanted(hashes: np.ndarray, doc: np.ndarray, keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    return A.member(A.mix(hashes >> np.uint64(32)) ^ own[doc], keys)


def bucket_count(texts: DataFrame, bytes_per_bucket: int = 32 << 20) -> int:
    """Buckets of about ``bytes_per_bucket`` of text, at least one per shuffle partition."""
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // bytes_per_bucket + 1)
