"""Vector codes of parts: a codebook for each part of a vector, improved by rounds of assignment over a trie of distinct parts.

Components become whole numbers, floor(256 x). A vector is cut into equal parts, and each part position has a codebook of entries.
The distinct parts of a position, with how many vectors hold them, are kept in lexicographic order, which is the order of a depth-first
walk through their trie: parts that begin alike follow one another. The walk keeps the squared distances of a prefix to all entries
once for all parts that continue it; a leaf takes the nearest entry, and adds its part to that entry's sum as often as vectors hold it.

A round reads the distinct parts, not the vectors, so a vector that a third of all rows hold counts once. Tasks return one row for each entry that
they have sums for; only codebooks, of ``parts * entries`` rows at most, go through the driver. The last assignment walks the tries of
the rows at hand.

Rows take no part whose vector is null, holds a null or non-finite component, or has another length than most rows, or none that ``parts``
divides. Fewer rows than entries give smaller codebooks. Whole numbers beyond 2**27 either way count as that. A null id sorts last among the
rows that start the codebooks and is kept; rows that repeat an id are rows of their own, the smaller vector first. Empty tables give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .multiprobe import common_length, usable
from .store import written

_LIMIT = 1 << 27
#: Leaves walked at once.
_LEAVES = 4096


def whole_numbers(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, width) of floor(256 x)."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.clip(np.floor(x * 256), -_LIMIT, _LIMIT).astype(np.int64).reshape(len(column), parts, -1)


def encoded(parts: np.ndarray) -> pa.Array:
    """Parts as bytes that sort like the numbers."""
    raw = (parts + (1 << 31)).astype(">u4")
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer((np.arange(len(parts) + 1) * 4 * parts.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw).view(np.uint8))])


def decoded(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, width).astype(np.int64) - (1 << 31)


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographically ordered distinct parts, and the number of each given one among them."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    fresh = np.ones(len(parts), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(1)
    number = np.zeros(len(parts), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return ordered[fresh], number


def walk(leaves: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each of the ordered distinct parts, the first of equally near ones, and its squared distance.

    ``shared`` has a row of distances for each distinct prefix so far; the next component is added once to each longer prefix.
    """
    code, error = np.zeros(len(leaves), np.int64), np.zeros(len(leaves), np.int64)
    for a in range(0, len(leaves), _LEAVES):
        part = leaves[a : a + _LEAVES]
        shared, of = np.zeros((1, len(entries)), np.int64), np.zeros(len(part), np.int64)
        fresh = np.zeros(len(part), bool)
        fresh[:1] = True
        for i in range(part.shape[1]):
            fresh[1:] |= part[1:, i] != part[:-1, i]
            node = np.flatnonzero(fresh)
            shared = shared[of[node]] + (part[node, i][:, None] - entries[:, i]) ** 2
            of = np.cumsum(fresh) - 1
        code[a : a + _LEAVES] = shared.argmin(1)
        error[a : a + _LEAVES] = shared.min(1)
    return code, error


def _distinct_parts(rows: DataFrame, parts: int) -> DataFrame:
    """(position, part, n) in ranges of (position, part)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column("vector"), parts)
            for i in range(parts if len(x) else 0):
                own, number = distinct(x[:, i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), encoded(own), pa.array(np.bincount(number))], ["position", "part", "n"])

    some = rows.select("vector").mapInArrow(counted, "position int, part binary, n long")
    ranges = some.repartitionByRange("position", "part").groupBy("position", "part").agg(F.sum("n").alias("n"))
    return written(ranges.sortWithinPartitions("position", "part"), "parts")


def _next(leaves: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Entries moved to the means of the parts assigned to them, rounded down; those without parts stay."""
    width, names = codebooks.shape[2], [f"s{i}" for i in range(codebooks.shape[2])]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*codebooks.shape[:2], width + 1), np.int64)
        for batch in batches:
            position, part, n = batch.column("position").to_numpy(), decoded(batch.column("part"), width), batch.column("n").to_numpy()
            for i in np.unique(position):
                own = np.flatnonzero(position == i)
                code, _ = walk(part[own], codebooks[i])
                np.add.at(total[i], code, np.append(part[own], np.ones((len(own), 1), np.int64), axis=1) * n[own, None])
        i, e = np.nonzero(total[..., -1])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(e.astype(np.int32)), *(pa.array(c) for c in np.ascontiguousarray(total[i, e].T))], ["position", "entry", *names, "n"])

    sums = leaves.mapInArrow(summed, "position int, entry int, " + "".join(f"{s} long, " for s in names) + "n long").groupBy("position", "entry").agg(*(F.sum(c).alias(c) for c in (*names, "n")))
    out = codebooks.copy()
    for row in sums.collect():  # one for each entry
        out[row["position"], row["entry"]] = [row[s] // row["n"] for s in names]
    return out


def encode(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row that takes part."""
    spark = rows.sparkSession
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    named = named.where(usable(F.col("vector")))
    d = common_length(named, "vector")
    kept = named.where((F.size("vector") == d) & (F.size("vector") % parts == 0) & (F.size("vector") > 0))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).toArrow()["vector"].combine_chunks()
    kind = named.schema["label"].dataType
    if not len(first):
        return spark.createDataFrame([], f"vec_id long, label {kind.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    codebooks = np.ascontiguousarray(whole_numbers(first, parts).transpose(1, 0, 2))
    leaves = _distinct_parts(kept, parts)
    for _ in range(rounds):
        codebooks = _next(leaves, codebooks)
    hexes = np.array([f"{e:02x}" for e in range(len(codebooks[0]))])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column("vector"), parts)
            code, error = np.zeros(x.shape[:2], np.int64), np.zeros(len(x), np.int64)
            for i in range(parts if len(x) else 0):
                own, number = distinct(x[:, i])
                nearest, apart = walk(own, codebooks[i])
                code[:, i], error = nearest[number], error + apart[number]
            text = pa.array(["".join(c) for c in hexes[code]], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(error)], ["vec_id", "label", "code", "error"])

    out = written(kept.mapInArrow(coded, f"vec_id long, label {kind.simpleString()}, code string, error long"), "codes")
    total = out.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    return out.join(total, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
