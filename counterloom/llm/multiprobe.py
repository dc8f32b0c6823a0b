"""Nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are lifted to the unit sphere, where the largest inner product is the smallest distance: rows are divided by the largest
norm and get the missing length as one more component, queries get length 1 and a zero. A table hashes a point by the slots that a few
Gaussian projections put it in; all slots together name its bucket. A query visits the buckets of every table in the order of their
estimated success, the chance that the slots hold a neighbour at the usual distance, whose projections are spread normally around the query's
own. What the visited buckets of all tables hold is reranked by inner products in double precision.

Fitted on bounded samples: slot width and number of projections on ``sample`` rows, the usual distance and the number of visits
on the true neighbours of ``tries`` queries, found by comparing these with all rows. The visits are the fewest that find the share
``recall`` of them. Every row is indexed. Queries that find fewer than ``k`` are answered by comparing them with all rows, in blocks.

Equal vectors are one point with the smallest ids that can be among ``k``. A bucket of more than 1 / 4096 of all points is
dealt in pieces, which every query that visits the bucket visits: there are at most 4096 of these in a table, whatever the input.

Rows take no part whose id is null, or whose vector is null, zero, holds a null or non-finite component, or has another
length than most rows (of two equally frequent lengths the smaller counts). Of rows that repeat an id, that with the smallest vector
counts. Ties go to the smaller id. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A
from .store import written

FOUND = "array<struct<minus: double, vec_id: bigint, node: bigint>>"
#: Slots on either side of a query's own that a neighbour may be in.
STEPS = np.arange(-2, 3)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    x = vector.cast("array<double>")
    return vector.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def common_length(rows: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors, the smaller of two; 0 without rows."""
    top = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top["d"] if top else 0


def _points(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, one for each id."""
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector")).where("vec_id is not null")
    good = named.where(usable(F.col("vector")) & F.exists("vector", lambda v: v != 0))
    return good.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), d)


@dataclass(frozen=True)
class Index:
    """The hash functions of all tables, and how a query visits their buckets."""

    lines: np.ndarray  # (d + 1, tables, projections)
    shift: np.ndarray  # (tables, projections)
    factor: np.ndarray  # (tables, projections): what one slot adds to a bucket's number
    width: float
    scale: float
    reach: float
    visits: int = 1
    large: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # buckets dealt in pieces, and their pieces
    pieces: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cells: int = 1

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.append(x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1)), axis=1)
        x = x / self.scale
        return np.append(x, np.sqrt(np.maximum(1 - (x**2).sum(1, keepdims=True), 0)), axis=1)

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(points, tables, projections) in units of a slot."""
        return np.tensordot(self.lifted(x, query), self.lines, 1) / self.width + self.shift

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(points, tables): the bucket of each row in each table."""
        return _number((np.floor(self.places(x, False)).astype(np.int64).view(np.uint64) * self.factor).sum(2))

    def visited(self, x: np.ndarray) -> np.ndarray:
        """(queries, tables, visits): buckets by falling estimated success.

        The best sums over some projections extend the best sums over fewer, so ``visits`` of them are kept at each projection.
        """
        place = self.places(x, True)
        own = np.floor(place)
        side = place - own
        spread = self.reach / self.width

        def below(z: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(np.clip(-1.702 * z / spread, -60, 60)))  # close to the normal distribution

        chance = np.log(np.maximum(below(STEPS + 1 - side[..., None]) - below(STEPS - side[..., None]), 1e-12))
        key = (own.astype(np.int64).view(np.uint64) * self.factor).sum(2)[..., None]
        score = np.zeros(key.shape)
        for i in range(place.shape[2]):
            score = (score[..., :, None] + chance[:, :, None, i, :]).reshape(*score.shape[:2], -1)
            key = (key[..., :, None] + (STEPS.astype(np.int64).view(np.uint64) * self.factor[:, i, None])[None, :, None, :]).reshape(score.shape)
            if score.shape[2] > self.visits:
                best = np.argpartition(-score, self.visits - 1, axis=2)[..., : self.visits]
                score, key = np.take_along_axis(score, best, 2), np.take_along_axis(key, best, 2)
        return _number(np.take_along_axis(key, np.argsort(-score, axis=2, kind="stable"), 2))

    def piece(self, buckets: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The piece of its bucket that each row belongs to, as a number like a bucket's."""
        if not len(self.large):
            return buckets
        at = np.minimum(np.searchsorted(self.large, buckets), len(self.large) - 1)
        n = np.where(self.large[at] == buckets, self.pieces[at], 1)
        return _pieces(buckets, (A.mix(nodes.astype(np.uint64)) % n.astype(np.uint64)).astype(np.int64))

    def all_pieces(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces of the buckets, and which of the buckets each belongs to."""
        every = np.arange(len(buckets))
        if not len(self.large):
            return buckets, every
        at = np.minimum(np.searchsorted(self.large, buckets), len(self.large) - 1)
        n = np.where(self.large[at] == buckets, self.pieces[at], 1)
        of = np.repeat(every, n)
        return _pieces(buckets[of], np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)), of

    def cell(self, pieces: np.ndarray) -> np.ndarray:
        """Where a piece is compared: cells hold many small pieces."""
        return (A.seeded(pieces.view(np.uint64), 7) % np.uint64(self.cells)).astype(np.int64)


def _number(x: np.ndarray) -> np.ndarray:
    return A.mix(x).view(np.int64)


def _pieces(buckets: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return np.where(piece == 0, buckets, _number(buckets.view(np.uint64) + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _inner(x: np.ndarray, query: np.ndarray, points: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed in the order of the components: equal vectors have equal products wherever they stand."""
    out = np.zeros(len(query))
    for i in range(x.shape[1]):
        out += x[query, i] * points[point, i]
    return out


def _near(product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that may be among the ``k`` largest of their row, with all that are as large but for rounding."""
    if product.shape[1] <= k:
        return np.nonzero(np.ones(product.shape, bool))
    least = -np.partition(-product, k - 1, axis=1)[:, k - 1 : k]
    return np.nonzero(product >= least - 1e-9 * np.maximum(np.abs(least), 1e-300))


class _Best:
    """The ``k`` nearest ids of each query among the points it was shown."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.query, self.minus, self.vec_id, self.node = (np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))

    def add(self, query: np.ndarray, point: np.ndarray, points: np.ndarray, nodes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """``query`` and ``point`` are pairs; ``ids``, cut at ``ends``, are those of each point."""
        pair = np.unique(query * len(points) + point)
        query, point = pair // max(len(points), 1), pair % max(len(points), 1)
        minus = -_inner(self.x, query, points, point) + 0.0
        n = (ends[1:] - ends[:-1])[point]
        own = np.repeat(ends[:-1][point], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        query, minus, point = np.repeat(query, n), np.repeat(minus, n), np.repeat(point, n)
        other = ids[own] != self.ids[query]
        parts = ((self.query, query), (self.minus, minus), (self.vec_id, ids[own]), (self.node, nodes[point]))
        query, minus, vec_id, node = (np.concatenate([a, b[other]]) for a, b in parts)
        order = np.lexsort((vec_id, minus, query))
        query, minus, vec_id, node = query[order], minus[order], vec_id[order], node[order]
        once = np.ones(len(query), bool)
        once[1:] = (query[1:] != query[:-1]) | (vec_id[1:] != vec_id[:-1]) | (minus[1:] != minus[:-1])
        query, minus, vec_id, node = query[once], minus[once], vec_id[once], node[once]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.query, self.minus, self.vec_id, self.node = query[keep], minus[keep], vec_id[keep], node[keep]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row for each query that found something."""
        seen, first = np.unique(self.query, return_index=True)
        ends = np.append(first, len(self.query)).astype(np.int32)
        for a in range(0, len(seen), 5000):
            b = min(a + 5000, len(seen))
            own = slice(ends[a], ends[b])
            kinds = pa.StructArray.from_arrays([pa.array(c[own]) for c in (self.minus, self.vec_id, self.node)], ["minus", "vec_id", "node"])
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[seen[a:b]]), pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a]), kinds)], ["query_id", "found"])


def _merged(found: DataFrame, k: int, tables: int = 1) -> DataFrame:
    """The ``k`` nearest of every query: (query_id, found). A row is found once in each table at most."""
    every = F.array_sort(F.flatten(F.collect_list("found")))
    return found.groupBy("query_id").agg(F.slice(F.array_distinct(F.slice(every, 1, k * tables)), 1, k).alias("found"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return column.flatten().to_numpy(), ends


def _by_comparing(nodes: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """The ``k`` nearest of a bounded number of queries, each compared with all rows."""
    held = nodes.sparkSession.sparkContext.broadcast((ids, x))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*held.value, k)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                points = _matrix(part.column("vector"), best.x.shape[1])
                best.add(*_near(best.x @ points.T, k + 1), points, part.column("node").to_numpy(), *_lists(part.column("ids")))
        yield from best.rows()

    return _merged(nodes.mapInArrow(compared, f"query_id long, found {FOUND}"), k)


def _fit(nodes: DataFrame, asked: DataFrame, d: int, k: int, tables: int, recall: float, sample: int, tries: int, bucket: int, cell: int, seed: int) -> Index:
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    n, scale = nodes.agg(F.count("*"), F.max(norm)).first()
    place = F.xxhash64("vec_id")
    some = asked.orderBy(place, "vec_id").limit(tries).toPandas()
    ids, x = some["vec_id"].to_numpy(np.int64), np.array(some["vector"].tolist(), np.float64)
    true = _by_comparing(nodes, ids, x, k).select("query_id", F.explode("found.node").alias("node"))
    pairs = true.join(nodes.select("node", "vector"), "node").toPandas()
    query = np.searchsorted(np.sort(ids), pairs["query_id"].to_numpy(np.int64))
    query = np.argsort(ids)[query] if len(pairs) else query
    near = np.array(pairs["vector"].tolist(), np.float64).reshape(-1, d)
    rows = np.array(nodes.orderBy(F.xxhash64("node"), "node").limit(sample).toPandas()["vector"].tolist(), np.float64)

    rng = np.random.default_rng(seed)
    most = 24
    index = Index(rng.normal(size=(d + 1, tables, most)), rng.random((tables, most)), rng.integers(1, 1 << 63, (tables, most), np.uint64) * np.uint64(2) + np.uint64(1), 1.0, scale, 1.0)
    if not len(near):
        return replace(index, lines=index.lines[..., :1], shift=index.shift[:, :1], factor=index.factor[:, :1])
    apart = np.linalg.norm(index.lifted(x, True)[query] - index.lifted(near, False), axis=1)
    reach = max(float(np.median(apart)), 1e-6)
    index = replace(index, reach=reach, width=2.5 * reach)
    slots = np.floor(index.places(rows, False)[:, 0]).astype(np.int64)
    share = [np.unique(c, return_counts=True)[1] / len(rows) for c in slots.T]
    bits = max(float(np.mean([-(p * np.log(p)).sum() for p in share])), 0.05)
    size = int(np.clip(np.ceil(np.log(max(n / bucket, 1.0)) / bits), 1, most))
    index = replace(index, lines=index.lines[..., :size], shift=index.shift[:, :size], factor=index.factor[:, :size], cells=max(1, -(-n * tables // cell)))

    of = index.buckets(near)
    visits = 8
    while True:
        index = replace(index, visits=visits)
        rank = np.full((len(near), tables), visits, np.int64)
        step = max(1, 200_000 // visits)
        for a in range(0, len(x), step):
            order = index.visited(x[a : a + step])
            for i in np.flatnonzero((query >= a) & (query < a + step)):
                t, at = np.nonzero(order[query[i] - a] == of[i][:, None])
                rank[i, t] = np.minimum(rank[i, t], at)
        first = rank.min(1)
        if (first < visits).mean() >= recall or visits >= len(STEPS) ** size:
            return replace(index, visits=int(np.sort(first)[min(len(first) - 1, int(np.ceil(recall * len(first))))]) + 1)
        visits *= 4


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", tables: int = 4, recall: float = 0.96, sample: int = 2048, tries: int = 128, bucket: int = 64, cell: int = 8192, block: int = 1024, seed: int = 3) -> DataFrame:
    """The ``k`` rows of largest inner product found for every query: (query_id, rank, vec_id, score), without the row of its own id.

    ``bucket`` is the wanted number of rows in a bucket, ``cell`` in what is compared at once, ``block`` that of queries compared
    with all rows.
    """
    spark = rows.sparkSession
    points = written(_points(rows, vec_id, vector), "points")
    d = common_length(points, "vector")
    points = points.where(F.size("vector") == d)
    asked = written(_points(queries, vec_id, vector).where(F.size("vector") == d), "asked")
    # of equal vectors, only the smallest ids can be among the k nearest
    digest = F.xxhash64("vector")
    place = F.row_number().over(Window.partitionBy("h", "vector").orderBy("vec_id"))
    few = points.withColumn("h", digest).withColumn("place", place).where(F.col("place") <= k + 1)
    nodes = written(few.groupBy("h", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "vector"), "nodes")
    if not asked.head(1) or not nodes.head(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = _fit(nodes, asked, d, k, tables, recall, sample, tries, bucket, cell, seed)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(index.buckets(_matrix(batch.column("vector"), d)).ravel())], ["key"])

    n = nodes.count()
    most = max(cell, n // 4096)
    counts = nodes.select("vector").mapInArrow(bucketed, "key long").groupBy("key").count().where(F.col("count") > most)
    large = counts.orderBy("key").toPandas()  # at most 4096 for each table
    index = replace(index, large=large["key"].to_numpy(np.int64), pieces=-(-large["count"].to_numpy(np.int64) // most))
    held = spark.sparkContext.broadcast(index)
    kind = nodes.schema["vector"].dataType.simpleString()
    schema = f"cell long, kind int, key long, id long, ids array<long>, keys array<long>, vector {kind}"

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                node, of = part.column("node").to_numpy(), index.buckets(_matrix(part.column("vector"), d))
                for t in range(of.shape[1]):
                    key = index.piece(of[:, t], node)
                    none = pa.nulls(len(node), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(index.cell(key)), pa.array(np.zeros(len(node), np.int32)), pa.array(key), part.column("node"), part.column("ids"), none, part.column("vector")], ["cell", "kind", "key", "id", "ids", "keys", "vector"])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            step = max(1, 100_000 // index.visits)
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                order = index.visited(_matrix(part.column("vector"), d))
                key, of = index.all_pieces(order.ravel())
                query, cell_of = of // (order.shape[1] * order.shape[2]), index.cell(key)
                at = np.lexsort((key, cell_of, query))
                key, query, cell_of = key[at], query[at], cell_of[at]
                first = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (cell_of[1:] != cell_of[:-1])))
                ends = np.append(first, len(key)).astype(np.int32)
                m = len(first)
                own = pa.array(query[first])
                none = pa.nulls(m, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell_of[first]), pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), part.column("vec_id").take(own), none, pa.ListArray.from_arrays(pa.array(ends), pa.array(key)), part.column("vector").take(own)],
                    ["cell", "kind", "key", "id", "ids", "keys", "vector"],
                )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, index = None, [], None
        for batch in batches:
            both = np.stack([batch.column("cell").to_numpy(), batch.column("kind").to_numpy().astype(np.int64)])
            cuts = [0, *(np.flatnonzero((both[:, 1:] != both[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if both[0, a] != at:
                    at, parts, index = both[0, a], [], None
                if not both[1, a]:
                    parts.append(batch.slice(a, b - a))
                    continue
                if not parts:
                    continue
                if index is None:
                    rows = pa.Table.from_batches(parts).combine_chunks()
                    key, first = np.unique(rows["key"].to_numpy(), return_index=True)
                    index = key, np.append(first, rows.num_rows), _matrix(rows["vector"].combine_chunks(), d), rows["id"].to_numpy(), _lists(rows["ids"].combine_chunks())
                for c in range(a, b, 2048):
                    yield from _compared(batch.slice(c, min(2048, b - c)), *index, d, k)

    every = nodes.mapInArrow(stored, schema).unionByName(asked.mapInArrow(asking, schema))
    found = every.repartition("cell").sortWithinPartitions("cell", "kind", "key").mapInArrow(searched, f"query_id long, found {FOUND}")
    got = written(_merged(found, k, tables), "found")
    # queries that found too few are compared with all rows
    wanted = min(k, points.count() - 1)
    short = asked.join(got.where(F.size("found") >= wanted).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    whole = []
    for ids, x in _blocks(short, block, d):
        whole.append(written(_by_comparing(nodes, ids, x, k), "compared"))
    if whole:
        got = got.where(F.size("found") >= wanted)
        for part in whole:
            got = got.unionByName(part)
    return got.select("query_id", F.posexplode("found")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.minus") + F.lit(0.0)).alias("score"))


def _compared(asked: pa.RecordBatch, key: np.ndarray, ends: np.ndarray, points: np.ndarray, nodes: np.ndarray, ids: tuple[np.ndarray, np.ndarray], d: int, k: int) -> Iterator[pa.RecordBatch]:
    """The nearest among what the queries visit in a cell: points are sorted by bucket ``key``, cut at ``ends``."""
    x = _matrix(asked.column("vector"), d)
    best = _Best(asked.column("id").to_numpy(), x, k)
    wanted, cut = _lists(asked.column("keys"))
    query = np.repeat(np.arange(len(x)), np.diff(cut))
    there = A.member(wanted, key)
    bucket, query = np.searchsorted(key, wanted[there]), query[there]
    size = np.diff(ends)
    at = np.searchsorted(query, np.arange(len(x) + 1))
    step = max(1, (1 << 21) // len(points))
    for c in range(0, len(x), step):  # bounds the products
        own = slice(at[c], at[min(c + step, len(x))])
        n = min(step, len(x) - c)
        if size[bucket[own]].sum() * 8 > n * len(points):  # most of the cell: all products at once
            visited = np.zeros((n, len(key)), bool)
            visited[query[own] - c, bucket[own]] = True
            product = x[c : c + n] @ points.T
            product[~np.repeat(visited, size, axis=1)] = -np.inf
            i, j = _near(product, k + 1)
            seen = product[i, j] > -np.inf
            best.add(i[seen] + c, j[seen], points, nodes, *ids)
            continue
        order = np.argsort(bucket[own], kind="stable")
        by, of = bucket[own][order], query[own][order]
        first = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for a, b in zip(first, np.append(first, len(by))[1:], strict=True):
            low, high = ends[by[a]], ends[by[a] + 1]
            i, j = _near(x[of[a:b]] @ points[low:high].T, k + 1)
            pairs.append((of[a:b][i], low + j))
            held += len(i)
            if held > 1 << 18 or b == len(by):
                best.add(*(np.concatenate(p) for p in zip(*pairs, strict=True)), points, nodes, *ids)
                pairs, held = [], 0
    yield from best.rows()


def _blocks(rows: DataFrame, block: int, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bounded blocks of (ids, vectors), one at a time."""
    held: list = []
    for row in rows.orderBy("vec_id").toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield np.array([r["vec_id"] for r in held], np.int64), np.array([r["vector"] for r in held], np.float64).reshape(-1, d)
            held = []
    if held:
        yield np.array([r["vec_id"] for r in held], np.int64), np.array([r["vector"] for r in held], np.float64).reshape(-1, d)
