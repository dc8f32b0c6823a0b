"""Packing of tokenized documents into windows by Karmarkar-Karp differencing.

A document's tokens are cut into full windows, which stand alone, and a rest. The rests of a few hundred documents at a time are
dealt to windows by multiway differencing: every rest starts as a partition of its own; again and again the two partitions of
largest imbalance are merged, the fullest windows of one with the emptiest of the other, which leaves near-equal windows.
If the fullest exceeds the capacity, the number of windows rises by one and differencing starts anew.

Each task packs the rows it reads, so nothing is shuffled and no group grows with the data. A sequence id is made of the
task's partition and a counter: the same input splits give the same ids. Null texts are empty documents, of one token.
Repeated rows are packed each for itself. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

#: White space beyond ASCII: a text with any of it is tokenized as a whole.
WIDE_SPACE = "[" + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x1C, 0x20)))) + "]"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CachedTokenizer:
    """Token ids of whole texts, with each distinct stretch of white space and word tokenized once.

    The tokenizer's pattern always cuts where white space follows something else, so the ids of a text are those of its
    stretches. Stretches are told apart by 64-bit hashes; the cache starts afresh when it holds ``limit`` of them.
    """

    def __init__(self, path: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        size = max([*model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))]) + 1
        self.id_bytes = np.zeros(size, np.int64)
        for token, i in model["model"]["vocab"].items():
            self.id_bytes[i] = len(token)  # one character stands for one byte
        for t in model.get("added_tokens", []):
            self.id_bytes[t["id"]] = len(t["content"].encode())
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat, self.start, self.length, self.used = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int64), np.zeros(1 << 20, np.int64), 0

    def _store(self, keys: list[int], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        first = len(self.slots)
        while first + len(keys) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first : first + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(keys)] = lengths
        self.slots.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.used += len(ids)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[int], stretches: list[bytes]) -> None:
        """Tokenize new stretches. Those that begin with white space and end with a word are joined for speed; the ids' byte
        lengths tell where each ends."""
        solid = [bool(s) and A.SPACE[s[0]] and not A.SPACE[s[-1]] for s in stretches]
        alone = [(k, s) for k, s, j in zip(keys, stretches, solid, strict=True) if not j]
        joined = [(k, s) for k, s, j in zip(keys, stretches, solid, strict=True) if j]
        for at in range(0, len(joined), 4096):
            part = joined[at : at + 4096]
            ids = self._encode([b"".join(s for _, s in part).decode()])[0]
            ends, wanted = np.cumsum(self.id_bytes[ids]), np.cumsum([len(s) for _, s in part])
            cut = np.searchsorted(ends, wanted)
            if len(ends) and np.array_equal(ends[np.minimum(cut, len(ends) - 1)], wanted):
                self._store([k for k, _ in part], ids, np.diff(cut + 1, prepend=0))
            else:
                alone += part
        if alone:
            found = self._encode([s.decode() for _, s in alone])
            self._store([k for k, _ in alone], np.concatenate(found), np.array([len(x) for x in found]))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their document offsets."""
        texts = pc.fill_null(texts, "")
        wide = pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)
        data, offsets = A.text_bytes(pc.if_else(pa.array(wide), "", texts))
        space = A.SPACE[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data)) if len(start) else start
        hashes = A.word_hashes(data, start, end)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slots) + len(keys) > self.limit:
            self._clear()
        known = keys.tolist()
        new = [i for i, k in enumerate(known) if k not in self.slots]
        if new:
            raw = data.tobytes()
            self._learn([known[i] for i in new], [raw[start[j] : end[j]] for j in first[new]])
        slot = np.array([self.slots[k] for k in known], np.int64)[inverse]
        n = self.length[slot]
        at = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=at[1:])
        ids = self.flat[np.repeat(self.start[slot] - at[:-1], n) + np.arange(at[-1])]
        of = at[np.searchsorted(start, offsets)]
        if wide.any():
            parts = np.split(ids, of[1:-1])
            for i, found in zip(np.flatnonzero(wide), self._encode(texts.filter(pa.array(wide)).to_pylist()), strict=True):
                parts[i] = found
            ids, of = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, of


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> CachedTokenizer:
    """One per Python worker, whose next tasks find its cache filled."""
    return CachedTokenizer(path)


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Deal numbers to windows by Karmarkar-Karp; the indices that each window got.

    A partition is its window sums, fullest first and less the emptiest. Merges are kept as a tree; going down from the root
    gives each partition's windows their final numbers.
    """
    first = np.zeros((len(lengths), windows), np.int64)
    first[:, 0] = lengths
    heap = [(-n, i) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    sums, merges = list(first), []
    while len(heap) > 1:
        i, j = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[i] + sums[j][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        sums[i] = sums[j] = None
        heapq.heappush(heap, (-int(total[0]), len(sums)))
        sums.append(total)
        merges.append((i, j, order))
    place: dict[int, np.ndarray] = {len(sums) - 1: np.arange(windows)}
    for node in range(len(sums) - 1, len(lengths) - 1, -1):
        i, j, order = merges[node - len(lengths)]
        own = np.empty(windows, np.int64)
        own[order] = place.pop(node)
        place[i], place[j] = own, own[::-1]
    out: list[list[int]] = [[] for _ in range(windows)]
    for i in range(len(lengths)):
        out[place[i][0]].append(i)
    return out


def joined(lengths: list[int], limit: int) -> list[list[int]]:
    """Indices of items of up to ``limit``, made of the shortest first; a longer number stays alone."""
    out: list[list[int]] = []
    room = -1
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if lengths[i] > room:
            out.append([])
            room = limit
        out[-1].append(i)
        room -= lengths[i]
    return out


def balanced(lengths: list[int], capacity: int, piece: int = 512, most: int = 4096) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; one more window whenever differencing exceeds it.

    More than ``most`` numbers are joined to items of up to ``piece`` before, which bounds differencing's memory.
    """
    items = joined(lengths, min(piece, capacity)) if len(lengths) > most else [[i] for i in range(len(lengths))]
    sums = [sum(lengths[i] for i in item) for item in items]
    windows = max(1, -(-sum(sums) // capacity))
    while True:
        got = differencing(sums, windows)
        if max(sum(sums[i] for i in w) for w in got) <= capacity:
            return [[i for item in w for i in items[item]] for w in got if w]
        windows += 1


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1, group_tokens: int = 256 * 2048, piece: int = 512, group_rests: int = 1 << 16) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id``. Rests are cut into pieces of at most ``piece`` tokens, of which about four
    and more meet in a window, and gathered until they hold ``group_tokens`` or are ``group_rests``; then they are dealt out. ``tokenizer_path`` names the tokenizer's file, present on every executor.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        gathered = 0

        def dealt(rows: list[tuple]) -> list[tuple]:
            nonlocal sequence
            out = []
            for window in balanced([r[2] for r in rows], capacity, piece):
                offset = 0
                for i in window:
                    out.append((*rows[i], sequence, offset))
                    offset += rows[i][2]
                sequence += 1
            return out

        def table(rows: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

        for batch in A.slices(batches, "_text"):
            ids, offsets = encode(batch.column("_text"))
            out = []
            for key, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                own = np.append(ids[a:b], end_id).astype("<u4")
                full = len(own) // capacity * capacity
                for at in [*range(0, full, capacity), *range(full, len(own), piece)]:
                    part = own[at : at + (capacity if at < full else piece)]
                    row = (key, at, len(part), zlib.crc32(part.tobytes()), len(own))
                    if at < full:
                        out.append((*row, sequence, 0))
                        sequence += 1
                    else:
                        waiting.append(row)
                        gathered += len(part)
                if gathered >= group_tokens or len(waiting) >= group_rests:
                    out += dealt(waiting)
                    waiting, gathered = [], 0
            if out:
                yield table(out)
        if waiting:
            yield table(dealt(waiting))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(packed, SCHEMA)
