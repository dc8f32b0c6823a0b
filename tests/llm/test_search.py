"""Nearest vectors, vector codes and ranked search against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from counterloom.llm import arrays as A
from counterloom.llm import multiprobe, part_codes, ranked_search
from counterloom.llm import queries as Q

from .conftest import CLASHES, ODD, table, words

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("extra") for c in (*(c for c in CLASHES if c != "label"), "vector", "cell", "ids", "found", "rank", "position", "part", "same", "error", "minus", "query_id")})


def usable(rows, zero):
    return [(i, [np.float32(v) for v in x], g) for i, x, g in rows if x is not None and all(v is not None and math.isfinite(v) for v in x) and (zero or any(x))]


def cloud(n, d=16, seed=1, first=0, spread=1.0):
    r = np.random.default_rng(seed)
    mean = r.normal(size=d) * (3 if spread < 1 else 0)
    return [(first + i, [float(np.float32(v)) for v in mean + spread * r.normal(size=d)], i % 4 if i % 5 else None) for i in range(n)]


#: Null, zero, null and non-finite components, another length, no components.
BAD = [(9000, None, 1), (9020, [0.0] * 16, 1), (9040, [None] + [1.0] * 15, 1), (9060, [float("nan")] + [1.0] * 15, 2), (9080, [float("inf")] + [1.0] * 15, 2), (9100, [1.0] * 7, 2), (9120, [], 2)]


def nearest(rows, k):
    """Of usable rows, those of one length and with an id."""
    own = [(i, np.array(x, np.float64)) for i, x, _ in usable(rows, False) if i is not None and len(x) == 16]
    out = {}
    for i, x in own:
        if i % 20 == 0:
            near = sorted((-float(sum(a * b for a, b in zip(x, y, strict=True))), j) for j, y in own if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_nearest_recall_and_exact_scores(spark):
    # a third of all rows are near copies of one vector, some are equal
    rows = cloud(1500) + cloud(700, first=2000, seed=2, spread=0.01) + [(4000 + i, [5.0] * 16, 0) for i in range(60)] + BAD + [(None, [1.0] * 16, 0)]
    df = vectors(spark, rows)
    got, want = found(multiprobe.nearest(df, df.where("vec_id % 20 = 0"), tries=64)), nearest(rows, 20)
    assert got.keys() == want.keys()
    hits = [len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]
    assert np.mean(hits) >= 0.9
    exact = {i: np.array(x, np.float64) for i, x, _ in usable(rows, False) if i is not None}
    for i, near in got.items():
        assert len(near) == 20 and i not in {j for j, _ in near}
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(s == sum(a * b for a, b in zip(exact[i], exact[j], strict=True)) for j, s in near)
    for i in range(4000, 4060, 20):  # copies: the smallest ids
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]


def test_nearest_large_buckets_and_few_rows(spark):
    rows = cloud(900, spread=0.001)
    df = vectors(spark, rows)
    got, want = found(multiprobe.nearest(df, df.where("vec_id % 20 = 0"), k=5, cell=64, bucket=16)), nearest(rows, 5)
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 5 for i in want]) >= 0.9
    few = cloud(6)
    df = vectors(spark, few + few + BAD)  # repeated rows count once
    assert found(multiprobe.nearest(df, df.where("vec_id % 20 = 0"))) == nearest(few, 20)
    for empty in (vectors(spark, []), vectors(spark, BAD)):
        assert multiprobe.nearest(empty, empty).collect() == []
    one = vectors(spark, cloud(1))
    assert multiprobe.nearest(one, one).collect() == []


def test_visits_follow_estimated_success():
    r = np.random.default_rng(0)
    index = multiprobe.Index(r.normal(size=(9, 2, 3)), r.random((2, 3)), r.integers(1, 1 << 60, (2, 3), np.uint64), 2.0, 1.0, 1.0, visits=125)
    x = r.normal(size=(4, 8))
    order = index.visited(x)
    assert order.shape == (4, 2, 125) and all(len(set(o)) == 125 for q in order.tolist() for o in q)
    own = multiprobe._number((np.floor(index.places(x, True)).astype(np.int64).view(np.uint64) * index.factor).sum(2))
    few = multiprobe.replace(index, visits=20).visited(x)
    assert np.array_equal(few, order[..., :20])
    assert all(own[q, t] in order[q, t, :30] for q in range(4) for t in range(2))


def coded(rows):
    own = [(i, x, g) for i, x, g in usable(rows, True) if len(x) == 16]
    own = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(256 * float(v)) for v in r[1]] for r in own]).reshape(len(own), 16, 1)
    books = [x[:64, p].copy() for p in range(16)]

    def assigned():
        apart = [((x[:, p][:, None] - books[p][None]) ** 2).sum(2) for p in range(16)]
        return np.stack([a.argmin(1) for a in apart], 1), sum(a.min(1) for a in apart)

    for _ in range(2):
        code, _ = assigned()
        for p in range(16):
            for e in range(len(books[p])):
                if (m := code[:, p] == e).any():
                    books[p][e] = x[m, p].sum(0) // m.sum()
    code, error = assigned()
    total = Counter()
    for (_, _, g), e in zip(own, error, strict=True):
        total[g] += int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c:02x}" for c in row), int(e), total[g], digest) for (i, _, g), row, e in zip(own, code, error, strict=True))


@pytest.mark.parametrize("rows", [cloud(300) + BAD + [(None, [0.25] * 16, None)], cloud(200, spread=0.02) + [(500 + i % 9, [0.5, -0.5] * 8, None) for i in range(300)], cloud(5), []])
def test_codes_equal_brute_force(spark, rows):
    got = part_codes.encode(vectors(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == (coded(rows) if rows else [])


def test_walk_shares_prefixes():
    r = np.random.default_rng(4)
    parts = r.integers(-3, 3, (9000, 4))
    own, number = part_codes.distinct(parts)
    assert np.array_equal(own[number], parts) and own.tolist() == sorted({tuple(p) for p in parts.tolist()}, key=list) or own.tolist() == [list(p) for p in sorted({tuple(p) for p in parts.tolist()})]
    entries = r.integers(-3, 3, (64, 4))
    code, error = part_codes.walk(own, entries)
    apart = ((own[:, None] - entries[None]) ** 2).sum(2)
    assert np.array_equal(code, apart.argmin(1)) and np.array_equal(error, apart.min(1))
    assert np.array_equal(part_codes.decoded(part_codes.encoded(own), 4), own)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ranks(docs, items, k=50):
    held = [(i, c) for i, t in docs if (c := Counter(TERM.findall((t or "").translate(LOWER))))]
    size, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * size) // length
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
            scores += [(-score, i is None, i or 0)] * (score > 0)
        out += [(item, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def search(spark, docs, items, **options):
    df = ranked_search.ranked(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_ranks_equal_brute_force(spark):
    docs = [(i, words(30 + i % 50, i, 300)) for i in range(400)] + [(1000 + i, words(60, 77)) for i in range(200)] + ODD
    docs += [(2000, "Ärger ÄRGER ärger straße İstanbul ΑΒΓ αβγ word-with-parts x1 X1"), (2001, "w1x " * 400), (2002, "w1x " * 254 + "w2y"), (2000, "w3z w4x")]
    items = [(i, words(25, 500 + i, 300)) for i in range(12)] + [(20, words(60, 77)), (21, "ärger straße X1 nowhere"), (22, ""), (23, None), (24, "!!!"), (25, "w1x w2y"), (20, words(60, 77)), (None, "w1x")]
    want = ranks(docs, [x for n, x in enumerate(items) if x not in items[:n]])
    assert search(spark, docs, items) == want
    assert search(spark, docs, items, block_items=3, ahead=5) == want  # the same from several blocks
    assert [r for r in search(spark, docs, items, k=3)] == ranks(docs, [x for n, x in enumerate(items) if x not in items[:n]], 3)


def test_ranks_of_nothing(spark):
    assert search(spark, [], [(1, "w1x")]) == search(spark, [(1, "w1x"), (2, None)], []) == search(spark, [(1, "..."), (2, None)], [(1, "w1x")]) == []


def test_bounds_are_never_below_scores(spark):
    docs = [(i, words(20 + i, i, 200)) for i in range(60)]
    import pyarrow as pa

    texts = pa.array([t for _, t in docs])
    index = ranked_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"), spread=2)  # many shared coordinates
    sketches = index.where("kind = 0").orderBy("key")
    keys = {r["key"]: r["doc_id"] for r in spark.createDataFrame(docs, "doc_id long, text string").select(ranked_search._key().alias("key"), "doc_id").collect()}
    rows = [spark.createDataFrame([(0, words(30, 9, 200))], "item_id long, text string").first()]
    block = ranked_search._weighed(index, rows, 60, sketches.agg({"n": "sum"}).first()[0])
    scores = block.scores(texts)[:, 0]
    for batch in sketches.toArrow().to_batches():
        for key, bound in ranked_search._sketch_bounds(batch, block):
            assert all(b >= scores[keys[k]] for k, b in zip(key.tolist(), bound[:, 0], strict=True))


def test_word_hashes_see_every_byte():
    """Thue-Morse strings and their complements, on which polynomials over 2**64 collide."""
    tm = [0]
    while len(tm) < 4096:
        tm += [1 - b for b in tm]
    texts = [bytes((97 + b if not flip else 98 - b) for b in tm[:n]) for n in (64, 512, 1024, 2048, 4096) for flip in (0, 1)]
    texts += [b"a" * n for n in (1, 7, 8, 9, 15, 16, 17, 511, 512, 513)] + [b"a" * 8 + b"\0", b"a\0"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    start = ends - [len(t) for t in texts]
    assert len(set(A.word_hashes(data, start, ends).tolist())) == len(texts)
    again = np.frombuffer(b"xyz".join([b"", *texts, b""]), np.uint8)
    at = start + 3 * np.arange(1, len(texts) + 1)
    assert np.array_equal(A.word_hashes(again, at, at + (ends - start)), A.word_hashes(data, start, ends))


def test_search_queries_have_sql():
    assert {"op12_part_codes", "op13_ranked_search"} <= set(Q.ORACLE)
