"""Both removals of repeated spans and the similarity join against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from counterloom.llm import chosen_path, suffix_dedup, word_graph
from counterloom.llm.components import connected_components

from .conftest import ODD, table, words


def corpus(seed, n=60):
    """Copies, near copies, shared passages and repeats within a document."""
    r, out = random.Random(seed), []
    passages = [words(r.randrange(12, 60), 1000 + k) for k in range(5)]
    for i in range(n):
        kind = r.randrange(6)
        text = words(r.randrange(5, 90), seed * 100 + i)
        if kind == 0 and out:
            text = out[r.randrange(len(out))][1]
        elif kind == 1 and out:
            w = out[r.randrange(len(out))][1].split(" ")
            w[r.randrange(len(w))] = "edit"
            text = " ".join(w)
        elif kind == 2:
            text = f"{text} {r.choice(passages)}\n{words(9, i)}"
        elif kind == 3:
            text = f"{r.choice(passages)} {text} {r.choice(passages)}"
        elif kind == 4:
            text = "same " * r.randrange(10, 70) + "é"
        out.append((i, text))
    r.shuffle(out)
    return out


def bytes_left(rows, length=50):
    seen, out = {}, {}
    for i, text in sorted({r for r in rows if r[0] is not None}, key=lambda x: x[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen.setdefault(b[k : k + length], i) < i:
                gone[k : k + length] = True
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def words_left(rows, length=20):
    seen, out = set(), {}
    for i, text in sorted({r for r in rows if r[0] is not None}, key=lambda x: x[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if key in seen:
                gone[k : k + length] = [True] * length
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_equals_brute_force(spark, hot):
    rows = corpus(1) + ODD
    rows += [rows[3], rows[3], (500, rows[0][1])]
    got = suffix_dedup.remove_repeated_substrings(table(spark, rows), hot=hot, part_bytes=4000).collect()
    assert len(got) == len(rows)
    want = bytes_left(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got if r["doc_id"] is not None} == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got if r["kept"] is not None)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_word_graph_equals_brute_force(spark, hot):
    rows = corpus(2) + ODD
    rows += [rows[3], (500, rows[0][1])]
    got = word_graph.remove_repeated_spans(table(spark, rows), hot=hot, part_edges=500).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] is not None} == words_left(rows)


def test_removals_of_empty_tables(spark):
    empty = table(spark, [(1, "x")]).limit(0)
    assert suffix_dedup.remove_repeated_substrings(empty).count() == 0
    assert word_graph.remove_repeated_spans(empty).count() == 0
    assert chosen_path.similar_documents(empty).count() == 0


def test_transform_derives_common_prefixes_by_increasing_value():
    r = random.Random(4)
    for _ in range(20):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(6, 30))) for _ in range(6)]
        nodes = np.array([r.randrange(4) for _ in strings])
        string, place, found = suffix_dedup.earliest_documents(strings, nodes, 6)
        for s, p, f in zip(string, place, found, strict=True):
            key = strings[s][p : p + 6]
            assert f == min(n for t, n in zip(strings, nodes, strict=True) if key in t)


def test_transform_sorts_again_only_what_is_tied(monkeypatch):
    r, sorted_rows, sort = random.Random(5), [], np.argsort
    strings = [bytes(r.choice(b"abcdefgh ") for _ in range(70)) for _ in range(300)]
    strings += strings[:20]
    monkeypatch.setattr(np, "argsort", lambda key, **kw: sorted_rows.append(len(key)) or sort(key, **kw))
    suffix_dedup.earliest_documents(strings, np.arange(len(strings)), 50)
    n = sum(len(s) + 1 for s in strings)
    assert n <= sum(sorted_rows) < 2 * n


def test_blocks_of_whole_anchors_give_what_one_transform_gives():
    r = random.Random(6)
    codes = np.sort(np.array([r.randrange(40) for _ in range(200)]))
    strings = [b"".join(r.choice((b"ab", b"ba", b"c")) for _ in range(r.randrange(6, 20))) + b"%02d" % c * 4 for c in codes]
    sizes, nodes = np.array([len(s) for s in strings]), np.array([r.randrange(50) for _ in strings])
    cuts = suffix_dedup.anchor_blocks(codes, sizes, 300)
    assert cuts[0] == 0 and cuts[-1] == len(strings) and len(cuts) > 10
    assert all(codes[c - 1] != codes[c] for c in cuts[1:-1])
    largest = max(int(sizes[codes == c].sum()) for c in codes)
    assert all(sizes[a:b].sum() <= 300 + largest for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    for c in range(40):  # within an anchor, alone or with others of its block
        at = np.flatnonzero(codes == c)
        block = max(x for x in cuts if x <= at[0])
        end = min(x for x in cuts if x > at[0])
        assert at[-1] < end
        together = [x for x in zip(*suffix_dedup.earliest_documents(strings[block:end], nodes[block:end], 12), strict=True)]
        for string, place, found in together:
            key = strings[block + string][place : place + 12]
            assert found == min(nodes[i] for i in range(block, end) if key in strings[i])
    assert suffix_dedup.anchor_blocks(codes[:1], sizes[:1], 300) == [0, 1]


def test_strings_are_the_runs_of_windows_with_wanted_anchors():
    texts = pa.array([words(60, 1), "short", words(90, 1)[40:], "", "same " * 30])
    doc, hashes = suffix_dedup._anchors(texts, 50)
    take = [[int(h >> np.uint64(32)) for h in hashes[doc == i]][::2] for i in range(len(texts))]
    codes = pa.array([np.array(c, np.uint32).view(np.int32).tolist() for c in take], pa.list_(pa.int32()))
    got = {(d, s, n) for d, s, n in zip(*(x.tolist() for x in suffix_dedup.anchored_strings(texts, 50, codes)[:3]), strict=True)}
    want = set()
    for i, text in enumerate(texts.to_pylist()):
        data = np.frombuffer(text.encode(), np.uint8)
        grams = suffix_dedup._grams(data)[1]
        least = [int(grams[k : k + 31].min()) for k in range(len(data) - 49)]
        start = 0
        for k in range(1, len(least) + 1):
            if k == len(least) or least[k] != least[start]:
                if least[start] >> 32 in take[i]:
                    want.add((i, start, k - start + 49))
                start = k
    assert got == want and len(got) > 5


def near(rows, similarity=0.8, n=5):
    """Links and class of each id among documents with words."""
    first = {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}):
        first.setdefault(t, i)
    sets = {}
    for t, i in first.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {i: (root[first[t or ""]], links[first[t or ""]]) for i, t in rows if i is not None}


@pytest.mark.parametrize("limit, block", [(4096, 2048), (4, 5)])
def test_similarity_join_equals_brute_force(spark, limit, block):
    rows = corpus(3, 80) + ODD
    base = words(60, 9).split(" ")
    for k in range(40):  # a group of near copies, larger than a bucket and than a block
        w = list(base)
        w[k % 60] = f"v{k}"
        rows.append((600 + k, " ".join(w)))
    rows += [rows[3], (500, rows[0][1])]
    got = chosen_path.similar_documents(table(spark, rows), limit=limit, block=block).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got if r["doc_id"] is not None} == near(rows)
    assert [(r["class_id"], r["n_links"]) for r in got if r["doc_id"] is None] == [(None, 0)]


def test_runs_reach_the_recall():
    assert chosen_path.runs_for(0.9999, 0.8, 1.25) == 10


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in (1, 2, 3, 7, 8, 9)} == {1} and got[21] == 20 and got[140] == 100
