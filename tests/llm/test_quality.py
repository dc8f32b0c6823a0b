"""Rules, classifier and url filter: counts by brute force, models by held-out rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from counterloom.llm import quality_model, quality_rules, url_filter
from counterloom.llm.queries import URL_RULES, held_out

from .conftest import ODD, table, words


def judged_rows(n=400):
    """Clean texts with label 1, shouted or symbol-ridden ones with label 0."""
    r, docs, labels = random.Random(3), [], []
    for i in range(n):
        text = words(r.randrange(20, 80), i)
        bad = r.random() < 0.2
        if bad:
            text = " ".join(f"{w.upper()}!!" if i % 2 else f"{w}{r.choice(['###', '$$$', '&&&'])}" for w in text.split(" "))
        docs.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def rule_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeat = [False] * len(w)
    for k in range(len(w) - 4):
        if seen[tuple(w[k : k + 5])] > 1:
            repeat[k : k + 5] = [True] * 5
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(repeat)


def test_rules_count_and_the_forest_keeps_clean_documents(spark):
    docs, labels = judged_rows()
    odd = [*ODD, (700, "a b c d e a b c d e\n#x é\n#x é\n\n"), (701, "one two three four five six seven eight nine ten eleven")]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_rules.judge(table(spark, docs + odd), frame).collect()
    assert len(got) == len(docs) + len(odd)
    texts = dict(docs + odd)
    for r in got:
        assert tuple(r[c] for c in quality_rules.COUNTS) == rule_counts(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    good = dict((i, q) for i, q, _ in labels)
    kept = {r["doc_id"]: r["kept"] for r in got if r["doc_id"] in good}
    assert np.mean([kept[i] for i, q in good.items() if q == 1]) > 0.97
    assert np.mean([kept[i] for i, q in good.items() if q == 0]) < 0.35


def test_rules_without_labels_or_rows(spark):
    docs, labels = judged_rows(30)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_rules.judge(table(spark, docs), frame.limit(0)).collect()
    assert all(r["kept"] for r in got if not r["base_failed"])
    assert quality_rules.judge(table(spark, docs).limit(0), frame).count() == 0


def test_samples_are_bounded_on_null_and_repeated_ids(spark):
    # a third without id, a third of one id, the rest with an id each
    stats = spark.range(3000).selectExpr("case id % 3 when 0 then null when 1 then 7L else id + 100 end as doc_id", *(f"pmod(xxhash64(id), 9973) / {i + 1}D as {f}" for i, f in enumerate(quality_rules.FEATURES)))
    rows = quality_rules.sample_rows(stats, 300)
    assert 200 < len(rows) <= 300
    chosen = spark.createDataFrame([tuple(map(float, r)) for r in rows], list(quality_rules.FEATURES)).join(stats, list(quality_rules.FEATURES)).toPandas()["doc_id"]
    assert 0.2 < chosen.isna().mean() < 0.47 and 0.2 < (chosen == 7).mean() < 0.47
    features = stats.select("doc_id", F.array(F.col("stop_share").cast("float")).alias("pooled"))
    known = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as label").where("doc_id = 7 or doc_id >= 100")
    assert quality_model.labelled_sample(features, known, 5000).count() == 1001
    assert 200 < quality_model.labelled_sample(features, known, 300).count() <= 300


def test_every_word_has_a_vector_of_its_own(spark):
    texts = [words(300, i, 6000) for i in range(40)] + ["", None, "one", "often seldom " * 700]
    docs = table(spark, list(enumerate(texts)))
    split = [re.findall(r"[A-Za-z]+|[0-9]+", t or "") for t in texts]
    vectors = quality_model.word_vectors(docs)
    held = vectors.sums.toArrow()
    got = dict(zip(held["word"].to_pylist(), quality_model.context_vectors(held["sums"], vectors.common), strict=True))

    vocabulary = sorted({w for t in split for w in t})
    assert len(got) == len(vocabulary) > 2048
    hashes = dict(zip(vocabulary, quality_model._tokens(pa.array(vocabulary))[0], strict=True))
    index = dict(zip(vocabulary, quality_model.index_vectors(np.array([hashes[w] for w in vocabulary], np.uint64), 24, 11), strict=True))
    near = {w: np.zeros(24) for w in vocabulary}
    for t in split:
        for i, w in enumerate(t):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(t):
                    near[w] += index[t[j]]
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    want = unit(np.array([near[w] for w in vocabulary]))
    want = dict(zip(vocabulary, unit(want - want.mean(0)), strict=True))
    assert max(np.abs(want[w] - got[int(hashes[w].view(np.int64))]).max() for w in vocabulary) < 1e-4
    for size in (32 << 20, 2000):
        rows = {r["doc_id"]: np.array(r["pooled"]) for r in quality_model.pooled(docs, vectors, group_bytes=size).collect()}
        assert set(rows) == set(range(len(texts)))
        for i, t in enumerate(split):
            v = np.array([want[w] for w in t]) if t else np.zeros((1, 24))
            assert np.abs(rows[i][:24] - v.mean(0)).max() < 1e-3 and np.abs(rows[i][24:48] - v.std(0)).max() < 0.02
            assert abs(rows[i][48] - np.log1p(len(t))) < 1e-5


def test_shuffled_values_are_small_and_come_back():
    rng = np.random.default_rng(2)
    sums = rng.binomial(16, 0.5, (4000, 24)) // 2 - 4
    sums[::50] *= 30
    sums[::400] *= 10**9
    packed = quality_model._packed(sums)
    assert (quality_model._unpacked(packed, 24) == sums).all() and quality_model._unpacked(packed[:0], 24).shape == (0, 24)
    assert quality_model._packed(sums[1:50]).nbytes < 49 * 20  # half a byte each and the offset
    words = [(sorted(rng.choice(29_999, n, replace=False).tolist()), rng.integers(1, 3, n)) for n in (1, 15_000, 1, 2, 700)] + [([0, 29_998], np.array([70_000_000, 256]))]
    doc, count = (np.concatenate(x).astype(np.int64) for x in zip(*words))
    first = np.cumsum([0, *(len(d) for d, _ in words[:-1])])
    raw, ends = quality_model._entries(doc, count, first)
    held = quality_model._binary(raw, ends)
    for column in (held, quality_model._split(quality_model._joined(held, held))[1]):
        of, got, times = quality_model._entries_of(column)
        assert (got == doc).all() and (times == count).all() and (of == np.repeat(np.arange(6), [len(d) for d, _ in words])).all()
    assert len(quality_model._entries_of(held[:0])[0]) == 0
    ones = quality_model._entries(np.arange(9000), np.ones(9000, np.int64), np.zeros(1, np.int64))[0]
    assert len(ones) == 9000  # three bytes each before
    assert len(quality_model._joined(packed, packed)) < packed.nbytes


def test_path_lengths_mark_the_outlier():
    rows = np.random.default_rng(1).normal(0, 1, (300, 3))
    rows[7] = 30
    scores = quality_rules.path_scores(quality_rules.fit_forest(rows), rows)
    assert scores.argmax() == 7 and scores[7] > 0.7 > np.median(scores) + 0.1


def test_classifier_separates_held_out_rows(spark):
    docs, labels = judged_rows()
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_model.quality_scores(table(spark, docs + ODD + [docs[0]]), frame.where(~held_out())).toPandas()
    assert len(got) == len(docs) + len(ODD) + 1 and got["score"].between(0, 1).all()
    assert got[got["doc_id"] == docs[0][0]]["score"].nunique() == 1
    out = {r[0] for r in frame.where(held_out()).select("doc_id").collect()}
    good = {i: q for i, q, _ in labels if i in out}
    score = dict(zip(got["doc_id"], got["score"], strict=True))
    one, none = ([score[i] for i, q in good.items() if q == k] for k in (1, 0))
    assert np.mean([a > b for a in one for b in none]) > 0.95


@pytest.mark.parametrize("kept", [[], [1]])
def test_classifier_without_both_labels(spark, kept):
    docs = table(spark, [(1, "some text"), (2, None)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").where(F.col("quality").isin(kept) if kept else F.lit(False))
    scores = [r["score"] for r in quality_model.quality_scores(docs, labels).collect()]
    assert len(scores) == 2 and len(set(scores)) == 1 and (scores[0] > 0.5 if kept else scores[0] == 0.5)
    assert quality_model.quality_scores(docs.limit(0), labels).count() == 0


def test_temperature_and_layers_learn_a_rule():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (2000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(2000) < 0.1)).astype(int)
    net = quality_model.fit_network(x, y, epochs=300, rate=1e-2)
    p = net.probabilities(x)
    assert np.mean((p > 0.5) == y) > 0.8 and abs(p.mean() - y.mean()) < 0.05


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_rules_judge_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://X.EXAMPLE.org/es/1", "https://example.org/en/1?x=/a", "http://notexample.org/en/1", "http://a.com/fr/", "http://a.com/fr",
            "ftp://b.de.com/de/#f", "http://c.net/en/7?u=http://org/", "http://org/x", "http://é.ORG", "HTTP://É.org/", "x://y://z/q", "http://h.net/" + "a/1" * 5000, "http://example.org?es/", "http://a.com/fr/"]
    rows = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)] + [(3, "http://", "h", "x")], "page_id long, url string, html string, rule string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(urls))], "page_id long, label int")
    got = url_filter.judge(rows, URL_RULES, labels).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = host_and_path(urls[r["page_id"]])
        fits = [x for x in URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best.name), urls[r["page_id"]]
        assert r["verdict"] == (best.verdict if best else r["verdict"]) and r["verdict"] in ("allow", "block")
    none = url_filter.judge(rows, URL_RULES, labels.limit(0)).collect()
    assert {r["verdict"] for r in none if r["rule"] is None} == {"allow"}
    assert url_filter.judge(rows.limit(0), URL_RULES, labels).count() == 0


def test_trees_learn_lexical_features(spark):
    r = random.Random(8)
    rows = []
    for i in range(600):
        bad = r.random() < 0.4
        host = f"{'cheap-win-' * r.randrange(1, 3)}{r.randrange(10**6)}.net" if bad else f"{r.choice(['alpha', 'beta', 'gamma'])}.net"
        rows.append((i, f"http://{host}/{'x/' * r.randrange(4)}{r.randrange(99)}{'?a=1&b=2&c=3' if bad and r.random() < 0.7 else ''}", int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = url_filter.judge(df.drop("label"), [], df.where("page_id % 3 <> 0").select("page_id", "label")).collect()
    truth = {i: b for i, _, b in rows}
    assert np.mean([(x["verdict"] == "block") == bool(truth[x["page_id"]]) for x in got if x["page_id"] % 3 == 0]) > 0.9
