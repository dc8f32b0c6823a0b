"""Quality rules with an isolation forest on their statistics.

``rule_statistics`` counts what fixed rules look at; ``fit_forest`` grows random trees on a bounded sample; ``anomaly_scores``
turns path lengths into scores for every document; ``calibrate`` picks the score above which a document is rejected from all
labelled rows; ``judge`` puts them together.

Null and empty texts count 0 everywhere and fail the base rules. Repeated rows are judged alike. Without labelled rows of
both kinds nothing is rejected by score. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import hashed_sample, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios of the rule statistics, which do not follow a document's length; the forest splits on these.
FEATURES = ("symbol_share", "upper_share", "bar_share", "distinct_share", "dup_line_share", "repeat_share", "long_word_share", "stop_share")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LINE_END = 10


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = A.text_bytes(texts)
    n = len(texts)
    start, end, doc = A.words(data, offsets)
    of = A.doc_offsets(doc, n)
    n_words = np.diff(of)
    solid = ~A.SPACE[data]
    word = A.word_hashes(data, start, end)
    own = A.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))  # keeps documents apart within one sort

    first, window = A.windows(word, of, 5)
    again = A.repeated(window ^ own[doc[first]]) if len(first) else np.zeros(0, bool)
    repeat = A.covered(first[again], 5, len(word))

    line_start, line_end = A.spans(data != _LINE_END, offsets)
    has_word = np.searchsorted(start, line_end, "left") > np.searchsorted(start, line_start, "left")
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_doc = A.owners(offsets, line_start)
    line = A.word_hashes(data, line_start, line_end) ^ own[line_doc]
    order = np.lexsort((line, line_doc))
    same = np.zeros(len(order), bool)
    same[1:] = line[order][1:] == line[order][:-1]
    dup_lines = np.bincount(line_doc[order][same], minlength=n)

    key = np.lexsort((word, doc))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (word[key][1:] != word[key][:-1]) | (doc[key][1:] != doc[key][:-1])
    distinct = np.bincount(doc[key][fresh], minlength=n)

    length = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=length[1:])
    chars = length[end] - length[start]
    by_word = lambda x: np.bincount(doc[x], minlength=n)
    per_word = np.maximum(n_words, 1)
    letters = np.maximum(A.sums_by_doc(_LETTER[data], offsets), 1)
    counts = {
        "n_words": n_words,
        "word_chars": A.sums_by_doc(solid & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": A.sums_by_doc(_SYMBOL[data], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": A.sums_by_doc(repeat, of),
    }
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    ratios = {
        "symbol_share": counts["n_symbols"] / np.maximum(counts["word_chars"], 1),
        "upper_share": A.sums_by_doc(_UPPER[data], offsets) / letters,
        "bar_share": by_word((chars == 1) & (data[start] == ord("|"))) / per_word,
        # as many words as a text of the usual variety would have: words ** 0.85
        "distinct_share": distinct / per_word**0.85,
        "dup_line_share": dup_lines / lines,
        "repeat_share": counts["n_repeat_words"] / per_word,
        "long_word_share": by_word(chars > 12) / per_word,
        "stop_share": by_word(chars <= 3) / per_word,
    }
    return counts | ratios


def rule_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and ratios of every whole text: (doc_id, COUNTS as long, FEATURES as double)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "_text"):
            got = _measure(batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(got[c].astype(np.int64)) for c in COUNTS), *(pa.array(got[f].astype(np.float64)) for f in FEATURES)],
                ["doc_id", *COUNTS, *FEATURES],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(measured, schema)


@dataclass(frozen=True)
class Forest:
    """Trees of random splits as arrays: (tree, node). Children of node i are 2i + 1 and 2i + 2; leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    expected: float


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a random binary tree over n values."""
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def fit_forest(rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
    """Grow ``trees`` trees, each on ``sample`` of the rows, to a depth of log2(sample)."""
    depth, rng = int(np.ceil(np.log2(max(sample, 2)))), np.random.default_rng(seed)
    nodes = 2 ** (depth + 1) - 1
    feature, cut, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        held = {0: rows[rng.permutation(len(rows))[:sample]]}
        for node in range(nodes):
            own = held.pop(node, None)
            if own is None:
                continue
            level = int(np.log2(node + 1))
            low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(rows.shape[1]),) * 2
            wide = np.flatnonzero(high > low)
            if level == depth or len(own) <= 1 or not len(wide):
                path[t, node] = level + _mean_path(len(own))
                continue
            f = rng.choice(wide)
            at = rng.uniform(low[f], high[f])
            feature[t, node], cut[t, node] = f, at
            held[2 * node + 1], held[2 * node + 2] = own[own[:, f] < at], own[own[:, f] >= at]
    return Forest(feature, cut, path, max(_mean_path(min(sample, max(len(rows), 2))), 1e-9))


def path_scores(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """Anomaly of each row from 0 to 1: 2 ** (-mean path / expected path)."""
    total, depth = np.zeros(len(rows)), int(np.log2(forest.feature.shape[1] + 1)) - 1
    index = np.arange(len(rows))
    for feature, cut, path in zip(forest.feature, forest.cut, forest.path, strict=True):
        node = np.zeros(len(rows), np.int64)
        for _ in range(depth):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (rows[index, np.maximum(f, 0)] >= cut[node]))
        total += path[node]
    return 2.0 ** (-total / len(forest.path) / forest.expected)


def sample_rows(stats: DataFrame, limit: int) -> np.ndarray:
    """At most ``limit`` distinct rows of features for growing trees, chosen by a hash of the features: neither null nor repeated ids
    weigh in."""
    chosen = hashed_sample(stats, FEATURES, limit).orderBy(*FEATURES).toPandas()
    return chosen.to_numpy(np.float64).reshape(-1, len(FEATURES))


def anomaly_scores(stats: DataFrame, forest: Forest) -> DataFrame:
    """Every row of ``stats`` with its column ``score``; the forest has a fixed size whatever the input."""
    held = stats.sparkSession.sparkContext.broadcast(forest)
    names = [*stats.columns, "score"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(path_scores(held.value, rows))], names)

    return stats.mapInArrow(scored, f"{', '.join(f'{c} {t}' for c, t in stats.dtypes)}, score double")


def calibrate(scores: DataFrame, labels: DataFrame, clean_loss: float = 0.02, bins: int = 2000) -> float:
    """The lowest threshold that rejects at most ``clean_loss`` of the documents labelled good, among those with the most
    good judgements. Counts of all labelled rows go into ``bins`` bins of the score; 1.0 (reject none) without both kinds."""
    seen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_good")).where("_good in (0, 1)")
        .join(scores.select("doc_id", "score"), "doc_id")
        .groupBy(F.floor(F.col("score") * bins).cast("int").alias("bin")).agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")).collect()
    )
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for row in seen:
        good[row["bin"]], bad[row["bin"]] = row["good"], row["bad"]
    if not good.sum() or not bad.sum():
        return 1.0
    lost, caught = np.cumsum(good[::-1])[::-1] / good.sum(), np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = np.where(lost <= clean_loss, caught - lost, -1.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2]) / bins if gain.max() > 0 else 1.0  # the middle of a gap between the two kinds


def judge(docs: DataFrame, labels: DataFrame, sample: int = 8192, trees: int = 100, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """Rule counts and verdict of every document: (doc_id, counts, base_failed, score, kept).

    A document fails the base rules with fewer than ``min_words`` words or with more than ``repeat_percent`` % of its words in
    repeated windows. The others are kept while their score is below the calibrated threshold. The trees grow on a
    sample of at most ``sample`` distinct rows; all statistics, scores and the calibration cover every row.
    """
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    stats = written(rule_statistics(docs).withColumn("base_failed", failed), "rule-statistics")
    usable = stats.where("not base_failed")
    rows = sample_rows(usable, sample)
    if not len(rows):
        return stats.select("doc_id", *COUNTS, "base_failed", F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    scores = anomaly_scores(stats, fit_forest(rows, trees))
    threshold = calibrate(scores.where("not base_failed"), labels)
    kept = ~F.col("base_failed") & (F.floor(F.col("score") * 2000) < int(round(threshold * 2000)))
    return scores.select("doc_id", *COUNTS, "base_failed", "score", kept.alias("kept"))
